import random

from pyspark.sql import functions as F

from weftline.operators import edits as E


def test_blocks(spark):
    one = "<<<<<<< SEARCH\na = 1\nb\n=======\na = 2\n>>>>>>> REPLACE"
    text = f"### x.py\n{one}\nthen\n\n<<<<<<< SEARCH\nc\n=======\nd\n>>>>>>> REPLACE\n### y.py\n<<<<<<< SEARCH\n<<<<<<< SEARCH\nq\n=======\nr\n>>>>>>> REPLACE\n### y.py\n{one}\n### y.py\n{one}\nrest"
    got = E.edit_blocks(spark.createDataFrame([(1, text), (2, one), (3, None), (4, "")], "id long, text string"), "id").collect()
    assert {(r.id, r.file, r.pos, r.search, r.replace) for r in got} == {(1, "x.py", 0, "a = 1\nb", "a = 2"), (1, "then", 0, "c", "d"), (1, "y.py", 0, "a = 1\nb", "a = 2")}


def test_apply(spark):
    b = "array<struct<pos:int,search:string,replace:string>>"
    e = "array<struct<start:int,end:int,text:string>>"
    df = spark.createDataFrame([("a\nb\nc\nab", [(0, "a\nb", "x"), (1, "b", "B"), (2, "no", "yes"), (3, "", "!"), (4, "...\nc", "...\nC\nD")], [(2, 2, "  z"), (1, 1, "y"), (1, 1, "y"), (3, 4, "one\ntwo\nthree")])], f"t string, b {b}, e {e}")
    r = df.select(E.apply_blocks(F.col("t"), F.col("b")).alias("b"), E.apply_lines(F.col("t"), F.col("e")).alias("e")).first()
    assert r.b == "a\nB\nC\nD\nab"  # the last block goes first, so that the first one finds nothing
    assert r.e == "y\n  z\none\ntwo\nthree"
    keep = spark.createDataFrame([("if x:\n    a\n", [(2, 2, "b")])], f"t string, e {e}").select(E.apply_lines(F.col("t"), F.col("e"))).first()[0]
    assert keep == "if x:\n    b\n"


def test_calls(spark):
    """Commands in Python blocks: repeats, named arguments, brackets in strings, what is no string or no number."""
    one = '```python\nedit_file("a.py", 1, 2, "x\\ny")\nedit_file("a.py", 1, 2, "x\\ny")\nedit_file("b.py", 3, 3, """f(1) # )""")\n```'
    odd = "```python\nedit_file(file='a.py', start=1, end=2, content='''q\\n''')\nedit_file('a.py', 4, 5, 'two\nlines')\nedit_file(a.py, 6, 6, 7)\nedit_file('a.py', x, 6, 'no')\nedit_file('a.py', 1)\nedit_file('a.py', 8, 9, '')\n```"
    rows = [(1, one), (2, odd), (3, None), (4, ""), (5, 'edit_file("a.py", 1, 1, "x")'), (6, "```python\nedit_file(\n```"), (7, one)]
    got = E.edit_calls(spark.createDataFrame(rows, "id long, text string"), "id").collect()
    of = lambda i: {tuple(r)[1:] for r in got if r.id == i}
    assert of(1) == of(7) == {("a.py", 0, 1, 2, "x\ny"), ("b.py", 0, 3, 3, "f(1) # )")}
    assert of(2) == {("a.py", 0, 1, 2, "q\\n"), ("a.py", 1, 4, 5, "two\nlines"), ("a.py", 2, 6, 6, "7"), ("a.py", 3, 8, 9, "")}
    assert {r.id for r in got} == {1, 2, 7}


def _applied(content, edits):
    lines = content.split("\n")
    n = len(lines)
    for start, end, text in sorted(dict.fromkeys(edits), key=lambda e: -e[0]):
        if not (1 <= start <= n and 0 <= end <= n):
            continue
        new = text.splitlines()
        if start == end and len(new) == 1 and text == text.lstrip():
            old = lines[start - 1] if start <= len(lines) else ""
            new = [old[: len(old) - len(old.lstrip())] + new[0]]
        lines[start - 1 : max(end, start - 1)] = new
    return "\n".join(lines)


def test_lines_against_a_plain_program(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        content = "\n".join(rng.choice(("", "a", "  b", "\tc d")) for _ in range(rng.randrange(1, 7)))
        edits = [(rng.randrange(-1, 9), rng.randrange(-1, 9), rng.choice(("", "x", " y", "x\ny", "z\n", "\n"))) for _ in range(rng.randrange(4))]
        rows.append((content, edits))
    df = spark.createDataFrame(rows, "t string, e array<struct<start:int,end:int,text:string>>")
    got = df.select("t", "e", E.apply_lines(F.col("t"), F.col("e")).alias("r")).collect()
    assert len(got) == 200
    for r in got:
        assert r.r == _applied(r.t, [tuple(x) for x in r.e]), r


CODE = '''"""
module
"""
const = {1,2,3}
import os

class K:
    """doc"""

    x = 1

    @wraps(f)
    def run(self, a: int = {1: 2}[1]) -> "é:":  # why
        """doc"""
        return a

    if os:
        def inner(self): return 1
# é
class D(K):
    "only"
def one(): return {1: 2}
async def two(
    a,
):
    b = lambda: 3
    return b
if os:
    def lost(): pass
y = 1; import re
import re; z = 1
'''


def test_skeleton(spark):
    want = '''const = {1,2,3}

class K:

    x = 1

    @wraps(f)
    def run(self, a: int = {1: 2}[1]) -> "é:":
...

    if os:
        def inner(self):
...
# é
class D(K):
    pass
def one():
...
async def two(
    a,
):
...
y = 1; import re
'''
    assert E.skeleton(CODE) == want
    bare = E.skeleton(CODE, constants=False)
    assert "const" not in bare and "y = 1" not in bare and "x = 1" in bare
    assert E.skeleton("def (") == "def (" and E.skeleton("") == "" and E.skeleton("import os") == ""
    got = {r.file: r.text for r in E.skeletons(spark.createDataFrame([("k.py", CODE), ("n.py", None)], "file string, text string")).collect()}
    assert got == {"k.py": want, "n.py": None}
