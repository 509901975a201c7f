"""Queries of edits and skeletons, over files and answers made of the suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import edits as E
from weftline.plans.registry import query
from weftline.session import table

_K = "s_suppkey"


def _said(spark, sf_dir, text: str):
    """s_suppkey and text, in which # is the key."""
    return table(spark, sf_dir, "supplier").select(F.col(_K), F.replace(F.lit(text), F.lit("#"), F.col(_K).cast("string")).alias("text"))


_BLOCK = f"{E.SEARCH}\nx = #\n{E.MIDDLE}\nx = 0\ny = #\n{E.REPLACE}\n"
_ANSWER = f"src/a.py\n{_BLOCK}{E.SEARCH}\nz\n{E.MIDDLE}\n{E.REPLACE}\nsrc/b.py\n{_BLOCK}src/a.py\n{_BLOCK}"
_X, _Y = "'x = ' || s_suppkey", "'x = 0' || chr(10) || 'y = ' || s_suppkey"


@query(f"select s_suppkey, 'src/a.py' as file, 0 as pos, {_X} as search, {_Y} as replace from supplier union all select s_suppkey, 'src/a.py', 1, 'z', '' from supplier union all select s_suppkey, 'src/b.py', 0, {_X}, {_Y} from supplier")
def edit_blocks(spark, sf_dir):
    """Distinct search-and-replace blocks of answers, by file."""
    return E.edit_blocks(_said(spark, sf_dir, _ANSWER), _K).withColumn("pos", F.col("pos").cast("int"))


@query(f"select s_suppkey, 'a' || chr(10) || {_Y} || chr(10) || chr(10) || 'b' as blocks, 'one' || chr(10) || '  in' as lines from supplier")
def edits_applied(spark, sf_dir):
    """Files after the blocks of an answer, and after edits of lines."""
    blocks = E.edit_blocks(_said(spark, sf_dir, _ANSWER), _K).where("file = 'src/a.py'").groupBy(_K).agg(F.collect_list(F.struct("pos", "search", "replace")).alias("blocks"))
    files = _said(spark, sf_dir, "a\nx = #\nz\nb").join(blocks, _K)
    edits = F.expr("array(named_struct('start', 2, 'end', 2, 'text', 'in'), named_struct('start', 1, 'end', 1, 'text', 'one'))")
    return files.select(_K, E.apply_blocks(F.col("text"), F.col("blocks")).alias("blocks"), E.apply_lines(F.concat_ws("\n", F.lit("#"), F.concat(F.lit("  "), F.col(_K))), edits).alias("lines"))


_CALLS = r"""I would do this:
```python
edit_file("src/a.py", 2, 3, "b = #")
edit_file(file='src/b.py', start=1, end=1, content="kept\n#")
edit_file("src/a.py", 1, 1, '''import os
x = f(#, ")")''')
edit_file("src/a.py", 2, 3, "b = #")
edit_file("src/a.py", one, 3, "lost")
```
and not `edit_file("src/c.py", 1, 1, "out")`.
```python
edit_file("src/a.py", 4, 4, "tab\t#")
```
"""
_CALLED = "'import os' || chr(10) || 'x = f(' || s_suppkey || ', \")\")'"


@query(
    f"""select s_suppkey, 'src/a.py' as file, 0 as pos, 2 as start, 3 as "end", 'b = ' || s_suppkey as text from supplier
union all select s_suppkey, 'src/a.py', 1, 1, 1, {_CALLED} from supplier union all select s_suppkey, 'src/a.py', 2, 4, 4, 'tab' || chr(9) || s_suppkey from supplier
union all select s_suppkey, 'src/b.py', 0, 1, 1, 'kept' || chr(92) || 'n' || s_suppkey from supplier"""
)
def edit_calls(spark, sf_dir):
    """Edit commands with ranges of lines in the free text of answers, by file."""
    return E.edit_calls(_said(spark, sf_dir, _CALLS), _K).withColumn("pos", F.col("pos").cast("int"))


@query(f"select s_suppkey, {_CALLED} || chr(10) || 'b = ' || s_suppkey || chr(10) || 'tab' || chr(9) || s_suppkey || chr(10) || 'e' as text from supplier")
def edit_calls_applied(spark, sf_dir):
    """Files of five lines after the edit commands of answers."""
    calls = E.edit_calls(_said(spark, sf_dir, _CALLS), _K).where("file = 'src/a.py'")
    edits = calls.groupBy(_K).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("edits"))
    files = _said(spark, sf_dir, "a\n b\n c\nd\ne").join(edits, _K)
    return files.select(_K, E.apply_lines(F.col("text"), F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text")))).alias("text"))


@query("select 'm' || s_suppkey || '.py' as file, 'N = ' || s_suppkey || chr(10) || 'class K' || s_suppkey || ':' || chr(10) || '    def run(self):' || chr(10) || '...' as text from supplier")
def code_skeletons(spark, sf_dir):
    """Modules without bodies, imports and documentation."""
    code = '"""About."""\nimport os\nN = #\nclass K#:\n    """Doc."""\n    def run(self):\n        return #'
    return E.skeletons(_said(spark, sf_dir, code).select(F.concat(F.lit("m"), _K, F.lit(".py")).alias("file"), "text"))
