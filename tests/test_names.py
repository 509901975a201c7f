"""Resolution of Python calls against a plain walk over the graph, and by example."""

from __future__ import annotations

import random

import pytest

from weftline.operators import names as N

FILES = {
    "app/main.py": "import lib.tools as t\nfrom lib import made, helper as h\nfrom . import near\nfrom .near import *\nclass A(Base, m.Other):\n    @deco\n    def __init__(self):\n        self.run(); made()\n        def hidden():\n            t()\n    def run(self, x=made()):\n        def inner():\n            go()\n        inner(); h(); A(); run()\n        class Local:\n            def go(self): pass\nif True:\n    async def late():\n        await go(); missing()\n",
    "app/near.py": "def go():\n    pass\nclass Base:\n    class In:\n        def deep(self): pass\n    def run(self): deep(); go()\n",
    "app/__init__.py": "",
    "lib/__init__.py": "from .sub import *\nfrom lib.tools import helper\n",
    "lib/sub/__init__.py": "from ..more.core import made, Other as missing\nimport lib\n",
    "lib/more/core.py": "def made(): pass\nclass Other:\n    def deco(self): pass\n",
    "lib/tools.py": "def helper():\n    return helper\ndef go(): helper()\n",
    "bad.py": "def (",
}


def walk(nodes, used, targets):
    """Edges by walking up scopes and along imports, name by name."""
    kind = {(f, n): k for f, n, k in nodes}
    children = {}
    for f, n in kind:
        children.setdefault((f, n.rpartition(".")[0]), []).append((f, n))

    def inner(scope, but=None):
        out = []
        for c in children.get(scope, []):
            if c != but:
                out.append(c)
                if kind[c] == "class":
                    out += inner(c)
        return out

    imports = {}
    for f, dst, alias in targets:
        imports.setdefault(f, []).append((dst, alias))

    def node(dst):
        f, _, n = dst.partition(":")
        return (f, n)

    edges = set()
    for f, owner, how, name in used:
        found, cur, before = [], (f, owner), (f, owner)
        while True:
            found += inner(cur, before)
            if not cur[1]:
                break
            before, cur = cur, (f, cur[1].rpartition(".")[0])
        chain, stack = [], [f]
        while stack:
            for dst, _ in imports.get(stack.pop(), []):
                if dst.endswith("__init__.py") and dst not in [*chain, f]:
                    chain.append(dst)
                    stack.append(dst)
        named = []
        for g in chain:
            found += inner((g, ""))
        for g in [*chain, f]:
            for dst, alias in imports.get(g, []):
                n = node(dst)
                if alias == name:
                    named.append(dst)
                if not n[1] or kind[n] == "class":
                    found += inner(n)
                if n[1]:
                    found.append(n)
        named += [f"{a}:{b}" for a, b in found if b.rpartition(".")[2] == name]
        edges |= {(f"{f}:{owner}", d, how) for d in named}
    return edges


def tuples(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([*FILES.items(), ("none.py", None), ("x.js", "a")], "file string, text string")
    nodes, used, imports = N.python_names(files)
    return nodes, used, N.import_targets(imports, files, nodes)


def test_targets(parsed):
    assert tuples(parsed[2]) == {
        ("app/main.py", "lib/tools.py", "t"), ("app/main.py", "lib/__init__.py", None), ("app/main.py", "lib/__init__.py", "h"), ("app/main.py", "app/near.py", None),
        ("lib/__init__.py", "lib/sub/__init__.py", None), ("lib/__init__.py", "lib/tools.py:helper", None), ("lib/sub/__init__.py", "lib/more/core.py:made", None), ("lib/sub/__init__.py", "lib/more/core.py:Other", "missing"), ("lib/sub/__init__.py", "lib/__init__.py", None),
    }


def test_example(parsed):
    nodes, used, targets = parsed
    got = tuples(N.callees(nodes, used, targets))
    assert got == walk(tuples(nodes), tuples(used), tuples(targets))
    main = "app/main.py"
    assert {(f"{main}:A", "app/near.py:Base", "inherits"), (f"{main}:A", "lib/more/core.py:made", "invokes"), (f"{main}:late", "lib/more/core.py:Other", "invokes"), (f"{main}:A.run", "lib/__init__.py", "invokes")} <= got
    assert (f"{main}:A.run", f"{main}:A", "invokes") not in got  # nothing names what is around it


def test_nearest_and_everywhere(parsed):
    nodes, used, targets = parsed
    near = tuples(N.callees(nodes, used, targets, nearest=True))
    assert ("app/main.py:A.run.inner", "app/main.py:A.run.Local.go", "invokes") in near
    assert len({(a, t) for a, _, t in near if a == "app/main.py:A.run.inner"}) == len([x for x in near if x[0] == "app/main.py:A.run.inner"])
    every = tuples(N.callees(nodes, used, targets, everywhere=True))
    assert tuples(N.callees(nodes, used, targets)) <= every


def test_random_graphs(spark):
    rng = random.Random(8)
    files = [f"p{i % 4}/{'__init__' if i % 3 == 0 else f'm{i}'}.py" for i in range(14)]
    files = sorted(set(files))
    nodes, names = {}, "abcdef"
    for f in files:
        for _ in range(7):
            up = rng.choice(["", *[n for g, n in nodes if g == f]])
            nodes[f, f"{up}.{rng.choice(names)}" if up else rng.choice(names)] = rng.choice(("class", "function"))
    used = {(*rng.choice(list(nodes)), rng.choice(("invokes", "inherits")), rng.choice(names)) for _ in range(150)}
    targets = {(rng.choice(files), rng.choice([*files, *[f"{f}:{n}" for f, n in nodes]]), rng.choice((None, None, *names))) for _ in range(40)}
    n = spark.createDataFrame([(*k, v) for k, v in nodes.items()], "file string, name string, kind string")
    u = spark.createDataFrame(sorted(used), "file string, owner string, kind string, name string")
    t = spark.createDataFrame(sorted(targets, key=repr), "file string, dst string, alias string")
    assert tuples(N.callees(n, u, t)) == walk({(*k, v) for k, v in nodes.items()}, used, targets)
