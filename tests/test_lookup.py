import pytest
from pyspark.sql import functions as F

from weftline.operators import lookup as K
from weftline.operators import retrieval as R


def test_values(spark):
    df = spark.createDataFrame([({"b": [], "c": ["x"]}, '[["a"], "b", {"file": "c"}, {"k": 1}]')], "m map<string,array<string>>, j string")
    assert df.select(K.first_present(F.col("m"), ["a", "b", "c"])).first()[0] == []
    assert df.select(K.flatten_mixed(F.col("j"))).first()[0] == ["a", "b", "c"]
    assert df.select(K.flatten_mixed(F.lit("one"))).first()[0] == ["one"]
    shape = K.patch_shape(F.lit("diff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n+z"))
    assert tuple(df.select(*(shape[k] for k in ("files", "hunks", "added", "removed"))).first()) == (1, 1, 2, 1)
    assert df.select(K.is_tool_path(F.lit("/usr/lib/x.py"))).first()[0] is True


def test_selection(spark):
    nodes = spark.createDataFrame([("1", "function", "f", "x.py", 3, 9), ("2", "file", "x.py", "x.py", 1, 9), ("3", "class", "K", "y.py", 1, 500)], "id string, type string, label string, file string, start_line int, end_line int")
    assert [r.id for r in K.select_start(nodes, file="x.py").collect()] == ["2", "1"]
    with pytest.raises(ValueError):
        K.select_start(nodes, node_id="1", label="f")
    edges = spark.createDataFrame([("2", "1", "contains", 1), ("2", "3", "contains", 1), ("1", "3", "references", 2)], "src string, dst string, type string, line int")
    assert [r.id for r in K.children(edges, nodes, "2").collect()] == ["1"]
    assert {tuple(r) for r in K.dependencies(edges).collect()} == {("1", "3"), ("1", "2"), ("3", "2")}
    assert K.cross_file(edges, nodes).count() == 2 and K.cross_file(edges, nodes, before_line=True).select("src").collect()[0][0] == "1"
    reached = spark.createDataFrame([("1", 1, "contains"), ("3", 1, "calls"), ("2", 2, "calls")], "node string, depth int, via string")
    assert [r.id for r in K.ordered_neighbors(reached, nodes).collect()] == ["3", "1", "2"]
    watched = spark.createDataFrame([("f", ["x.py"]), ("K", [])], "name string, files array<string>")
    calls = spark.createDataFrame([("f", "x.py"), ("f", "z.py"), ("K", "q.py")], "name string, file string")
    assert sorted(tuple(r) for r in K.sensitive_calls(calls, watched).collect()) == [("K", "q.py"), ("f", "x.py")]


def test_entities(spark):
    files = spark.createDataFrame([("a/Card.js", "l1\nl2\nl3"), ("a/Card.css", ""), ("b/card_list.js", "")], "file string, text string")
    entities = spark.createDataFrame([("a/Card.js", "class", "Card", "Card", 1, 3), ("a/Card.js", "method", "go", "Card.go", 2, 2), ("a/Card.js", "file", "Card.js", "Card.js", 1, 3)], "file string, kind string, name string, qualified_name string, start_line int, end_line int")
    assert [(r.qualified_name, [m.name for m in r.methods]) for r in K.with_methods(entities).collect()] == [("Card", ["go"])]
    assert {r.name: r.ids for r in K.name_index(entities).collect()}["card"] == ["a/Card.js::Card", "a/Card.js::Card.js"]
    assert {r.qualified_name: r.code for r in K.code_of(files, entities).collect()}["Card.go"] == "l2"
    assert {tuple(r) for r in K.sibling_files(files).collect()} == {("a/Card.js", "a/Card.css"), ("a/Card.css", "a/Card.js")}
    assert ("a/Card.js", "b/card_list.js") in {tuple(r) for r in K.related_files(files).collect()}
    anchors = spark.createDataFrame([("n1", "Card title go")], "anchor string, text string")
    nodes = spark.createDataFrame([("x", "goTitle", "a/Card.js", 0), ("y", "go", "b/other.js", 1)], "id string, name string, file string, pos int")
    got = K.anchor_matches(anchors, nodes).first()
    assert got.id == "x" and got.score == 3
    ranked = K.symbols_in_file(entities.where("kind <> 'file'"), F.lit("card go fails")).orderBy("rank").collect()
    assert [r.qualified_name for r in ranked] == ["Card", "Card.go"] or [r.qualified_name for r in ranked] == ["Card.go", "Card"]


def test_relations_and_traces(spark):
    scene = spark.createDataFrame([("n1", "n2", "contains")], "src string, dst string, relation string")
    matches = spark.createDataFrame([("n1", "a"), ("n2", "b")], "anchor string, id string")
    code = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "renders")], "src string, dst string, type string")
    preferred = spark.createDataFrame([("contains", "renders", 0)], "relation string, type string, rank int")
    assert [r.type for r in K.aligned_relations(scene, matches, code, preferred).collect()] == ["renders"]
    calls = spark.createDataFrame([(1, 80, True, 1), (2, 90, False, 0), (3, 50, False, 0)], "id int, relevance int, other_file boolean, layers int")
    assert [(r.id, r.score) for r in K.trace_scores(calls).orderBy("rank").collect()] == [(2, 10), (1, 80)]


def test_logs_answers_and_search(spark):
    logs = spark.createDataFrame([("i", "x/prettier", "PASS a.test.js\nFAIL b.test.js"), ("j", "q/sympy", "test_x ok\ntest_y F")], "instance_id string, repository string, log string")
    assert {tuple(r) for r in K.statuses_by_repository(logs).collect()} == {("i", "a.test.js", "PASSED"), ("i", "b.test.js", "FAILED"), ("j", "test_x", "PASSED"), ("j", "test_y", "FAILED")}
    out = spark.createDataFrame([("i", "text\nsrc/a.py\nfunction: K.go\nline: 12\n\nb.js\nclass: Q")], "instance_id string, output string")
    assert [tuple(r)[2:] for r in K.located_spans(out).orderBy("pos").collect()] == [("src/a.py", "file", None, None), ("src/a.py", "function", "K.go", None), ("src/a.py", "line", None, 12), ("b.js", "file", None, None), ("b.js", "class", "Q", None)]
    chunks = spark.createDataFrame([(1, "src/a.py", "alpha beta"), (2, "src/a.py", "alpha"), (3, "lib/b.py", "alpha alpha")], "doc_id long, file string, text string")
    q = spark.createDataFrame([(9, "alpha")], "query_id long, text string")
    assert {r.doc_id for r in K.snippet_search(chunks, q, "src/*").collect()} == {1, 2}
    assert {r.doc_id for r in K.snippet_search(chunks, q, "none").collect()} == {1, 2, 3}
    hits = R.bm25(chunks, q)
    assert {r.file for r in K.file_hits(hits, chunks).collect()} == {"src/a.py", "lib/b.py"}
    assert K.LexicalRetriever(chunks).search(q, 1).count() == 1
    tasks, done = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in K.resume(tasks, done, "k").collect()] == ["b"]
    assert K.CONDENSERS["none"](tasks).count() == 2


def test_tools_by_name(spark):
    tools = K.Tools()
    tools.add("rows", lambda n, start=0: spark.range(start, n), {"n": int, "start": int}, ("n",))
    assert tools.call("rows", '{"n": 5, "start": 2}').count() == 3
    for name, arguments in [("none", "{}"), ("rows", "{}"), ("rows", '{"n": "5"}'), ("rows", '{"n": true}'), ("rows", '{"n": 1, "m": 2}'), ("rows", "[1]")]:
        with pytest.raises(ValueError):
            tools.call(name, arguments)


def test_pooling_and_prefixes(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], []), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, s array<array<double>>, m array<int>")
    got = {r.id: (r.mean, r.cls) for r in df.select("id", K.pooled(F.col("s"), F.col("m")).alias("mean"), K.pooled(F.col("s"), F.col("m"), "cls").alias("cls")).collect()}
    assert got == {1: ([2.0, 3.0], [1.0, 2.0]), 2: ([0.0, 0.0], [1.0, 2.0]), 3: (None, None), 4: (None, None)}
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    embed = lambda df: df.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0)))
    found = K.DenseRetriever(docs, embed, query_prefix="query: ", document_prefix="d: ")
    assert {r.doc_id: r.vector for r in found.docs.collect()} == {1: [5.0, 1.0], 2: [3.0, 1.0]}
    assert found.search(spark.createDataFrame([(7, "")], "query_id long, text string"), 1).first().doc_id == 1


def test_related_files_are_paired_once(spark):
    """Files given often count once, pairs of several tokens come once, and no pair is gathered to drop repeats."""
    names = [f"d/{a}_{b}_own{i}.py" for i, (a, b) in enumerate([("red", "car"), ("car", "red"), ("red", "bus"), ("van", "bus"), ("sea", "air")])]
    tokens = {x: set(x[2:-3].split("_")) for x in names}
    files = spark.createDataFrame([(x,) for x in names * 30] + [(None,)], "file string")
    for block in (1, 2, 1024):
        df = K.related_files(files, block=block)
        assert sorted(tuple(r) for r in df.collect()) == sorted((x, y) for x in names for y in names if x != y and tokens[x] & tokens[y])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    assert {tuple(r) for r in K.related_files(files, least_share=0.5).collect()} == {(names[2], names[3]), (names[3], names[2]), (names[0], names[1]), (names[1], names[0])}
