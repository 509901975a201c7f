"""Micro tables for the operators' corner cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import events as E
from weftline.operators import fuzzy as Z
from weftline.operators import graph as G
from weftline.operators import intervals as I
from weftline.operators import metrics as M
from weftline.operators import rank as K
from weftline.operators import retrieval as R
from weftline.operators import summary as S


def metric(spark, pred, gold, f):
    return spark.createDataFrame([(pred, gold)], "pred array<string>, gold array<string>").select(f(F.col("pred"), F.col("gold"))).first()[0]


@pytest.mark.parametrize(
    ("pred", "gold", "name", "k", "value"),
    [
        (["a", "x", "b"], ["a", "b"], "acc", 1, 1.0),
        (["a", "x", "b"], ["a", "b"], "acc_strict", 1, 0.0),
        (["a", "x", "b"], ["a", "b"], "acc_strict", 3, 1.0),
        (["a", "x", "b"], ["a", "b"], "mrr", 3, 1.0),
        (["a", "x", "b"], ["a", "b"], "map_gold", 3, (1 + 2 / 3) / 2),
        (["a", "x", "b"], ["a", "b"], "map_k", 3, (1 + 2 / 3) / 3),
        (["x", "a", "a", "b"], ["a", "b"], "map_gold", 15, (1 / 2 + 2 / 4) / 2),
        (["x", "a", "a", "b"], ["a", "b"], "map_repeats", 15, (1 / 2 + 2 / 3 + 3 / 4) / 2),
        ([], ["a"], "acc", 5, 0.0),
        ([], ["a"], "mrr", 5, 0.0),
        (["a"], [], "acc_strict", 5, 0.0),
        (["a"], [], "map_gold", 5, 0.0),
        (["a"], [], "ndcg", 5, 0.0),
        (["x", "a"], ["a"], "ndcg", 5, 0.6309297535714575),
        (["a", "b"], ["a"], "precision", 4, 0.25),
        (["a", "b"], ["a", "c", "d"], "recall", 2, 0.5),
    ],
)
def test_metrics(spark, pred, gold, name, k, value):
    assert metric(spark, pred, gold, lambda p, g: M.METRICS[name](p, g, k)) == pytest.approx(value)


def test_set_metrics_and_missing_predictions(spark):
    assert metric(spark, ["a", "x", "b"], ["a", "b"], lambda p, g: M.set_metrics(p, g)["f1"]) == pytest.approx(0.8)
    gold = spark.createDataFrame([("q1", ["a"]), ("q2", ["b"])], "query_id string, gold array<string>")
    pred = spark.createDataFrame([("q1", ["a"])], "query_id string, pred array<string>")
    assert M.macro(M.with_predictions(gold, pred), {"acc": M.acc(F.col("pred"), F.col("gold"), 1)}).first().acc == 50.0


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "selectedSite is null in the contact form"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "null selectedSite contact form form form form"), (8, "absent")], "query_id long, text string")
    got = R.bm25(docs, q).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1)] and got[0].score > 0
    rankings = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1), ("q", "a", 2), ("q", "c", 1)], "query_id string, doc_id string, rank int")
    assert [r.doc_id for r in R.reciprocal_rank_fusion(rankings).orderBy("rank").collect()] == ["a", "b", "c"]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [-1.0, -1.0, 0.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(9, [2.0, 2.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.doc_id, r.score) for r in R.dense(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107)]
    assert R.dense(v, q.limit(0)).count() == 0


def test_name_distance(spark):
    df = spark.createDataFrame([("Foo.py", "foo"), ("abc", "abd"), ("x.java", "y.java")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(R.name_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 0.3333, 1.0]


EDGES = [("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("d", "a", "u"), ("a", "b", "u"), ("x", "x", "t"), ("p", "q", "t")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(EDGES)], "src string, dst string, type string, pos long")


def test_reach(spark, edges):
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    got = {(r.root, r.node): r.depth for r in G.reach(edges, roots, -1).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("x", "x"): 0}
    assert {r.node for r in G.reach(edges, roots, -1, types=["t"]).where("root = 'a'").collect()} == {"a", "b", "c", "d"}
    assert {(r.node, r.depth) for r in G.reach(edges, roots.where("root = 'a'"), 1, "both").collect()} == {("a", 0), ("b", 1), ("d", 1)}
    pairs = spark.createDataFrame([("a", "d"), ("a", "p"), ("q", "p")], "a string, b string")
    assert {(r.a, r.b): r.hops for r in G.shortest_hops(edges, pairs).collect()} == {("a", "d"): 1, ("a", "p"): 999_999, ("q", "p"): 1}


def test_graph_helpers(spark, edges):
    nodes = spark.createDataFrame([("a", "file", "A"), ("b", "class", "B")], "id string, type string, label string")
    assert {tuple(r) for r in G.induced(edges, nodes).select("src", "dst", "type").collect()} == {("a", "b", "t"), ("a", "b", "u")}
    assert G.pattern(edges, nodes, F.col("s_type") == "file", F.col("type") == "u", F.lit(True)).count() == 1
    assert {tuple(r) for r in G.neighbors(edges, nodes, ["t"], ["class"]).select("node", "direction").collect()} == {("a", "out"), ("c", "in")}
    assert {r.node for r in G.undirected_reach(edges, spark.createDataFrame([("q",)], "id string")).collect()} == {"p", "q"}
    assert G.all_paths(edges.where("type = 't'"), spark.createDataFrame([("x",)], "root string"), 3).count() == 4
    chain = {tuple(r)[:2] for r in G.path_chain(spark.createDataFrame([("a/b/c.py",), ("top",)], "path string")).collect()}
    assert chain == {("a", "a/b"), ("a/b", "a/b/c.py")}
    topo = G.topological_order(spark.createDataFrame([(1, "b", "a"), (1, "a", "c"), (1, "c", "a"), (2, "z", "y")], "g long, src string, dst string"), "g")
    assert {(r.g, r.node): r["rank"] for r in topo.collect()} == {(1, "b"): 1, (1, "a"): 2, (1, "c"): 3, (2, "z"): 1, (2, "y"): 2}
    weighted = spark.createDataFrame([(1, "r", "a", 1.0, "r"), (1, "r", "b", 2.0, "r"), (1, "b", "c", 1.0, "r"), (1, "a", "d", 9.0, "r")], "g long, src string, dst string, weight double, root string")
    assert [r.node for r in G.best_first(weighted, "g", "root").orderBy("rank").collect()] == ["r", "a", "b", "d", "c"]


def test_scene(spark):
    nodes = spark.createDataFrame([(0, None, "button", "Save", "x"), (1, "n", "label", "A", "x"), (2, "n", "label", "B", "x"), (3, "m", "button", " save ", "root")], "pos long, id string, type string, text string, role string")
    links = spark.createDataFrame([(0, "node_1", "n", "Is In"), (1, "n", "m", "x"), (2, "n_2", "n", None), (3, "n_2", "n", "")], "pos long, src string, dst string, relation string")
    kept, live = G.normalize_scene(nodes, links)
    assert {(r.id, r.role) for r in kept.collect()} == {("node_1", "root"), ("n", "x"), ("n_2", "x")}
    assert {(r.src, r.dst, r.relation) for r in live.collect()} == {("node_1", "n", "is_in"), ("n_2", "n", "related_to")}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(spans=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=12))
def test_merged_intervals_are_disjoint(spark, spans):
    df = spark.createDataFrame([("g", a, a + n) for a, n in spans], "g string, start long, end long")
    got = sorted((r.start, r.end) for r in I.merge(df, "g").collect())
    expected = []
    for a, b in sorted((a, a + n) for a, n in spans):
        if expected and a <= expected[-1][1]:
            expected[-1][1] = max(expected[-1][1], b)
        else:
            expected.append([a, b])
    assert got == [tuple(x) for x in expected]


def test_interval_joins(spark):
    spans = spark.createDataFrame([("g", 1, 10, 1, 0), ("g", 2, 4, 2, 1), ("g", 2, 4, 3, 2), ("h", 1, 100, 4, 3)], "g string, start long, end long, id long, pos long")
    points = spark.createDataFrame([("g", 4), ("g", 10), ("g", 11), ("h", 4)], "g string, at long")
    assert {(r.g, r.at, r.id) for r in I.innermost(points, spans, "g", ["g", "at"], 3).collect()} == {("g", 4, 2), ("g", 10, 1), ("h", 4, 4)}
    assert {(r.id, r.parent) for r in I.parents(spans, "g", 3).collect()} == {(1, None), (2, 1), (3, 1), (4, None)}


def test_events(spark):
    log = spark.createDataFrame([("l", i, x, t) for i, (x, t) in enumerate([("user", "a"), ("agent", "b"), ("agent", "b"), ("obs", "c"), ("agent", "b")], 1)], "log string, id long, kind string, text string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(E.head_tail(log, "log", ["id"], 1, 3)) == [1, 4, 5]
    assert ids(E.head_tail(log, "log", ["id"], 1, 2)) == [1, 5]
    assert ids(E.head_tail(log, "log", ["id"], 4, 3)) == [1, 2, 3, 4]
    assert ids(E.amortized(log, "log", ["id"], 1, 4)) == [1, 5]
    assert ids(E.attention_fill(log, "log", ["id"], F.col("id") == 1, 3)) == [1, 4, 5]
    agent, heard = F.col("kind") == "agent", F.col("kind") == "obs"
    assert E.monologue(log, "log", ["id"], agent, heard, "text").first().stuck is False
    assert E.monologue(log.where("kind <> 'obs'"), "log", ["id"], agent, heard, "text").first().stuck is True
    assert [r.text for r in E.mask_old(log, "log", ["id"], 2, agent).orderBy("id").collect()] == ["a", "<MASKED>", "<MASKED>", "c", "b"]
    assert E.adjacent_repeat(log, "log", ["id"], agent).first().stuck is True
    assert E.same_last(log, "log", ["id"], ["text"]).first().stuck is False
    for bad in (0, 101):
        with pytest.raises(ValueError):
            E.page(log, bad)
    assert ids(E.page(E.matching(log, first=2), 2)) == [2, 3]
    assert ids(E.replay(log.where("id <> 3"))) == [1, 2]
    assert ids(E.matching(log, text="AGENT")) == [2, 3, 5]
    tokens = spark.createDataFrame([(0,), (10,), (None,)], "o long").select(E.page_token(F.col("o")).alias("t")).select("t", E.token_offset(F.col("t")).alias("o")).collect()
    assert [tuple(r) for r in tokens] == [("MA==", 0), ("MTA=", 10), (None, 0)]
    a = spark.createDataFrame([(1,), (2,)], "id long")
    o = spark.createDataFrame([(3, 1), (4, 1), (5, 9)], "id long, cause long")
    assert {tuple(r) for r in E.pairs(a, o).collect()} == {(1, 4), (2, None), (None, 5)}


def test_votes_and_roles(spark):
    lists = spark.createDataFrame([("i", 0, ["a", "b"]), ("i", 1, ["b", "a"]), ("i", 2, ["c"])], "instance string, sample int, locs array<string>")
    assert [r.item for r in K.vote(lists, "instance", "sample", "locs").orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.item for r in K.vote(lists, "instance", "sample", "locs", "mrr").orderBy("rank").collect()] == ["a", "b", "c"]
    roles = spark.createDataFrame([("t", i, "primary") for i in range(6)], "k string, n int, role string")
    assert [r.new_role for r in K.capped_roles(roles, "k", [F.col("n")]).orderBy("rank").collect()] == ["primary"] * 2 + ["secondary"] * 3


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in S.binned(df, "v", [0, 1, 2, 3]).orderBy("bin").collect()] == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 2), (2, 2.0, 3.0, 0)]
    assert S.same_results(df, df.unionByName(df)).first().same is True
    assert S.same_results(df, df.where("k = 'a'")).first().same is False
    assert S.sampled(df.selectExpr("k", "v", "monotonically_increasing_id() as id"), "id", 2).count() == 2
    low, mean, high = S.bootstrap_interval(spark.range(200), "id", F.col("id") < 100, 50).first()
    assert low <= mean <= high and abs(mean - 0.5) < 0.1
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, p_in double, p_out double")
    usage = spark.createDataFrame([("m", 3, 4), ("n", 1, 1)], "model string, prompt int, completion int")
    assert S.token_cost(usage.where("model = 'm'"), prices).first().cost == 11.0
    with pytest.raises(Exception, match="no price of n"):
        S.token_cost(usage, prices).collect()


@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    assert Z.lcs(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b, 1):
        out.append(row[j - 1] + 1 if x == y else max(row[j], out[-1]))
    return out


def test_fuzzy(spark):
    assert Z.token_set("a_b c", "c b-a d") == 100.0 and Z.token_set("", "x") == 0.0
    chunks = spark.createDataFrame([(i, i, f"chunk{i}") for i in range(1, 5)], "start int, end int, chunk string")
    assert [(r.start, round(r.score, 4)) for r in Z.best_chunks(chunks, "chunk2", 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.8333)]
    entities = spark.createDataFrame([("m.A", "A"), ("m.A.__init__", "__init__"), ("n.helper", "helper")], "id string, name string")
    queries = spark.createDataFrame([("m.A",), ("helper",), ("HELPER",), ("x.helper",), ("helpr",), ("zzz",)], "query string")
    got = {(r.query, r.id, r.tier) for r in Z.entity_search(entities, queries).collect()}
    assert got == {("m.A", "m.A", 0), ("helper", "n.helper", 2), ("HELPER", "n.helper", 3), ("x.helper", "n.helper", 4), ("helpr", "n.helper", 5)}
    files = spark.createDataFrame([("src/a/x.py",), ("src/b/x.py",), ("lib/y.py",)], "path string")
    said = spark.createDataFrame([("lib/y.py",), ("a/x.py",), ("y.py",), ("x.py",), ("srcc/b/x.py",)], "mention string")
    assert {(r.mention, r.path, r.tier) for r in Z.resolve_paths(said, files).collect()} >= {("lib/y.py", "lib/y.py", 0), ("a/x.py", "src/a/x.py", 1), ("y.py", "lib/y.py", 1), ("srcc/b/x.py", "src/b/x.py", 3)}
