"""Approximate matches over whole tables against all pairs."""

from __future__ import annotations

import pytest

from weftline.operators import fuzzy as Z
from weftline.plans import QUERIES


def all_pairs(names, queries, score, k, least):
    out = set()
    for q in set(queries):
        found = sorted((-round(score(q, n), 6), n) for n in set(names))
        out |= {(q, n, -s, i + 1) for i, (s, n) in enumerate([x for x in found if -x[0] >= least][:k])}
    return out


@pytest.mark.parametrize("name", ["fuzzy_token_set", "difflib_match"])
def test_whole_tables(spark, sf_dir, name):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").toPandas()
    if name == "fuzzy_token_set":
        want = all_pairs(p.p_name, p.p_brand + " " + p.p_type, Z.token_set, 3, 0.0)
    else:
        want = all_pairs(p.p_name.str.lower(), p.p_type.str.lower(), lambda q, n: Z.close(n, q), 3, 0.3)
    got = {(r["query"], r["name"], r["score"], r["rank"]) for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_nulls_and_ties(spark, block):
    names = ["abc", "abd", "abe", "ABC", "", "zzz", "ab", "abc"]
    queries = ["abx", "", "abc", "abx", "q"]
    df = lambda rows, c: spark.createDataFrame([(x, 1) for x in [*rows, None]], f"{c} string, score int")
    for least in (0.0, 0.5):
        found = Z.matches(df(names, "name").repartition(3), df(queries, "query"), Z.close, 2, least, Z.close_at_most, block)
        assert {tuple(r) for r in found.select("query", "name", "score", "rank").collect()} == all_pairs(names, queries, Z.close, 2, least)
    assert Z.matches(df([], "name"), df([], "query"), Z.close).count() == 0


@pytest.mark.parametrize("cutoff", [0.72, 0.8, 0.84, 0.95])
def test_close_matches_against_all_pairs(spark, cutoff):
    """Random texts from one to forty letters, copies with some letters changed, repeats, cases, nulls and empty texts."""
    import random

    rng = random.Random(int(cutoff * 100))
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 12, 20, 40)))) for _ in range(150)]

    def bent(text):
        out = list(text)
        for _ in range(rng.randrange(0, 2 + len(out) // 4)):
            i = rng.randrange(len(out) + 1)
            out[i : i + rng.choice((0, 1, 1))] = rng.choice(("", "x", "a"))
        return "".join(out)

    names, queries = [*base, "", "ABC", "abc", "aaaa"], [bent(rng.choice(base)) for _ in range(200)] + ["", "AbC", "aaaaa"]
    df = lambda rows, c: spark.createDataFrame([(x, 1) for x in [*rows, None]], f"{c} string, score int")
    found = Z.close_matches(df(names, "name"), df(queries, "query"), 3, cutoff)
    assert {tuple(r) for r in found.collect()} == all_pairs(names, queries, lambda q, n: Z.close(n.lower(), q.lower()), 3, cutoff)


def test_few_pairs_are_compared(spark, sf_dir):
    """Of all pairs of the documents' first words, those compared are few beside those that are truly similar."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lower(substring_index(text, ' ', 5)) as name").where("name <> ''").distinct()
    names = [r.name for r in d.collect()]
    pairs = Z.close_candidates(d, d.withColumnRenamed("name", "query"), 0.8).count()
    alike = sum(Z.close(a, b) >= 0.8 for a in names for b in names)
    assert alike <= pairs < alike + 0.05 * len(names) ** 2


def test_similarity_is_the_last_tier(spark):
    e = spark.createDataFrame([("m.parse_tokens", "parse_tokens"), ("m.other", "other")], "id string, name string")
    q = spark.createDataFrame([("parse_token",), ("other",), ("zzz",)], "query string")
    assert {tuple(r) for r in Z.entity_search(e, q).collect()} == {("parse_token", "m.parse_tokens", 5), ("other", "m.other", 2)}
    f = spark.createDataFrame([("src/lib/parser.py",), ("src/a/b.py",)], "path string")
    m = spark.createDataFrame([("src/lib/parsers.py",), ("b.py",), ("nothing",)], "mention string")
    assert {tuple(r) for r in Z.resolve_paths(m, f).collect()} == {("src/lib/parsers.py", "src/lib/parser.py", 3), ("b.py", "src/a/b.py", 1)}


def test_long_texts_meet_by_rare_places(spark):
    """Paths of one host, each misspelled once: those compared grow with the paths, not with their square."""
    paths = [f"blog.example.com/en/{i * 7919 % 100_003}.{i}.html" for i in range(600)]
    df = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    met = {tuple(r) for r in Z.close_candidates(df(paths, "name"), df([p + "x" for p in paths], "query"), 0.98).collect()}
    assert {(p + "x", p) for p in paths} <= met and len(met) < 3 * len(paths)


def test_ids_of_later_tiers_are_not_met(spark):
    """A query found by its id does not meet all ids of its last part's name."""
    e = spark.range(400).selectExpr("concat('m', id, '.run') as id", "'run' as name")
    found = Z.entity_search(e, e.selectExpr("id as query"), 1.1)
    assert {(r["query"], r["id"], r["tier"]) for r in found.collect()} == {(f"m{i}.run", f"m{i}.run", 0) for i in range(400)}
    metrics, open_ = [], [found._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        open_ += [node.children().apply(i) for i in range(node.children().size())]
        if hasattr(node, "finalPhysicalPlan") and node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.finalPhysicalPlan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            metrics.append(node.metrics().apply("numOutputRows").value())
    assert max(metrics, default=0) <= 5 * 400
