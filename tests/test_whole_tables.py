"""Queries that SQL cannot express, held against plain programs over the whole tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import summary as S
from weftline.plans import QUERIES


@pytest.fixture(scope="module")
def graphs(sf_dir):
    """Edges (src, dst, weight) of every customer's graph."""
    rows = duckdb.sql(f"select o_custkey, 's' || l_suppkey % 20, 's' || l_partkey % 20, l_quantity from '{sf_dir}/orders.parquet' join '{sf_dir}/lineitem.parquet' on o_orderkey = l_orderkey where l_suppkey % 20 <> l_partkey % 20").fetchall()
    out: dict = {}
    for g, a, b, w in rows:
        out.setdefault(g, []).append((a, b, float(w)))
    return out


def listed(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.o_custkey, r.rank)):
        out.setdefault(r.o_custkey, []).append(r.node)
    return out


def test_topological_order(spark, sf_dir, graphs):
    want = {}
    for g, rows in graphs.items():
        left, open_edges, order = {x for a, b, _ in rows for x in (a, b)}, {(a, b) for a, b, _ in rows}, []
        while left:  # the fewest open predecessors, then the least name
            n = min(left, key=lambda x: (sum(b == x for _, b in open_edges), x))
            order.append(n)
            left.discard(n)
            open_edges = {(a, b) for a, b in open_edges if a != n}
        want[g] = order
    assert listed(QUERIES["graph_topo_order"](spark, sf_dir).collect()) == want


def test_best_first(spark, sf_dir, graphs):
    want = {}
    for g, rows in graphs.items():
        worth = lambda n, rows=rows: max([w for a, _, w in rows if a == n], default=0.0)
        found, order = [min(a for a, _, _ in rows)], []
        while len(order) < min(20, len(found)):
            n = min((x for x in found if x not in order), key=lambda x: (-worth(x), found.index(x)))
            order.append(n)
            found += [b for b in dict.fromkeys(b for _, b, _ in sorted((a, b, w) for a, b, w in rows if a == n)) if b not in found]
        want[g] = order
    assert listed(QUERIES["graph_best_first"](spark, sf_dir).collect()) == want


def test_rolling_retention(spark, sf_dir):
    want: dict = {}
    for user, i in duckdb.sql(f"select user_id, event_id from '{sf_dir}/events.parquet' order by user_id, ts, event_id").fetchall():
        kept = want.setdefault(user, [])
        if kept and i < kept[0]:
            kept.clear()
        kept.append(i)
        if len(kept) > 20:
            kept[:] = kept[:1] + kept[-9:]
    got = {r.user_id: r.kept for r in QUERIES["stream_condense"](spark, sf_dir).collect()}
    assert got == {u: ",".join(map(str, k)) for u, k in want.items()}


@pytest.mark.parametrize(("rows", "rounds"), [(0, 5), (1, 5), (2, 9), (7, 40), (5001, 30)])
def test_half_samples(spark, rows, rounds):
    """Against halves from a full sort of every round's hashes."""
    df = spark.range(rows).select("id", (F.col("id") % 3 == 0).alias("ok"), F.lit(1).alias("round"), F.lit(2).alias("k")).unionByName(spark.range(min(rows, 1)).select("id", F.lit(True).alias("ok"), F.lit(1).alias("round"), F.lit(2).alias("k")))
    n = df.count()
    each = df.crossJoin(spark.range(rounds).select(F.col("id").cast("int").alias("r"))).withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy(F.xxhash64("id", "r", F.lit(42)), "id", F.col("ok").cast("double"))))
    means = sorted(r.m for r in each.where(F.col("n") <= max(n // 2, 1)).groupBy("r").agg(F.avg(F.col("ok").cast("double")).alias("m")).collect())
    got = S.bootstrap_interval(df, "id", F.col("ok"), rounds).first()
    if not n:
        assert tuple(got) == (None, None, None)
        return
    assert tuple(got) == pytest.approx((means[int(rounds * 0.025)], np.mean(means), means[int(rounds * 0.975)]), abs=2e-6)


def test_half_samples_of_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    got = QUERIES["bootstrap_ci"](spark, sf_dir).first()
    assert got.low < share < got.high and abs(got.mean - share) < (got.high - got.low) / 10


def test_close_names(spark, sf_dir):
    from weftline.operators.fuzzy import close

    names = sorted({r[0] for r in duckdb.sql(f"select p_name from '{sf_dir}/part.parquet'").fetchall()})
    want = set()
    for q in {f"x {n}" for n in names}:
        found = sorted((-round(close(n.lower(), q.lower()), 6), n) for n in names)
        want |= {(q, n, -s, i + 1) for i, (s, n) in enumerate([x for x in found if -x[0] >= 0.8][:3])}
    assert {tuple(r) for r in QUERIES["close_names"](spark, sf_dir).collect()} == want


def test_paths_and_entities_by_all_tiers(spark, sf_dir):
    """Every mention that stands whole, by a unique end or base name comes back so; misspelled ones by the most similar."""
    from weftline.operators.fuzzy import close

    urls = duckdb.sql(f"select page_id, regexp_replace(url, '^[a-z]+://', '') || '.' || page_id || '.html' from '{sf_dir}/pages.parquet'").fetchall()
    paths = sorted({p for _, p in urls})
    want = set()
    for i, p in urls:
        base = p.rsplit("/", 1)[-1]
        mention = (p, "/".join(p.rsplit("/", 2)[-2:]) if p.count("/") >= 1 else "", base, p + "x")[i % 4]
        if mention in paths:
            want.add((mention, mention, 0))
            continue
        suffix = [x for x in paths if x.endswith("/" + mention) and x.rsplit("/", 1)[-1] == mention.rsplit("/", 1)[-1]]
        named = [x for x in paths if x.rsplit("/", 1)[-1] == mention.rsplit("/", 1)[-1]]
        if len(suffix) == 1:
            want.add((mention, suffix[0], 1))
        elif len(named) == 1:
            want.add((mention, named[0], 2))
        else:
            score, path = max(((round(close(x.lower(), mention.lower()), 6), [-ord(c) for c in x], x) for x in paths), default=(0, 0, ""))[::2]
            if score >= 0.82:
                want.add((mention, path, 3))
    assert {tuple(r) for r in QUERIES["resolved_paths"](spark, sf_dir).select("mention", "path", "tier").collect()} == want
    tiers = {r.tier for r in QUERIES["similar_entities"](spark, sf_dir).collect()}
    assert tiers == {0, 1, 2, 3, 4, 5}
