"""The stored index: rows equal to those of the unstored search, batches, bounds and plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import retrieval as R
from weftline.operators.index import PostingIndex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60))), f"g{i % 3}") for i in range(1500)]
    rows += [(1500, None, "g0"), (1501, "", None), (1502, "snakeCase_word w1 w1 w1 w299", "g1")]
    return spark.createDataFrame(rows, "doc_id long, text string, g string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w299 w250"), (2, "w0 w1 w2"), (3, "case w299 w299 w299 w299"), (4, "none"), (5, ""), (6, None)], "query_id long, text string")


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    return PostingIndex.build(docs.where("doc_id < 700"), path, ("g",), buckets=8).append(docs.where("doc_id >= 700"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_same_rows(docs, queries, stored, k):
    assert rows(stored.search(queries, k)) == rows(R.bm25(docs, queries, k)) == rows(R.bm25(stored, queries, k))


def test_parts_and_cascade(docs, queries, stored):
    split = queries.crossJoin(docs.select("g").distinct()).select(F.concat_ws("/", "query_id", "g").alias("query_id"), "text", "g")
    assert rows(R.bm25(stored, split, 5, within="g")) == rows(R.bm25(docs, split, 5, within="g"))
    assert rows(R.cascade(stored, queries, "g", pool=2, k=7)) == rows(R.cascade(docs, queries, "g", pool=2, k=7))


def test_ranges_below_the_kth_score_are_skipped(queries, stored):
    ranges = stored.blocks().select("range").distinct().count()
    _, kept = stored.surviving(queries.where("query_id in (1, 3)"), 3)
    assert 0 < kept.count() < ranges  # of two times as many pairs


def test_repeated_ids(spark, docs, queries, tmp_path):
    """An id in two batches is one document by its scores, as in the unstored search."""
    some = docs.where("doc_id < 100")
    again = some.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" w299")))
    stored = PostingIndex.build(some, str(tmp_path / "i")).append(again)
    assert not stored.single
    assert rows(stored.search(queries, 10)) == rows(R.bm25(some.unionByName(again), queries, 10))


def test_a_batch_counts_once_it_is_whole(spark, docs, queries, stored, tmp_path):
    path = str(tmp_path / "i")
    some = docs.where("doc_id < 50")
    half = PostingIndex.build(some, path)
    docs.where("doc_id = 60").select(F.lit("w1").alias("term"), F.lit(0).cast("long").alias("range")).write.parquet(f"{path}/blocks/batch=1/bucket=1")
    assert rows(half.search(queries, 5)) == rows(R.bm25(some, queries, 5))
    more = docs.where("doc_id between 50 and 90")
    assert rows(half.append(more).search(queries, 5)) == rows(R.bm25(some.unionByName(more), queries, 5))


def test_an_empty_corpus(spark, docs, queries, tmp_path):
    stored = PostingIndex.build(docs.where("false"), str(tmp_path / "i"))
    assert rows(stored.search(queries, 3)) == []


def test_no_tokens_move(queries, stored):
    """A search reads blocks, tokenises the queries only, and reads folders of its own buckets only."""
    plan = stored.search(queries.where("query_id = 1"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert "bucket" in plan and "PartitionFilters: [" in plan


def test_hits_do_not_move(queries, stored):
    """Blocks move to their ranges: neither the weights of all pairs nor the hits go through an exchange."""
    plan = stored.search(queries, 3)._jdf.queryExecution().executedPlan().toString()
    moves = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert any("range" in m for m in moves) and not any("doc_id" in m or "range" in m and "," in m.rsplit(",", 1)[0] for m in moves), moves


def test_postings_do_not_move(spark, docs, tmp_path, monkeypatch):
    """A batch moves texts to ranges and blocks to buckets, nothing by term."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    PostingIndex.build(docs.where("doc_id < 90"), str(tmp_path / "i"), ("g",), buckets=4)
    moves = [line.split("hashpartitioning(")[1].split(")")[0] for line in plans[0].split("\n") if "Exchange hashpartitioning" in line]
    assert len(moves) == 2 and sum("bucket" in m for m in moves) == 1 and not any("term" in m for m in moves), moves


def test_appended_postings_do_not_move(docs, tmp_path, monkeypatch):
    """the number of a batch is in the range by which texts move, so a batch appended moves no more than the first."""
    from pyspark.sql.readwriter import DataFrameWriter

    stored = PostingIndex.build(docs.where("doc_id < 30"), str(tmp_path / "i"), buckets=4)
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    both = stored.append(docs.where("doc_id between 30 and 80"))
    assert plans[0].count("Exchange hashpartitioning") == 2
    assert {r[0] >> 48 for r in both.blocks().select("range").collect()} == {0, 1}


def test_blocks_move_as_pages_of_numbers(docs, stored, tmp_path, monkeypatch):
    """a posting is one number; a task sends a page a bucket, not a row a block."""
    from pyspark.sql.readwriter import DataFrameWriter

    assert dict(stored.blocks().dtypes)["postings"] == "array<int>"
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    PostingIndex.build(docs.where("doc_id < 30"), str(tmp_path / "i"), buckets=4)
    exchange = next(line for line in plans[0].split("\n") if "Exchange hashpartitioning(bucket" in line)
    below = plans[0].split("\n")[plans[0].split("\n").index(exchange) + 1]
    assert "MapInArrow" in below and "page" in below


def test_scores_of_a_stored_cascade_stay_in_their_range(docs, queries, stored):
    """documents are scored where their blocks arrive, no posting moves by document."""
    plan = R.cascade(stored, queries, "g", pool=2, k=7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(query_id" in plan
    assert re.search(r"keys=\[range#\d+L, query_id#\d+L, doc_id#\d+L\]", plan)


def test_ranges_are_of_one_part(spark, tmp_path):
    """documents of a part lie beside each other, so that a term's postings are in as few blocks as without parts."""
    rows = spark.range(640, numPartitions=1).selectExpr("id as doc_id", "'same words' as text", "id % 5 as g").coalesce(1)
    made = PostingIndex.build(rows.repartition(8), str(tmp_path / "i"), ("g",), buckets=4).blocks(spark.createDataFrame([("same",)], "term string"))
    assert made.agg(F.sum("df")).first()[0] == 640 and made.count() <= 8 * 8
