"""Blocks keep their size, and sources their number, however large the input."""

from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import mixing


def test_many_slots_and_sources(spark):
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"))
    rows = mixing.mix(docs, block=1).collect()
    n = Counter(r.source for r in rows)
    plan = mixing.schedule(dict(n), mixing.smoothed(n))
    assert len(rows) == 120_000
    assert all(r.mix_slot == r.mix_position for r in rows)
    assert {(r.mix_slot, r.source, r.mix_phase) for r in rows} == {(t, s, p) for t, (s, _, p) in enumerate(plan)}


def test_more_sources_than_are_sent(spark):
    docs = spark.range(4_200).select(F.col("id").alias("doc_id"), F.format_string("s%04d", F.col("id") % 4_100).alias("source"))
    rows = sorted(mixing.mix(docs, block=16).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in rows] == list(range(4_200))
    assert Counter(Counter(r.mix_slot for r in rows).values()) == {1: 4_000, 2: 100}
    assert {r.source for r in rows[:200]} == {f"s{i:04d}" for i in range(100)}
