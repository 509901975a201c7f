"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, form blocks. Block k (from 1) of a source of weight w is released at slot
floor((k - 1) / w) and due at slot ceil(k / w); in every slot the released block with the earliest deadline goes, so that
after t slots a source has had less than one block more or less than w * t. When a source has no block left, the others
go on with their weights in proportion, and their windows start anew (a phase); sources of weight 0 come after the rest.
Every document is placed exactly once.

The schedule is made in one task from the sources' counts alone and streams to the shared folder: blocks are as given
at every size, and memory grows with the sources, not with the slots. A phase costs time for all sources it has, so many
sources cost their square. Documents get their rank within the source from windows over hash buckets of about BUCKET
rows and the buckets' running counts, so that a source which holds a third of all rows is ranked in many tasks; their
slots come by bucket, too.

Defined results: null is a source of its own; a source that weights don't name has weight 0; ties between deadlines go
by the source's name (null first); equal rows take places in any order (as they share
a bucket, a row that repeats without bound is one task's); an empty table gives an empty result; all
columns are kept, and the new ones get a further underscore where the name is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import cut, free, plain

BUCKET = 2_000
#: Up to so many, sources are sent to all tasks; more are joined. Results are the same.
SENT_SOURCES = 4096
#: Slots of a batch that the schedule hands on.
BATCH = 20_000


def smoothed(counts: dict[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Weights by a power of the sources' sizes: below 1, small sources gain."""
    return {k: n**power for k, n in counts.items()}


def slots(blocks: dict[str | None, int], weights: dict[str | None, float]) -> Iterator[tuple[str | None, int, int]]:
    """(source, block from 0, phase) slot by slot."""
    order = {s: i for i, s in enumerate(sorted(blocks, key=lambda s: (s is not None, s or "")))}
    exact = {s: Fraction(weights.get(s) or 0).limit_denominator(10**9) for s in blocks}
    if min(exact.values(), default=0) < 0:
        raise ValueError("a weight is negative")
    left, taken, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    weighted = {s: exact[s] for s in left if exact[s]}
    whole = sum(weighted.values())
    while left:
        raw = weighted or {s: Fraction(n) for s, n in left.items()}
        total = whole if weighted else Fraction(sum(left.values()))
        # one over the share, as a fraction
        over = {s: (total.numerator * w.denominator, total.denominator * w.numerator) for s, w in raw.items()}
        ready = [(-(-a // b), order[s], s, 1) for s, (a, b) in over.items()]
        heapq.heapify(ready)
        waiting: list[tuple[int, int, str | None, int]] = []
        slot = 0
        while True:
            while waiting and (waiting[0][0] <= slot or not ready):
                _, i, s, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-k * over[s][0] // over[s][1]), i, s, k))
            _, i, s, k = heapq.heappop(ready)
            yield s, taken[s], phase
            taken[s] += 1
            left[s] -= 1
            slot += 1
            if not left[s]:
                del left[s]
                whole -= weighted.pop(s, 0)
                break
            heapq.heappush(waiting, (k * over[s][0] // over[s][1], i, s, k + 1))
        phase += 1


def schedule(blocks: dict[str | None, int], weights: dict[str | None, float]) -> list[tuple[str | None, int, int]]:
    """All of slots()."""
    return list(slots(blocks, weights))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", block: int = 16, seed: int = 42) -> DataFrame:
    """The rows with mix_slot, mix_phase and mix_position (from 0, without gaps); sort by the last to read the mixture.

    Without weights, they are the square roots of the sources' sizes.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    counts = cut(docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("s")).count())

    def place(parts):
        n = {s: k for batch in parts for s, k in zip(batch.column("s").to_pylist(), batch.column("count").to_pylist(), strict=True)}
        plan = slots({s: -(-k // block) for s, k in n.items()}, weights or smoothed(n))
        at = slot = 0
        while some := list(islice(plan, BATCH)):
            table = []
            for s, b, phase in some:
                table.append((None if s is None else f"={s}", b, slot, phase, at))
                slot, at = slot + 1, at + min(block, n[s] - b * block)
            columns = list(zip(*table, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in columns[0]], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["w_s", "w_b", "w_slot", "w_phase", "w_at"])

    plan = cut(counts.coalesce(1).mapInArrow(place, "w_s string, w_b long, w_slot long, w_phase long, w_at long"))
    buckets = counts.select(key(F.col("s")).alias("w_s"), F.ceil(F.col("count") / BUCKET).alias("w_n"))
    if counts.count() <= SENT_SOURCES:
        buckets = F.broadcast(buckets)

    row = free("w_row", docs.columns)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), key(F.col(f"`{source_col}`").cast("string")).alias("w_source"), F.xxhash64(F.lit(seed), *(plain(docs, c) for c in docs.columns)).alias("w_hash"))
    near = whole.join(buckets, F.col("w_source") == F.col("w_s")).select(row, "w_source", "w_hash", F.pmod("w_hash", "w_n").alias("w_bucket"))
    sums = Window.partitionBy("g_source").orderBy("g_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = near.groupBy(F.col("w_source").alias("g_source"), F.col("w_bucket").alias("g_bucket")).count().withColumn("w_before", F.coalesce(F.sum("count").over(sums), F.lit(0)))
    block_of = lambda c: F.floor(c / block)
    asked = before.select("g_source", "g_bucket", "w_before", F.explode(F.sequence(block_of(F.col("w_before")), block_of(F.col("w_before") + F.col("count") - 1))).alias("g_b"))
    told = asked.join(plan, (asked["g_source"] == plan["w_s"]) & (asked["g_b"] == plan["w_b"]))
    # a bucket's blocks follow each other: the slots of each, in order
    known = told.groupBy("g_source", "g_bucket").agg(F.min("w_before").alias("w_before"), F.array_sort(F.collect_list(F.struct("w_b", "w_slot", "w_phase", "w_at"))).alias("w_slots"))
    own = Window.partitionBy("w_source", "w_bucket").orderBy("w_hash")
    ranked = near.withColumn("w_own", F.row_number().over(own))
    placed = ranked.join(known, (ranked["w_source"] == known["g_source"]) & (ranked["w_bucket"] == known["g_bucket"])).select(row, "w_slots", "w_before", (F.col("w_before") + F.col("w_own") - 1).alias("w_rank"))
    mine = F.get("w_slots", (block_of(F.col("w_rank")) - block_of(F.col("w_before"))).cast("int"))
    found = placed.select(row, "w_rank", mine.alias("w_mine")).select(row, "w_rank", "w_mine.*")
    new = {free(k, docs.columns): v for k, v in (("mix_slot", F.col("w_slot")), ("mix_phase", F.col("w_phase")), ("mix_position", F.col("w_at") + F.col("w_rank") % block))}
    return found.select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns), *(v.alias(k) for k, v in new.items()))
