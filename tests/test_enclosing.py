"""Nearest enclosing intervals by a scan of ranges, against all pairs."""

from __future__ import annotations

import random

import pytest

from weftline.operators import code as C
from weftline.operators.intervals import enclosing, reaching

_SCHEMA = "id long, thread string, start long, end long"


def _by_pairs(rows):
    for i, t, a, b in rows:
        if i is None or a is None or b is None or b < a:
            continue
        around = [(y - x, -x, j) for j, u, x, y in rows if None not in (j, x, y) and u == t and x <= a and b <= y and y - x > b - a]
        yield i, min(around)[2] if around else None, len(around)


@pytest.mark.parametrize("size", [8, 64, 1 << 20])
def test_against_all_pairs(spark, size):
    """Crossing, equal, empty and broken intervals; one thread has most of them."""
    rng = random.Random(size)
    rows = []
    for i in range(900):
        start, long = rng.randrange(400), rng.choice((0, 1, 3, 20, 300))
        rows.append((i, rng.choice(("hot", "hot", "hot", "b", None)), start, start + rng.randrange(long + 1)))
    rows += [(1000, "hot", None, 3), (1001, "hot", 5, None), (1002, "hot", 9, 2), (1003, "hot", -5, 5000), (1004, "hot", -5, 5000)]
    got = enclosing(spark.createDataFrame(rows, _SCHEMA).repartition(7), "thread", size).collect()
    assert sorted(tuple(r) for r in got) == sorted(_by_pairs(rows))


def test_no_intervals(spark):
    assert enclosing(spark.createDataFrame([], _SCHEMA), "thread").collect() == []


def test_names_as_ids(spark):
    rows = [("a", "t", 0, 9), ("b", "t", 1, 4), ("c", "t", 1, 4), ("d", "t", 2, 2)]
    got = enclosing(spark.createDataFrame(rows, "id string, thread string, start long, end long"), "thread").collect()
    assert sorted(tuple(r) for r in got) == [("a", None, 0), ("b", "a", 1), ("c", "a", 1), ("d", "b", 3)]


def test_rows_of_one_thread_grow_linearly(spark, monkeypatch):
    """40,000 calls nested 200 deep in one thread: what is scanned is the calls and, a range, what is open there."""
    rows = spark.createDataFrame([(200 * k + d, "t", 1000 * k + d, 1000 * k + 999 - d) for k in range(200) for d in range(200)], _SCHEMA)
    n = 40_000
    assert n <= reaching(rows, "thread", 4096).count() <= n + 200 * (2 * n // 4096 + 1)
    got = {r.id: (r.parent, r.depth) for r in enclosing(rows, "thread", 4096).collect()}
    assert len(got) == n and all(v == (None if i % 200 == 0 else i - 1, i % 200) for i, v in got.items())


def test_events_without_a_time(spark):
    rows = [(1, 1, 1, 0.0, 9.0, "a"), (2, 1, 1, None, 5.0, "b"), (3, 1, 1, 4.0, -1.0, "c"), (4, None, None, 4.0, 1.0, "d"), (5, None, None, 4.0, 1.0, "e")]
    got = {r.id: (r.parent, r.depth) for r in C.call_tree(spark.createDataFrame(rows, "id long, pid int, tid int, ts double, dur double, name string")).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (None, 0), 5: (None, 0)}
