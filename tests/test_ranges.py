"""Orders of all rows without a task that sees them all, and replays up to the first gap."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import events as E
from weftline.operators import rank as K


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_ranked(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice((None, 0.0, 1.0, 2.0, rng.random())), i) for i in range(n)]
    df = spark.createDataFrame(rows, "score double, id long").repartition(5)
    got = K.ranked(df, F.desc_nulls_last("score"), F.col("id")).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0.0), r[1]))
    assert [(r.score, r.id, r["rank"]) for r in got] == [(*r, k + 1) for k, r in enumerate(want)]


@pytest.mark.parametrize(("ids", "kept"), [([], []), ([5], [5]), ([3, 1, 2, 5, 6, None], [1, 2, 3]), ([1, 1, 2, 4], [1, 1, 2]), (list(range(50)), list(range(50)))])
def test_replay(spark, ids, kept):
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, w_end string")
    assert sorted(r.id for r in E.replay(df.drop("w_end")).collect()) == kept
