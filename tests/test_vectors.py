"""The stored vector index: rows equal to those of the search of all, cells skipped."""

from __future__ import annotations

import numpy as np
import pytest

from weftline.operators import retrieval as R
from weftline.operators import vectors as V


def rows(df):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def groups(spark):
    """Vectors in thirty tight groups, with repeats."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + 0.1 * rng.normal(size=(40, 16)) for c in centres] + [centres[:1]] * 25)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3).cache()


def asked(groups):
    return groups.where("doc_id % 11 = 0").withColumnRenamed("doc_id", "query_id")


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_same_rows(spark, groups, tmp_path, monkeypatch, k):
    monkeypatch.setattr(V, "PART", 16)
    index = V.VectorIndex.build(groups, str(tmp_path / "v"))
    assert rows(index.search(asked(groups), k)) == rows(R.dense(groups, asked(groups), k))


def test_cells_are_skipped(spark, groups, tmp_path):
    index = V.VectorIndex.build(groups, str(tmp_path / "v"))
    looked = index.visits(asked(groups), 5)[1].count()
    assert looked < 0.3 * len(index.cells) * asked(groups).count()


def test_unusable_vectors_and_empty_tables(spark, tmp_path):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1.0, 0.0], [0.0, 2.0], [3.0, 0.0]]
    v = spark.createDataFrame(list(enumerate(odd)), "doc_id long, vector array<double>")
    index = V.VectorIndex.build(v, str(tmp_path / "v"))
    assert rows(index.search(v.withColumnRenamed("doc_id", "query_id"), 3)) == [(5, 5, 1.0, 1), (5, 7, 1.0, 2), (6, 6, 1.0, 1), (7, 5, 1.0, 1), (7, 7, 1.0, 2)]
