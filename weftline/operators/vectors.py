"""A stored vector index whose top-k is exact.

Vectors lie in cells around centroids, which are fit on a bounded sample (SAMPLE rows in the mean, SAMPLE_BYTES of them), a
folder cell=<n> each, with the widest angle of a cell's vectors from its centroid beside. Angles keep the triangle
inequality: no vector of a cell is nearer to a query than the query's angle with the centroid less that width. So a search
looks into the nearest cells first, and then into those only that can hold a better vector than the k-th of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut

CELLS, SAMPLE, SAMPLE_BYTES = 1024, 32_768, 64_000_000
#: Vectors, and queries, that a task compares at a time.
PART = 4096
_SLACK = 2e-6  # scores count at six decimals


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors (not null, no nulls, finite, not zero) and these at length 1."""
    lists = column.to_pylist()
    good = [i for i, v in enumerate(lists) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    if not good:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    x = np.array([lists[i] for i in good], np.float64)
    return np.array(good), x / np.linalg.norm(x, axis=1)[:, None]


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def _fit(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from the first rows, which are in a random order."""
    centre = x[:cells].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centre = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], centre)
    return centre


class VectorIndex:
    """Vectors (doc_id, unit, part) in cells and the cells' centroids, under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # CELLS at most
        self.cells = [r.cell for r in rows]
        self.centroids = np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1)
        self.widths, self.sizes = np.array([r.width for r in rows], np.float64), np.array([r.n for r in rows], np.int64)

    @classmethod
    def build(cls, vectors: DataFrame, path: str) -> VectorIndex:
        """An index of (doc_id, vector), all vectors of one length; those that are null or zero, or hold nulls or what is not
        finite, score with nothing and are left out."""
        source = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
        n, most = source.agg(F.count("*"), F.max(F.size("vector"))).first()
        cells = max(1, min(CELLS, round(math.sqrt(n))))
        wanted = max(1, min(SAMPLE, 32 * cells, SAMPLE_BYTES // (8 * max(most or 1, 1))))
        chosen = source.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, wanted / max(n, 1)) * (1 << 30)))
        sample = chosen.select("vector", F.xxhash64(F.lit(1), "vector").alias("place")).distinct().toArrow().sort_by("place")
        _, x = _units(sample.column("vector"))
        centroids = _fit(x, min(cells, max(1, len(x) // 8))) if len(x) else np.zeros((1, most or 1))

        def place(batches):
            for batch in batches:
                rows, x = _units(batch.column("vector"))
                if len(rows):
                    angle = _angles(x, centroids)
                    cell = angle.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], names=["doc_id", "unit", "cell", "angle"])

        kind = dict(vectors.dtypes)["doc_id"]
        placed = cut(source.mapInArrow(place, f"doc_id {kind}, unit array<double>, cell int, angle double"))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"))
        parts = F.ceil(F.col("n") / PART).cast("int")
        dealt = placed.join(F.broadcast(sizes.select("cell", parts.alias("parts"))), "cell").select("doc_id", "unit", "cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))  # a row a cell
        dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
        spark = vectors.sparkSession
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        sizes.join(known, "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """R04, R06. query_id, doc_id, score, rank of the nearest vectors by cosine, above 0, for (query_id, vector)."""
        return self.visits(queries, k)[0]

    def visits(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What search() returns, and the cells that it looked into: query_id, cell, nearest (whether in the first round)."""
        from weftline.operators.retrieval import top_k

        kind = dict(queries.dtypes)["query_id"]
        cells, centroids, widths, sizes = self.cells, self.centroids, self.widths, self.sizes

        def bound(batches):
            for batch in batches:
                rows, x = _units(batch.column("vector"))
                if not len(rows) or not len(cells):
                    continue
                most = np.cos(np.maximum(_angles(x, centroids) - widths - 1e-9, 0))  # what a vector of the cell can score
                order = np.argsort(-most, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                near = np.zeros(most.shape, bool)
                np.put_along_axis(near, order, before < k, 1)
                q, c = np.nonzero(most + _SLACK > 0)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows[q])), pa.array(np.array(cells)[c], pa.int32()), pa.array(most[q, c]), pa.array(near[q, c])], names=["query_id", "cell", "most", "near"])

        bounds = cut(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(bound, f"query_id {kind}, cell int, most double, near boolean"))
        order = [F.desc("score"), F.col("doc_id")]
        first = cut(top_k(self._met(queries, bounds.where("near"), k), k, order))
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        more = bounds.where("not near").join(least, "query_id", "left").where(F.col("most") + _SLACK >= F.coalesce("least", F.lit(0.0)))
        more = cut(more.select("query_id", "cell", F.lit(False).alias("nearest")))
        looked = bounds.where("near").select("query_id", "cell", F.lit(True).alias("nearest")).unionByName(more)
        return top_k(first.drop("rank").unionByName(self._met(queries, more, k)), k, order), looked

    def _met(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score: the k best of each cell that a pair (query_id, cell) names."""
        stored = self.spark.read.parquet(f"{self.path}/vectors")
        kinds = dict(queries.dtypes) | dict(stored.dtypes)
        blocks = max(1, -(-queries.count() // PART))
        asked = pairs.select("query_id", "cell").join(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "query_id")
        parts = stored.select("cell", "part").distinct().withColumnRenamed("cell", "c")
        asked = asked.join(parts, F.col("cell") == F.col("c")).drop("c").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        tiles = asked.select(F.col("cell").alias("t_cell"), F.col("part").alias("t_part"), F.col("block").alias("t_block")).distinct()
        again = self.spark.read.parquet(f"{self.path}/vectors")
        homes = again.join(tiles, (F.col("cell") == F.col("t_cell")) & (F.col("part") == F.col("t_part"))).select("doc_id", "unit", "t_cell", "t_part", "t_block")  # cells that no query visits are not moved

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            rows, q = _units(left.column("vector").combine_chunks())
            ids, docs = left.column("query_id").combine_chunks().take(pa.array(rows)), right.column("doc_id").combine_chunks()
            units = np.array(right.column("unit").to_pylist(), np.float64)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at in range(0, len(q) if len(units) else 0, 256):
                score = np.round(q[at : at + 256] @ units.T, 6)
                if score.shape[1] > k:  # all that reach the k-th score, ties too
                    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    a, b = np.nonzero((score >= edge[:, None]) & (score > 0))
                else:
                    a, b = np.nonzero(score > 0)
                found.append((a + at, b, score[a, b]))
            a, b, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"query_id": ids.take(pa.array(a)), "doc_id": docs.take(pa.array(b)), "score": pa.array(score)})

        keys = ["cell", "part", "block"]
        return asked.groupBy(*keys).cogroup(homes.groupBy("t_cell", "t_part", "t_block")).applyInArrow(lambda a, b: best(a, b), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
