"""Places of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import cut


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills place: rows of a group follow each other, from w_carried on."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("w_group")
        fresh = np.ones(len(group), bool)
        fresh[1:] = pc.not_equal(group.slice(1), group.slice(0, len(group) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = group[0].as_py() != last
        at = np.arange(len(group))
        begun = np.maximum.accumulate(np.where(fresh, at, -1))
        inside = np.where(begun < 0, n + at, at - begun)
        last, n = group[-1].as_py(), int(inside[-1]) + 1
        place = inside + batch.column("w_carried").to_numpy(zero_copy_only=False)
        names = [c for c in batch.schema.names if c not in ("w_carried", "place")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(place, pa.int64())], names=[*names, "place"])


def numbered(df: DataFrame, group: Column, *order: Column) -> DataFrame:
    """df with w_group, a string that must not be null, and place, a row's number from 0 within its group, in the order stated.

    Ranges of the order over all groups are sorted and stored, so a group of any size is numbered by many tasks. What is
    broadcast has at most one row a range: only its first group can have rows in the ranges before it.
    """
    named = df.withColumn("w_group", group)
    stored = cut(named.repartitionByRange("w_group", *order).sortWithinPartitions("w_group", *order)).withColumn("w_range", F.spark_partition_id())
    before = Window.partitionBy("w_group").orderBy("w_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored.groupBy("w_range", "w_group").count().withColumn("w_carried", F.coalesce(F.sum("count").over(before), F.lit(0))).where("w_carried > 0").drop("count")
    joined = stored.join(F.broadcast(carried), ["w_range", "w_group"], "left").select(*named.columns, F.coalesce("w_carried", F.lit(0)).alias("w_carried"))
    schema = ", ".join(f"`{c}` {t}" for c, t in named.dtypes) + ", place long"
    return joined.mapInArrow(_count, schema)
