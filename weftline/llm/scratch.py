"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scan bytes for every file of a cut: what takes less is written by fewer tasks, as thousands of tiny files cost more than their rows.
FILE_BYTES = 32_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where no folder is named, a temporary one is set if the master is local (as in tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def free(name: str, taken: list[str]) -> str:
    """The name, with further underscores where it is taken."""
    while name in taken:
        name += "_"
    return name


def plain(docs: DataFrame, column: str) -> Column:
    """A column to hash or order rows by: what has no order of its own (maps, variants) counts by its JSON text."""
    c = F.col(f"`{column}`")
    return F.when(c.isNotNull(), F.to_json(F.struct(c))) if re.search("map<|variant", dict(docs.dtypes)[column]) else c


def set_apart(docs: DataFrame, id_cols: list[str], text_col: str, new: tuple[str, ...], run: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame | None:
    """run over docs with the id columns in one struct, where their names are those of columns it makes (w_row stands for whole rows); else None.

    The new columns then get further underscores.
    """
    if id_cols == ["w_ids"] or not any(c in new or c.startswith("w_") and not c.startswith("w_row") for c in id_cols):
        return None
    found = run(docs.select(F.struct(*(F.col(f"`{c}`") for c in id_cols)).alias("w_ids"), F.col(f"`{text_col}`").alias("w_own")), ["w_ids"], "w_own")
    made = [c for c in found.columns if c != "w_ids"]
    return found.select(*(F.col(f"w_ids.`{c}`").alias(c) for c in id_cols), *(F.col(c).alias(free(c, id_cols)) for c in made))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_for(docs: DataFrame) -> int:
    """How many files what is derived from docs should take at least: by the size of its scan, four a core if that is small."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE_BYTES), 1_000_000))


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """The same rows, read back from the shared folder; in no more than so many files, if given."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)
