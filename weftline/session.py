"""SparkSession factory and the few settings that every entry point shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "weftline", cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on: under spark-submit, of its master and shuffle partitions, else a local one."""
    builder = SparkSession.builder.appName(app)
    if not _submitted():
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", "8g")
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _submitted() -> bool:
    """Whether spark-submit has started this program, and has thus named a master."""
    return "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or bool(os.environ.get("MASTER")) or "SPARK_ENV_LOADED" in os.environ and "PYSPARK_GATEWAY_PORT" in os.environ


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; where none is named, a temporary one that goes at exit, on a local master only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if (sc.master or "").split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df):
    """The same rows with their lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """df over at least as many partitions as there are cores: only inputs of fewer (small files) are dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df
