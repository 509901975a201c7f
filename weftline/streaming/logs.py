"""Live event logs with Structured Streaming: counts, deduplication, fan-out and rolling retention.

Each query takes a folder of Parquet files as they arrive. run() drives one to the end of what is there (availableNow)
and returns what it wrote. Offsets and state live in the checkpoint folder, so a restarted query goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events below a folder as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """E13. Running counts by key (complete or update mode)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """E14. The first row of every key. State grows with the keys: see first_seen_within for a bound."""
    return events.dropDuplicates(keys)


def first_seen_within(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """E14 with bounded state: keys are forgotten once the watermark has passed them."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Tumbling windows with a watermark: an extension of this library, as the logs themselves know no event time windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def rolling_retention(events: DataFrame, log: str, order: list[str], keep_first: int = 1, most: int = 20) -> DataFrame:
    """E07. log, kept: after each batch, the ids a log retains; beyond most, its first and so many last that half stays.

    State is at most most ids a log. A log whose ids start anew (its history shrank) starts anew.
    """
    import pandas as pd

    def condense(key, parts, state):
        kept = list(state.get[0]) if state.exists else []
        for pdf in parts:
            for i in pdf.sort_values(order)["event_id"]:
                if kept and i < kept[0]:
                    kept = []
                kept.append(int(i))
                if len(kept) > most:
                    tail = max(most // 2 - keep_first, 0)
                    kept = kept[:keep_first] + kept[len(kept) - tail :]
        state.update((kept,))
        yield pd.DataFrame({log: [key[0]], "kept": [kept]})

    kind = dict(events.dtypes)[log]
    return events.groupBy(log).applyInPandasWithState(condense, f"{log} {kind}, kept array<long>", "kept array<long>", "update", "NoTimeout")


def fan_out(events: DataFrame, subscribers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """E06. Every micro-batch goes to all subscribers, in order of their names; returns the started query."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name in sorted(subscribers):
            subscribers[name](batch, number)
        batch.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Everything available now, written batch by batch to the shared folder and read back.

    In complete mode the last batch stands, in append and update mode all batches do.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode(written).parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
