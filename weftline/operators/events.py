"""Queries over append-only event logs: filters, pages, pairing, retention, masking and loop detection.

Ids come from the producer and are never renumbered. Everything that looks at neighbours is a window over one log, so
logs are independent and spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X


def matching(events: DataFrame, id_col: str = "id", types: list[str] | None = None, without: list[str] | None = None, source: str | None = None, start=None, end=None, text: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """F12, F13, E03, E04. Events by type, source, inclusive times and ids, and a text anywhere in them in any case."""
    out = events
    if types is not None:
        out = out.where(F.col("event_type").isin(*types))
    if without:
        out = out.where(~F.col("event_type").isin(*without))
    if source is not None:
        out = out.where(F.col("source") == source)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    if first is not None:
        out = out.where(F.col(id_col) >= first)
    if last is not None:
        out = out.where(F.col(id_col) <= last)
    if text is not None:
        out = out.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))
    return out


def replay(events: DataFrame, id_col: str = "id") -> DataFrame:
    """F13. A forward replay stops at the first gap in the ids: after the least id that no next one follows."""
    ids = events.select(F.col(id_col).alias("w_id")).where("w_id is not null").distinct()
    ends = ids.join(ids.select((F.col("w_id") - 1).alias("w_id")), "w_id", "left_anti").agg(F.min("w_id").alias("w_end"))
    return events.crossJoin(F.broadcast(ends)).where(F.col(id_col) <= F.col("w_end")).drop("w_end")  # one row


def page(events: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """W23. The first events by id; 1 to 100 of them."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return events.orderBy(id_col).limit(limit)


def page_token(offset: Column) -> Column:
    """W22. An opaque token of an offset; null has none."""
    return F.base64(offset.cast("string").cast("binary"))


def token_offset(token: Column) -> Column:
    """W22. The offset in a token, 0 without one."""
    return F.coalesce(F.unbase64(token).cast("string").cast("long"), F.lit(0))


def append(log: DataFrame, new: DataFrame, key: str, order: list[Column], id_col: str = "id", text: str = "content", secrets: list[str] | None = None) -> DataFrame:
    """E01. New events with the ids that follow on their own log's (key) last one, in a stated order, and without secrets.

    An event that has an id already is an error. Logs are numbered apart, so nothing is ordered over all of them.
    """
    if id_col in new.columns:
        taken = F.raise_error(F.concat(F.lit("an event has an id already: "), F.col(id_col).cast("string"))).cast("boolean")
        new = new.where(F.when(F.col(id_col).isNull(), True).otherwise(taken)).drop(id_col)
    last = log.groupBy(key).agg(F.max(id_col).alias("w_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    numbered = new.withColumn("w_n", n).join(last, key, "left")
    return numbered.withColumn(id_col, F.coalesce("w_last", F.lit(-1)) + F.col("w_n")).withColumn(text, X.redact_secrets(F.col(text), secrets or [])).drop("w_n", "w_last")


def next_id(events: DataFrame, id_col: str = "id") -> DataFrame:
    """E02."""
    return events.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("next_id"))


def latest(events: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """E05. The event of the largest id for each key."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*rest), id_col).alias("e")).select(*by, "e.*")


def pairs(actions: DataFrame, observations: DataFrame) -> DataFrame:
    """J11. action_id and observation_id joined by cause (the last observation of each wins), unmatched ones with null."""
    last = observations.groupBy("cause").agg(F.max("id").alias("observation_id"))
    joined = actions.select(F.col("id").alias("action_id")).join(last, F.col("action_id") == F.col("cause"), "full_outer")
    return joined.select("action_id", "observation_id")


def head_tail(events: DataFrame, log: str, order: list[str], keep_first: int, most: int) -> DataFrame:
    """W17. The first keep_first and the last events of a log, so that no more than most stay; a tail may be empty."""
    tail = max(most - keep_first, 0)
    up = F.row_number().over(Window.partitionBy(log).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
    return events.withColumn("w_up", up).withColumn("w_down", down).where((F.col("w_up") <= keep_first) | (F.col("w_down") <= tail)).drop("w_up", "w_down")


def amortized(events: DataFrame, log: str, order: list[str], keep_first: int, most: int) -> DataFrame:
    """W17. A log longer than most shrinks to its first events and so many last ones that half of most stays."""
    n = F.count("*").over(Window.partitionBy(log))
    up = F.row_number().over(Window.partitionBy(log).orderBy(*order))
    tail = max(most // 2 - keep_first, 0)
    marked = events.withColumn("w_n", n).withColumn("w_up", up)
    return marked.where((F.col("w_n") <= most) | (F.col("w_up") <= keep_first) | (F.col("w_up") > F.col("w_n") - tail)).drop("w_n", "w_up")


def mask_old(events: DataFrame, log: str, order: list[str], window: int, masked: Column, column: str = "text", mark: str = "<MASKED>") -> DataFrame:
    """W18. Texts that meet a condition are masked outside a log's last events."""
    left = F.count("*").over(Window.partitionBy(log)) - F.row_number().over(Window.partitionBy(log).orderBy(*order))
    return events.withColumn(column, F.when((left >= window) & masked, mark).otherwise(F.col(column)))


def mask_type_tail(events: DataFrame, log: str, order: list[str], window: int, chosen: Column, column: str = "text", mark: str = "<MASKED>") -> DataFrame:
    """W19. Of the chosen events only the last ones stay readable."""
    nth = F.sum(chosen.cast("int")).over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
    return events.withColumn(column, F.when(chosen & (nth > window), mark).otherwise(F.col(column)))


def attention_fill(events: DataFrame, log: str, order: list[str], chosen: Column, most: int) -> DataFrame:
    """W20. Chosen events first, then the newest others, most in all."""
    rank = F.row_number().over(Window.partitionBy(log).orderBy(F.desc(chosen.cast("int")), *(F.desc(c) for c in order)))
    return events.withColumn("w_rank", rank).where(F.col("w_rank") <= most).drop("w_rank")


def all_similar(flags: DataFrame, log: str, order: list[str], flag: Column, size: int = 15) -> DataFrame:
    """W15. Where the last size flags of a log are all true."""
    w = Window.partitionBy(log).orderBy(*order).rowsBetween(-(size - 1), 0)
    return flags.withColumn("stop", F.every(flag).over(w) & (F.count("*").over(w) == size))


def same_last(events: DataFrame, log: str, order: list[str], values: list[str], n: int = 4) -> DataFrame:
    """E08, E09. log, stuck: whether its last n events exist and agree in every value."""
    down = F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
    last = events.withColumn("w_down", down).where(F.col("w_down") <= n)
    return last.groupBy(log).agg(((F.count("*") == n) & (F.count_distinct(*values) == 1)).alias("stuck"))


def repeated_error(actions: DataFrame, observations: DataFrame, log: str, order: list[str]) -> DataFrame:
    """E09. log, stuck: four actions and observations, the last three actions alike and the last three observations errors."""

    def last(df: DataFrame) -> DataFrame:
        down = F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
        return df.withColumn("d", down).where("d <= 4")

    a = last(actions).groupBy(log).agg((F.count("*") == 4).alias("enough"), (F.count_distinct(F.when(F.col("d") <= 3, F.col("value"))) == 1).alias("same"))
    o = last(observations).groupBy(log).agg((F.count("*") == 4).alias("seen"), F.coalesce(F.every(F.when(F.col("d") <= 3, F.col("is_error"))), F.lit(False)).alias("failing"))
    return a.join(o, log).select(log, (F.col("enough") & F.col("same") & F.col("seen") & F.col("failing")).alias("stuck"))


def monologue(events: DataFrame, log: str, order: list[str], spoken: Column, heard: Column, value: str, n: int = 3) -> DataFrame:
    """E10. log, stuck: its last n spoken events agree and nothing was heard between them."""
    w = Window.partitionBy(log).orderBy(*order)
    counted = events.withColumn("w_heard", F.count(F.when(heard, 1)).over(w)).where(spoken)
    down = F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
    last = counted.withColumn("w_down", down).where(F.col("w_down") <= n)
    return last.groupBy(log).agg(((F.count("*") == n) & (F.count_distinct(value) == 1) & (F.max("w_heard") == F.min("w_heard"))).alias("stuck"))


def alternating(events: DataFrame, log: str, order: list[str], value: str, n: int = 6) -> DataFrame:
    """E11. log, stuck: its last n events repeat with period two."""
    down = F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order)))
    last = events.withColumn("w_down", down).where(F.col("w_down") <= n)
    odd = lambda k: F.count_distinct(F.when(F.col("w_down") % 2 == k, F.col(value))) == 1
    return last.groupBy(log).agg(((F.count("*") == n) & odd(0) & odd(1)).alias("stuck"))


def adjacent_repeat(events: DataFrame, log: str, order: list[str], chosen: Column, n: int = 3) -> DataFrame:
    """E12. log, stuck: two of its last n chosen events stand side by side."""
    w = Window.partitionBy(log).orderBy(*order)
    placed = events.withColumn("w_at", F.row_number().over(w)).where(chosen)
    near = placed.withColumn("w_next", F.lead("w_at").over(w)).withColumn("w_down", F.row_number().over(Window.partitionBy(log).orderBy(*(F.desc(c) for c in order))))
    return near.where(F.col("w_down") <= n).groupBy(log).agg(F.coalesce(F.max(F.col("w_next") == F.col("w_at") + 1), F.lit(False)).alias("stuck"))
