"""Votes, deduplication, capped selection and other ranking utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W02, U05. The first row of each key in a stated order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("w_n", n).where("w_n = 1").drop("w_n")


def min_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """A22. The row of the least score of each key, by tie among equals; one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(score, tie)).alias("w_row")).select(*keys, *(F.col(f"w_row.{c}").alias(c) for c in rest))


def vote(lists: DataFrame, key: str, sample: str, items: str, method: str = "majority") -> DataFrame:
    """A18, A19. key, item, weight, rank: counts of items over sample lists, or sums of 1 / place; ties by first seen."""
    each = lists.select(key, sample, F.posexplode(items).alias("pos", "item"))
    weight = F.count("*").cast("double") if method == "majority" else F.round(F.sum(1.0 / (F.col("pos") + 1)), 6)
    summed = each.groupBy(key, "item").agg(weight.alias("weight"), F.min(F.struct(sample, "pos")).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "first")
    return summed.withColumn("rank", F.row_number().over(order)).drop("first")


def gated_vote(patches: DataFrame) -> DataFrame:
    """A20. instance, pick of (instance, idx, key, regression_failures, reproduced): the most frequent key among the patches
    with least regression failures of all, reproduced ones if there are any; blank ones go after the least is taken. Ties
    by first index, then key."""
    own = Window.partitionBy("instance")
    least = patches.withColumn("least", F.min("regression_failures").over(own)).where("regression_failures = least")
    best = least.where(F.trim("key") != "")
    some = best.withColumn("any", F.max(F.col("reproduced").cast("int")).over(own)).where((F.col("any") == 0) | F.col("reproduced"))
    counted = some.groupBy("instance", "key").agg(F.count("*").alias("votes"), F.min("idx").alias("first"))
    return counted.groupBy("instance").agg(F.min_by("key", F.struct(-F.col("votes"), F.col("first"), F.col("key"))).alias("pick"), F.max("votes").alias("votes"))


def priority_limit(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """W04. The first rows of each key by several keys of order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def capped_roles(targets: DataFrame, key: str, order: list[Column], primaries: int = 2, most: int = 5) -> DataFrame:
    """W05. Primaries beyond a number become secondary; so many rows stay in all."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = F.sum((F.col("role") == "primary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    role = F.when((F.col("role") == "primary") & (seen > primaries), "secondary").otherwise(F.col("role"))
    return targets.select("*", role.alias("new_role"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with w_rank (long), from 1 in an order of all rows: by ranges of it, so no task sees more than a range.

    The ranges are stored first, as their borders come from samples; what goes over one task is a count for each range.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("w_range", F.spark_partition_id()))
    counts = placed.groupBy("w_range").count()
    before = counts.select("w_range", (F.sum("count").over(Window.orderBy("w_range")) - F.col("count")).alias("w_before"))
    inside = F.row_number().over(Window.partitionBy("w_range").orderBy(*order))
    return placed.withColumn("w_in", inside).join(F.broadcast(before), "w_range").withColumn("w_rank", F.col("w_before") + F.col("w_in")).drop("w_range", "w_before", "w_in")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank (int), from 1 in an order of all rows, numbered by ranges."""
    return numbered(df, *order).withColumn("rank", F.col("w_rank").cast("int")).drop("w_rank")


def promoted_order(actions: DataFrame, action: str, priority: str, order: str) -> DataFrame:
    """W11. Distinct actions by the larger of priority and frequency, earlier first on ties."""
    n = actions.groupBy(action).agg(F.count("*").alias("n"), F.max(priority).alias("p"), F.min(order).alias("first"))
    return ranked(n.select(action, F.greatest("n", "p").alias("value"), "first"), F.desc("value"), F.col("first"))


def best_format(results: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """W12. Of each key the most complete format, and the queries that found it."""
    place = F.lit(len(ranks))
    for name, n in ranks.items():
        place = F.when(F.col("format") == name, n).otherwise(place)
    return results.groupBy(key).agg(F.min_by("format", place).alias("format"), F.array_sort(F.collect_set("query")).alias("queries"))


def threshold_or_first(scored: DataFrame, key: str, score: str, least: float = 75, most: int = 3) -> DataFrame:
    """W10. Rows above a score, the best few; if no more than that pass, only the best."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "item")
    kept = scored.where(F.col(score) > least).withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return kept.where(F.col("rank") <= F.when(F.col("n") <= most, 1).otherwise(most)).drop("n")
