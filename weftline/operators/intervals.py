"""Joins and merges of inclusive integer intervals.

Spark has no interval join: intervals are entered into every bucket of a fixed width that they touch, so that points and
intervals meet by an equi-join on (group, bucket) and a filter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.operators.rank import numbered

#: Bounds of intervals in one range of a scan.
RANGE = 8192


def _entered(intervals: DataFrame, width: int) -> DataFrame:
    return intervals.withColumn("w_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def containing(points: DataFrame, intervals: DataFrame, group: str, width: int = 64) -> DataFrame:
    """J07. Points (group, at) with the intervals (group, start, end) that hold them."""
    p = points.withColumn("w_bucket", F.floor(F.col("at") / width))
    return p.join(_entered(intervals, width), [group, "w_bucket"]).where("start <= at and at <= end").drop("w_bucket")


def innermost(points: DataFrame, intervals: DataFrame, group: str, key: list[str], width: int = 64) -> DataFrame:
    """J08. Of the intervals that hold a point (by its key) the narrowest, then the first by (start, pos)."""
    found = containing(points, intervals, group, width)
    w = Window.partitionBy(*key).orderBy(F.col("end") - F.col("start"), "start", "pos")
    return found.withColumn("w_n", F.row_number().over(w)).where("w_n = 1").drop("w_n")


def parents(intervals: DataFrame, group: str, width: int = 64) -> DataFrame:
    """J09, J10. Every interval (id) with the narrowest other one that strictly contains it, or null.

    The later start, then the smaller id, wins among equally narrow ones.
    """
    inner = intervals.select(group, F.col("id").alias("i_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.floor(F.col("start") / width).alias("w_bucket"))
    pairs = inner.join(_entered(intervals, width), [group, "w_bucket"])
    strict = (F.col("start") <= F.col("i_start")) & (F.col("i_end") <= F.col("end")) & (F.col("end") - F.col("start") > F.col("i_end") - F.col("i_start"))
    best = pairs.where(strict).groupBy("i_id").agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), -F.col("start"), "id")).alias("parent"))
    return intervals.join(best, intervals["id"] == best["i_id"], "left").select(intervals["*"], "parent")


def enclosing(intervals: DataFrame, group: str, size: int = RANGE) -> DataFrame:
    """J10, G21. id, parent, depth of intervals (id, group, start, end: long), whose ids are distinct.

    The parent is the narrowest interval of the group that strictly contains one (ties as in `parents`), or null; the depth
    counts all that do. Intervals may cross. Those with a null bound or id, or that end before they start, are in no result.

    All openings and closings are numbered in one order, group after group, and cut into ranges of so many; each range is
    scanned with a stack of what is open at its start. An interval is one row for each range that it reaches into, so the
    rows grow with the intervals and, for each range, with the depth at its border; a group may be of any size.
    """
    rows = reaching(intervals, group, size)
    kind = intervals.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("parent", kind), StructField("depth", LongType())])

    def scan(pdf):
        import pandas as pd

        pdf = pdf.assign(w_back=-pdf["end"]).sort_values(["w_group", "start", "w_back", "id"], na_position="first")
        mine = pdf["w_own"] == pdf["w_cell"]
        found = list(_scanned(zip(pdf["w_group"].astype(object).where(pdf["w_group"].notna(), None), pdf["start"], pdf["end"], pdf["id"], mine)))
        return pd.DataFrame(found, columns=["id", "parent", "depth"]).astype({"parent": object})

    return rows.groupBy("w_cell").applyInPandas(scan, schema)


def reaching(intervals: DataFrame, group: str, size: int = RANGE) -> DataFrame:
    """Intervals (id, w_group, start, end), once for each range (w_cell) that they reach into from their own (w_own)."""
    own = intervals.select("id", F.col(group).alias("w_group"), "start", "end").where("id is not null and start <= end")
    at = lambda bound, close: own.select("*", F.col(bound).alias("w_at"), F.lit(close).alias("w_close"))
    # of one moment, openings come before closings, and longer intervals open before shorter ones
    order = [F.col("w_group"), F.col("w_at"), F.col("w_close"), F.desc("end"), F.col("id")]
    points = numbered(at("start", 0).unionByName(at("end", 1)), *order).withColumn("w_cell", F.floor((F.col("w_rank") - 1) / size))
    spans = points.groupBy("id", "w_group", "start", "end").agg(F.min("w_cell").alias("w_own"), F.max("w_cell").alias("w_last"))
    return spans.select("id", "w_group", "start", "end", "w_own", F.explode(F.sequence("w_own", "w_last")).alias("w_cell"))


def _scanned(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(id, parent, depth) of the asked among (group, start, end, id, asked), sorted by group, start, longest and id."""
    group, open_ = object(), []  # (end, -start, id) of what is open, by end
    for here, start, end, name, asked in rows:
        if here != group:
            group, open_ = here, []
        del open_[: bisect_left(open_, (start,))]
        if asked:
            first = bisect_left(open_, (end, 1 - start))  # behind those that end before, and behind equal intervals
            best = None
            for e, s, i in open_[first:]:
                if best and e - start > best[0]:  # no later one is as narrow: all have started by now
                    break
                best = min(best or (e + s, s, i), (e + s, s, i))
            yield name, best[2] if best else None, len(open_) - first
        insort(open_, (end, -start, name))


def merge(intervals: DataFrame, group: str) -> DataFrame:
    """W13. Disjoint unions of intervals that overlap or touch at a point; n and n + 1 stay apart."""
    order = Window.partitionBy(group).orderBy("start", "end")
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(furthest.isNull() | (F.col("start") > furthest), 1).otherwise(0)
    islands = intervals.select(group, "start", "end", fresh.alias("w_fresh")).withColumn("w_island", F.sum("w_fresh").over(order))
    return islands.groupBy(group, "w_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("w_island")


def context_windows(lines: DataFrame, group: str, around: int = 20) -> DataFrame:
    """W14. Windows of so many lines around each line, within [1, last], merged."""
    return merge(lines.select(group, F.greatest(F.lit(1), F.col("line") - around).alias("start"), F.least("last", F.col("line") + around).alias("end")), group)
