"""Rollups, descriptions, distributions and cost summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, spread


def merge_metrics(parts: DataFrame, keys: list[str], summed: list[str], most: list[str]) -> DataFrame:
    """A16. Metrics of several runs as one: sums and maxima, so that merging merged ones gives the same."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in summed), *(F.max(c).alias(c) for c in most))


def most_common(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """A04, A08. key and count, largest first, ties by key; all or the first n."""
    counted = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return counted if n is None else counted.limit(n)


def guarded_mean(value: Column, digits: int = 4) -> Column:
    """A07. Mean, 0 of nothing."""
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A09. count, mean, sample deviation, minimum, linear quartiles and maximum."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("max"))


def binned(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """A10. Rows in each right-closed bin (edges[i], edges[i + 1]]; bins without rows are listed, too."""
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_ = F.when((F.col(value) > edges[i]) & (F.col(value) <= edges[i + 1]), i).otherwise(bin_)
    counted = df.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, above double, upto double")
    return every.join(counted, "bin", "left").select("bin", "above", "upto", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, by: str, value: str) -> DataFrame:
    """A11. Share of each group's rows at or below each of its values: counts first, so the window sees distinct values."""
    counted = df.groupBy(by, value).agg(F.count("*").alias("w_n"))
    run = Window.partitionBy(by).orderBy(value)
    return counted.select(by, value, F.round(F.sum("w_n").over(run) / F.sum("w_n").over(Window.partitionBy(by)), 6).alias("share"))


def rollup_rates(df: DataFrame, levels: list[str], flag: Column) -> DataFrame:
    """A12. count, hits and rate at every prefix of the levels, the total included."""
    return df.rollup(*levels).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"), F.round(F.count_if(flag) / F.count("*"), 6).alias("rate"))


def run_summary(df: DataFrame, flags: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """A13. Counts and percentages (of all rows) of flags, and means, in one pass."""
    out = [F.count("*").alias("total")]
    for k, v in flags.items():
        out += [F.count_if(v).alias(k), F.round(100 * F.count_if(v) / F.count("*"), 2).alias(f"{k}_pct")]
    return df.agg(*out, *(F.round(F.avg(v), 4).alias(k) for k, v in means.items()))


def bootstrap_interval(df: DataFrame, key: str, flag: Column, rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """A14. Interval of the mean over rounds of exact half samples without replacement (one row of one): the means at
    the two places, in order, that leave level between them.

    In each round the rows of the lower hashes (of key and round; then key, value) are the half. Hashes are counted and
    summed in 256 ranges a round, in the tasks first; only the range that the half ends in is ranked.
    """
    each = spread(df.select(F.col(key).alias("k"), flag.cast("double").alias("v"))).select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    each = each.withColumn("h", F.xxhash64("k", "round", F.lit(seed))).withColumn("part", F.shiftright("h", 56))
    sums = each.groupBy("round", "part").agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    own = Window.partitionBy("round")
    half = F.greatest(F.floor(F.sum("c").over(own) / 2), F.lit(1))
    parts = sums.withColumn("half", half).withColumn("before", F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    cuts = (F.col("before") < F.col("half")) & (F.col("before") + F.col("c") > F.col("half"))
    found = cut(parts.groupBy("round").agg(F.first("half").alias("half"), F.sum(F.when(F.expr("before + c <= half"), F.col("s"))).alias("s"), F.max(F.when(cuts, F.col("part"))).alias("part"), F.max(F.when(cuts, F.col("half") - F.col("before"))).alias("need")))
    last = F.broadcast(found.where("part is not null").select("round", "part", "need"))  # one row a round at most
    ranked = each.join(last, ["round", "part"]).withColumn("n", F.row_number().over(own.orderBy("h", "k", "v"))).where("n <= need")
    means = found.select("round", "half", "s").unionByName(ranked.select("round", F.lit(None).cast("long").alias("half"), F.col("v").alias("s"))).groupBy("round").agg((F.sum("s") / F.max("half")).alias("m"))
    at = F.sort_array(F.collect_list("m"))  # one value a round
    low, high = int(rounds * (1 - level) / 2 + 1e-9), min(int(rounds * (1 + level) / 2 + 1e-9), rounds - 1)
    return means.agg(F.round(F.get(at, F.lit(low)), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.get(at, F.lit(high)), 6).alias("high"))


def paired_costs(df: DataFrame, key: str, order: list[str], cost: str) -> DataFrame:
    """A15. key, total, corrected: if costs 2i and 2i + 1 are always equal (to 1e-6), each was booked twice."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = df.withColumn("w_at", F.row_number().over(w) - 1).withColumn("w_pair", F.floor(F.col("w_at") / 2))
    two = placed.groupBy(key, "w_pair").agg(F.sum(cost).alias("s"), F.count("*").alias("c"), (F.max(cost) - F.min(cost) < 1e-6).alias("same"))
    every = (F.every(F.col("same") & (F.col("c") == 2))).alias("twice")
    return two.groupBy(key).agg(F.sum("s").alias("t"), every).select(key, F.round("t", 6).alias("total"), F.round(F.when(F.col("twice"), F.col("t") / 2).otherwise(F.col("t")), 6).alias("corrected"))


def token_cost(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """A17. usage (model, prompt, completion) with cost by the prices (model, p_in, p_out); an unknown model is an error."""
    joined = usage.join(prices, model, "left")
    known = F.when(F.col("p_in").isNull(), F.raise_error(F.concat(F.lit("no price of "), F.col(model)))).otherwise(F.col("prompt") * F.col("p_in") + F.col("completion") * F.col("p_out"))
    return joined.withColumn("cost", known).drop("p_in", "p_out")


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """A25. How often each reason excludes a row."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def exclusion_reasons(rules: dict[str, Column]) -> Column:
    """F15. The names of the rules that hold."""
    return F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items())))


def filter_chain(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """F19. Survivors after each step, counted in one pass."""
    so_far, out = F.lit(True), []
    for k, v in steps.items():
        so_far = so_far & F.coalesce(v, F.lit(False))
        out.append(F.count_if(so_far).alias(k))
    return df.agg(F.count("*").alias("all"), *out)


def win_loss(df: DataFrame, key: str, wins: Column, losses: Column) -> DataFrame:
    """A28. key, diff and whether it is beyond max(3, 1.5 times the mean difference)."""
    d = df.groupBy(key).agg((F.count_if(wins) - F.count_if(losses)).alias("diff"))
    mean = d.agg(F.avg(F.abs("diff")).alias("mean"))
    return d.crossJoin(mean).select(key, "diff", (F.abs("diff") > F.greatest(F.lit(3.0), 1.5 * F.col("mean"))).alias("notable"))


def exclusive(df: DataFrame, key: str, label: str, of: str, against: list[str]) -> DataFrame:
    """A29, U03. Keys that one label has and none of the others."""
    has = lambda x: F.max((F.col(label) == x).cast("int"))
    marked = df.groupBy(key).agg(has(of).alias("a"), *(has(x).alias(f"b{i}") for i, x in enumerate(against)))
    none = F.lit(True)
    for i in range(len(against)):
        none = none & (F.col(f"b{i}") == 0)
    return marked.where((F.col("a") == 1) & none).select(key)


def same_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """M15. One row: whether two results hold the same rows, order and repeats aside."""
    columns = a.columns
    rows = a.select(*columns, F.lit(1).alias("w_s")).unionByName(b.toDF(*columns).select(*columns, F.lit(2).alias("w_s")))
    return rows.groupBy(*columns).agg(F.count_distinct("w_s").alias("w_n")).agg((F.count_if(F.col("w_n") < 2) == 0).alias("same"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """F21. Exactly n rows (a sample is the feature), the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def year_bucket(ts: Column, first: int = 2018) -> Column:
    """T29. The year, earlier ones as '<year> Before'."""
    y = F.year(ts)
    return F.when(y < first, f"{first - 1} Before").otherwise(y.cast("string"))
