"""Ranking metrics as Column builders over an ordered array of predictions and an array of gold items.

Missing predictions are empty arrays after a left join (J03). Same-named metrics differ in cutoffs, denominators and the
treatment of duplicates; the parameters say which. METRICS is the registry (X07).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _head(pred: Column, k: int | None) -> Column:
    return pred if k is None else F.slice(pred, 1, k)


def acc(pred: Column, gold: Column, k: int, strict: bool = False) -> Column:
    """M01, M02. Any gold item among the first k; strict: all of them, and there is one."""
    head = _head(pred, k)
    hit = (F.size(gold) > 0) & (F.size(F.array_except(gold, head)) == 0) if strict else F.size(F.array_intersect(head, gold)) > 0
    return hit.cast("double")


def reciprocal_rank(pred: Column, gold: Column, k: int | None = None) -> Column:
    """M03. One over the place of the first hit, else 0."""
    at = F.array_min(F.transform(_head(pred, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1)))
    return F.coalesce(1.0 / at, F.lit(0.0))


def average_precision(pred: Column, gold: Column, k: int | None = None, over: str = "gold", repeats: bool = False) -> Column:
    """M04 to M06. Mean precision at hits, over the distinct gold items or over k.

    Repeated predictions take a place but are no hit, unless repeats says they count.
    """
    head = _head(pred, k)
    flags = F.transform(head, lambda x, i: F.array_contains(gold, x) & (F.lit(repeats) | (F.array_position(head, x) == i + 1)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(a: Column, hit: Column) -> Column:
        hits = a["hits"] + hit.cast("int")
        return F.struct((a["n"] + 1).alias("n"), hits.alias("hits"), (a["sum"] + F.when(hit, hits / (a["n"] + 1)).otherwise(0.0)).alias("sum"))

    total = F.aggregate(flags, zero, step, lambda a: a["sum"])
    if over == "k":
        return total / k
    return F.when(F.size(gold) > 0, total / F.size(F.array_distinct(gold))).otherwise(0.0)


def ndcg(pred: Column, gold: Column, k: int) -> Column:
    """M07. Binary gain; the ideal has min(|gold|, k) hits, repeats of gold items included."""
    gain = F.aggregate(F.transform(_head(pred, k), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, g: a + g)
    n = F.least(F.size(gold), F.lit(k))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return F.when(ideal > 0, gain / ideal).otherwise(0.0)


def hits(pred: Column, gold: Column, k: int | None = None) -> Column:
    """Places among the first k that hold a gold item."""
    return F.size(F.filter(_head(pred, k), lambda x: F.array_contains(gold, x)))


def precision_at(pred: Column, gold: Column, k: int) -> Column:
    """M08. Hits over k."""
    return hits(pred, gold, k) / F.lit(float(k))


def recall_at(pred: Column, gold: Column, k: int) -> Column:
    """M08. Hits over gold items, k at most."""
    n = F.least(F.size(gold), F.lit(k))
    return F.when(n > 0, hits(pred, gold, k) / n).otherwise(0.0)


def set_metrics(pred: Column, gold: Column, k: int | None = None) -> dict[str, Column]:
    """M09. sl (all gold items found), rec, pre (over distinct predictions) and f1."""
    head, own = F.array_distinct(_head(pred, k)), F.array_distinct(gold)
    n = F.size(F.array_intersect(own, head))
    rec = F.when(F.size(own) > 0, n / F.size(own)).otherwise(0.0)
    pre = F.when(F.size(head) > 0, n / F.size(head)).otherwise(0.0)
    f1 = F.when(rec + pre > 0, 2 * pre * rec / (pre + rec)).otherwise(0.0)
    return {"sl": ((F.size(own) > 0) & (n == F.size(own))).cast("double"), "rec": rec, "pre": pre, "f1": f1}


METRICS = {
    "acc": acc,
    "acc_strict": lambda p, g, k: acc(p, g, k, strict=True),
    "mrr": reciprocal_rank,
    "map_gold": average_precision,
    "map_k": lambda p, g, k: average_precision(p, g, k, over="k", repeats=True),
    "map_repeats": lambda p, g, k=None: average_precision(p, g, k, repeats=True),
    "ndcg": ndcg,
    "precision": precision_at,
    "recall": recall_at,
}


def with_predictions(gold: DataFrame, predictions: DataFrame, key: str = "query_id") -> DataFrame:
    """J03. Every gold row with its predictions, or none."""
    return gold.join(predictions, key, "left").withColumn("pred", F.coalesce("pred", F.expr("array()").cast(dict(predictions.dtypes)["pred"])))


def macro(df: DataFrame, metrics: dict[str, Column], by: list[str] | None = None, percent: bool = True) -> DataFrame:
    """M12. Means over all rows, in percent with two decimals."""
    scale = 100 if percent else 1
    return df.groupBy(*(by or [])).agg(*(F.round(F.coalesce(F.avg(v), F.lit(0.0)) * scale, 2).alias(k) for k, v in metrics.items()))
