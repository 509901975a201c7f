"""Approximate matching that has no native expression: Arrow-batched functions, and cascades of matching tiers."""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut

#: Letters of the places by which similar texts meet; similarities at which queries are searched before their cutoff.
WIDTHS, LEVELS = (6, 2, 1), (0.98,)

def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


@lru_cache(100_000)
def _tokens(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", text.replace("_", " ").replace("-", " ")))


def token_set(a: str, b: str) -> float:
    """R09. Best ratio of the common tokens with either side's tokens, and of both sides' tokens, words of letters, digits and what is neither sign nor _."""
    x, y = _tokens(a), _tokens(b)
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max(indel_ratio(one, two), *((indel_ratio(common, one), indel_ratio(common, two)) if common else (0.0, 0.0)))


def close(a: str, b: str) -> float:
    """R11. Ratcliff-Obershelp similarity."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def close_at_most(a: str, b: str) -> float:
    """What close() cannot exceed: twice the common letters, counted without order, over both lengths."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / total


@F.pandas_udf(T.DoubleType())
def chunk_ratio(chunk: pd.Series, query: pd.Series) -> pd.Series:
    """R12. Common subsequence with the query over the chunk's length, 0 for an empty chunk."""
    return pd.Series([lcs(c, q) / len(c) if c else 0.0 for c, q in zip(chunk.fillna(""), query.fillna(""), strict=True)])


def matches(names: DataFrame, queries: DataFrame, score: Callable[[str, str], float], k: int = 5, least: float = 0.0, at_most: Callable[[str, str], float] | None = None, block: int = 1000) -> DataFrame:
    """query, name, score, rank: best names (name) for each of a stated set of queries (query), by score(query, name).

    Blocks of about block queries go against all names; a task keeps the k best names of each of its queries, so k rows a
    query and task are shuffled. at_most, if given, is a cheap bound on the score: pairs that cannot reach least, or the
    k-th best so far, are not scored. Scores count at six decimals; ties go by name.
    """
    spark, found = names.sparkSession, None
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be merged into fewer
    name = names.select(F.col("name").cast("string").alias("name")).where("name is not null").repartition(tasks, "name").distinct()
    asked = queries.select(F.col("query").cast("string").alias("query")).where("query is not null").distinct()
    n_blocks = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    for b in range(n_blocks):
        some = [r.query for r in numbered.where(F.col("b") == b).collect()]  # about block texts
        sent = spark.sparkContext.broadcast(some)

        def search(parts, sent=sent):
            best: dict[str, list] = {q: [] for q in sent.value}  # (-score, name), the best k in order
            for pdf in parts:
                for n in pdf["name"]:
                    for q, own in best.items():
                        floor = max(least, -own[-1][0]) if len(own) == k else least
                        if at_most is not None and at_most(q, n) + 1e-6 < floor:
                            continue
                        s = round(score(q, n), 6)
                        if s >= floor:
                            insort(own, (-s, n))
                            del own[k:]
            yield pd.DataFrame([(q, n, -s) for q, own in best.items() for s, n in own], columns=["query", "name", "score"])

        part = name.mapInPandas(search, "query string, name string, score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _least_common(one: Column, two: Column, cutoff: float) -> Column:
    """Letters that two texts of these lengths share at least, in order, if their similarity reaches the cutoff."""
    return F.ceil(cutoff * (one + two) / 2 - 1e-9)


def _least_shared(one: Column, two: Column, cutoff: float, width: int) -> Column:
    """Places of so many letters that stand in both texts at least, if their similarity reaches the cutoff."""
    return (2 * width - 1) * _least_common(one, two, cutoff) - (width - 1) * (one + two + 1)


def close_candidates(names: DataFrame, queries: DataFrame, cutoff: float) -> DataFrame:
    """query, name (of distinct lower-case texts): all pairs whose Ratcliff-Obershelp similarity can reach the cutoff.

    At this similarity the texts have a common subsequence of M >= cutoff (a + b) / 2 letters, a and b being their lengths.
    The a + b - 2 M letters left out of either text part it into one run more at most, so M - (w - 1) (a + b - 2 M + 1)
    places of w letters stand in both. Places, numbered where they repeat, are put in order, the rarest first; texts which
    share t of them share one of their first n - t + 1, so they meet by equality of these. Where t falls to nothing, in short
    texts or at low cutoffs, fewer letters take the place of more, single ones at last. Of those that meet, pairs that share
    t in all remain.
    """
    both = names.select(F.lower("name").alias("text"), F.lit(0).alias("side")).unionByName(queries.select(F.lower("query").alias("text"), F.lit(1).alias("side"))).where("text is not null").distinct()
    size = F.length("text")
    shortest, longest = F.ceil(size * cutoff / (2 - cutoff) - 1e-9), F.floor(size * (2 - cutoff) / cutoff + 1e-9)  # of what can be so similar
    others = F.sequence(F.least(shortest, size.cast("long")), F.greatest(longest, size.cast("long")))
    feasible = lambda b: _least_common(size, b, cutoff) <= F.least(size.cast("long"), b)
    t_of = lambda w: F.coalesce(F.array_min(F.transform(F.filter(others, feasible), lambda b: _least_shared(size, b, cutoff, w))), F.lit(0).cast("long"))
    places = lambda width: F.when(size >= width, F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.substring("text", i, F.lit(width))))
    sized = both.where(size > 0).select("text", "side", size.alias("size"), *(t_of(w).alias(f"t{w}") for w in WIDTHS))
    each, before = None, F.lit(True)
    for w in WIDTHS:
        some = sized.where(before).select("text", "side", "size", F.lit(w).alias("width"), F.greatest(F.lit(1), f"t{w}").alias("t"), F.explode(places(w)).alias("gram"))
        each, before = some if each is None else each.unionByName(some), before & (F.col(f"t{w}") <= 0)
    counted = each.groupBy("text", "side", "size", "width", "t", "gram").agg(F.count("*").alias("n"))
    each = cut(counted.select("text", "side", "size", "width", "t", "gram", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth")))
    frequency = each.groupBy("width", "gram", "nth").agg(F.count("*").alias("df"))
    ordered = each.join(frequency, ["width", "gram", "nth"]).groupBy("text", "side", "size", "width", "t").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "nth"))).alias("grams"))
    named = cut(ordered.select("text", "side", "size", "width", F.transform("grams", lambda g: F.concat_ws(" ", g["nth"], g["gram"])).alias("grams"), "t"))
    # the least of the shared ones counts, so that a pair meets once
    first = named.select("text", "side", "size", "width", "grams", F.explode(F.slice("grams", F.lit(1), F.greatest(F.lit(1), F.size("grams") - F.col("t") + 1).cast("int"))).alias("gram"))
    of = lambda side, name: first.where(F.col("side") == side).select("gram", "width", F.col("text").alias(name), F.col("size").alias(f"{name}_size"), F.col("grams").alias(f"{name}_grams"))
    common = _least_common(F.col("query_size"), F.col("name_size"), cutoff)
    shared = F.array_intersect("query_grams", "name_grams")
    enough, before = F.lit(False), F.lit(True)
    for w in WIDTHS:
        wanted = _least_shared(F.col("query_size"), F.col("name_size"), cutoff, w)
        enough, before = enough | (before & (F.col("width") == w) & (wanted > 0) & (F.size(shared) >= wanted)), before & (wanted <= 0)
    near = F.least("query_size", "name_size") >= common
    met = of(1, "query").join(of(0, "name"), ["gram", "width"]).where(near & (F.get(shared, F.lit(0)) == F.col("gram")) & enough).select("query", "name").distinct()
    none = both.where("text = ''")
    return met.unionByName(none.where("side = 1").select(F.col("text").alias("query")).join(none.where("side = 0").select(F.col("text").alias("name")), F.col("query") == F.col("name")))


def close_matches(names: DataFrame, queries: DataFrame, k: int, cutoff: float) -> DataFrame:
    """R11. query, name, score, rank: the k names most similar to each query in any case, of a similarity of cutoff at least.

    Only close_candidates are compared, at high similarities first, where these are few: a query that has k names of a
    level has all its best ones, and goes no further. Scores count at six decimals; ties go by name.
    """
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, scored = cut(queries.select(F.lower("query").alias("query")).where("query is not null").distinct()), None
    for level in [x for x in LEVELS if x > cutoff] + [cutoff]:
        def score(parts, level=level):
            for pdf in parts:
                rows = [(q, n, round(close(n, q), 6)) for q, n in zip(pdf["query"], pdf["name"], strict=True) if close_at_most(q, n) + 1e-6 >= level]
                yield pd.DataFrame([r for r in rows if r[2] >= level], columns=["query", "name", "score"])

        pairs = cut(close_candidates(names, left, level).repartition(tasks, "query", "name").mapInPandas(score, "query string, name string, score double"))
        if level > cutoff:
            full = pairs.where(F.col("score") > level + 1e-6).groupBy("query").count().where(F.col("count") >= k).select("query")
            pairs, left = pairs.join(full, "query", "left_semi"), cut(left.join(full, "query", "left_anti"))
        scored = pairs if scored is None else scored.unionByName(pairs)
        if left.isEmpty():
            break
    said = lambda df, c: df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct().withColumn(f"l_{c}", F.lower(c))
    found = scored.select(F.col("query").alias("l_query"), F.col("name").alias("l_name"), "score").join(said(queries, "query"), "l_query").join(said(names, "name"), "l_name")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    return found.select("query", "name", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def best_chunks(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """R12. The best chunks (start, end, chunk), earlier ones first on ties."""
    order = [F.desc("score"), F.col("start")]
    best = chunks.withColumn("score", chunk_ratio(F.col("chunk"), F.lit(query))).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def first_tier(candidates: DataFrame, key: str) -> DataFrame:
    """Rows of the lowest tier that each key has."""
    least = Window.partitionBy(key)
    return candidates.withColumn("w_least", F.min("tier").over(least)).where("tier = w_least").drop("w_least")


def entity_search(entities: DataFrame, queries: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """R14. query, id, tier: entities (id, name) by whole id, by id with .__init__, by name, by name in any case, by the
    last dotted part of the query, or else by similarity of the name; the first tier that has any wins."""
    e, q = entities.select("id", "name").distinct(), queries.select("query").distinct()
    tiers = lambda *keys: F.posexplode(F.array(*keys)).alias("tier", "w_key")
    own = e.select("id", tiers(F.col("id"), F.col("id"), F.col("name"), F.lower("name"), F.lower("name")))
    asked = q.select("query", tiers(F.col("query"), F.concat("query", F.lit(".__init__")), F.col("query"), F.lower("query"), F.lower(F.substring_index("query", ".", -1))))
    # the tier is settled before ids are met: keys of later tiers, as common names, would bring all their ids to each query
    met = asked.join(own.select("tier", "w_key").distinct(), ["tier", "w_key"], "left_semi")
    first = cut(met.groupBy("query").agg(F.min(F.struct("tier", "w_key")).alias("w_first")).select("query", "w_first.*"))
    found = first.join(own, ["tier", "w_key"]).select("query", "id", "tier")
    left = q.join(first.select("query"), "query", "left_anti")
    near = close_matches(e.select("name"), left, 5, cutoff).join(e, "name").select("query", "id", F.lit(5).alias("tier"))
    return found.unionByName(near).distinct()


def resolve_paths(mentions: DataFrame, files: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """J21. mention, path, tier: exact, by a unique suffix, by a unique base name, else the most similar path."""
    m, f = mentions.select("mention").distinct(), files.select("path").distinct()
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)

    def unique(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy("mention").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").select("mention", "path", F.lit(n).alias("tier"))

    exact = m.join(f, F.col("mention") == F.col("path")).select("mention", "path", F.lit(0).alias("tier"))
    same = m.join(f, F.col("mention") == F.col("path"), "left_anti").join(f, base("mention") == base("path"))
    suffix = unique(same.where(F.endswith("path", F.concat(F.lit("/"), F.col("mention")))), 1)
    named = unique(same.select("mention", "path"), 2)
    found = exact.unionByName(suffix).unionByName(named)
    left = m.join(found.select("mention").distinct(), "mention", "left_anti").withColumnRenamed("mention", "query")
    near = close_matches(f.withColumnRenamed("path", "name"), left, 1, cutoff)
    return first_tier(found.unionByName(near.select(F.col("query").alias("mention"), F.col("name").alias("path"), F.lit(3).alias("tier"))), "mention")
