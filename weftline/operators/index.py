"""A stored inverted index: block-max postings, bucketed by term, appended to by batches.

A batch's documents, in their order (those of one part beside each other, if the index has parts), form ranges of RANGE. A
block holds a term's postings in one range (and in one part of the corpus): an array of one number each, tf * RANGE + slot,
and beside it what a search needs first, the number of documents, occurrences, and the largest tf and least dl. What a slot
of a range stands for, (doc_id, dl), is told once, by the block of WHOLE. So counts and bounds read no postings, and a search
reads the buckets of its own terms only. Blocks lie in folders batch=<n>/bucket=<m>; a batch counts once its row of the table of batches
is written, which is done last, so a batch that failed half-way is not seen, and is written anew by the next append.

Texts are tokenised when a batch is written and never again: texts move to their ranges, where blocks are made, and only these
move once more, to their buckets. A search moves blocks of postings, not tokens, to their ranges, and neither weights nor hits;
scores are summed there. Only if an id stands in several documents are scores added up by a further exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import identifier_bag
from weftline.session import cut, spread

RANGE, BUCKETS = 32, 64
#: Ranges of each query that are scored first, for a score which the k best reach at least.
FIRST = 4
#: Signs of text that a task of a batch takes, in the mean.
PART = 16_000_000
#: Blocks that a task packs into pages at once, and the parts into which the pages of a bucket are dealt.
PAGE, LOTS = 250_000, 16
#: The term of the blocks that have each document once.
WHOLE = ""
_SLACK = 2e-6  # scores are compared at six decimals


class PostingIndex:
    """Blocks and corpus counts under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        seen = spark.read.parquet(f"{path}/batches").collect()  # a row a batch
        self.batches, self.buckets, self.single = sorted(r.batch for r in seen), seen[0].buckets, all(r.single for r in seen)
        self.parts, self.schema = list(seen[0].parts), seen[0].schema

    @classmethod
    def build(cls, docs: DataFrame, path: str, parts: tuple[str, ...] = (), buckets: int = BUCKETS) -> PostingIndex:
        """An index of (doc_id, text) and the columns that split the corpus; the folder must not hold one yet."""
        _write(docs, path, 0, list(parts), buckets)
        return cls(docs.sparkSession, path)

    def append(self, docs: DataFrame) -> PostingIndex:
        """The index with one more batch."""
        _write(docs, self.path, self.batches[-1] + 1, self.parts, self.buckets)
        return PostingIndex(self.spark, self.path)

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """All blocks that count; those of terms (term, without repeats), out of the terms' buckets only."""
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/blocks").where(F.col("batch").isin(self.batches))
        if terms is None:
            return found
        from weftline.operators.retrieval import _bounded

        asked = terms.groupBy(_bucket(F.col("term"), self.buckets)).count().collect()  # as many as there are buckets
        held = _bounded(terms.select("term"), sum(r["count"] for r in asked))
        return found.where(F.col("bucket").isin([r["bucket"] for r in asked])).join(held, "term", "left_semi")

    def sizes(self, over: list[str]) -> DataFrame:
        """over, n_docs and total (their length in tokens)."""
        return self._whole().groupBy(*over).agg(F.sum("df").alias("n_docs"), F.sum("total").alias("total"))

    def _whole(self) -> DataFrame:
        return self.blocks(self.spark.createDataFrame([(WHOLE,)], "term string"))

    def counts(self, over: list[str], terms: DataFrame) -> DataFrame:
        """A02, A23. Per term: df, n occurrences and total, the length of what holds them; from the blocks' heads alone."""
        return self.blocks(terms).groupBy(*over, "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("total").alias("total"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """parts, doc_id, dl, term and tf of the terms, by range; the range, too, if no id stands in several documents."""
        moved = self.blocks(terms).select(*self.parts, "term", "range", "postings").repartition("range").join(self._documents(), "range")
        return moved.select(*self.parts, "term", *(["range"] if self.single else []), "docs", F.explode("postings").alias("p")).select("*", *_told()).drop("docs", "p")

    def _documents(self) -> DataFrame:
        """range and docs, its (slot, doc_id, dl) by slot."""
        moved = self._whole().select("range", "docs").repartition("range")
        return moved.groupBy("range").agg(F.array_sort(F.flatten(F.collect_list("docs"))).alias("docs")).hint("shuffle_hash")

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """R01. query_id, doc_id, score, rank as of retrieval.bm25 over the whole corpus, by the ranges that can matter."""
        from weftline.operators.retrieval import top_k

        asked, surviving = self.surviving(queries, k, k1, b)
        hits = self._scores(asked, surviving, k1, b)
        return top_k(hits, k, [F.desc("score"), F.col("doc_id")])

    def surviving(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
        """Weights (query_id, term, w, avgdl) and the pairs query_id, range that may hold one of the k best, with upper, the
        most that a document there can score, and kept, whether that reaches what the k best reach."""
        from weftline.operators.retrieval import _asked, _bounded, _idf, _share

        asked = _asked(queries, [])
        whole = self.sizes([]).first()
        n, avgdl = whole.n_docs or 0, max((whole.total or 0) / max(whole.n_docs or 0, 1), 1e-9)
        terms = asked.select("term").distinct()
        df = self.counts([], terms)
        weights = cut(asked.join(df, "term").select("query_id", "term", (_idf(F.lit(n), F.col("df")) * F.col("qf")).alias("w"), F.lit(avgdl).alias("avgdl")))
        moved = self.blocks(terms).select("term", "range", "max_tf", "min_dl").repartition("range")  # all that follows stays there
        heads = moved.groupBy("term", "range").agg(F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
        upper = heads.join(_bounded(weights, weights.count()), "term").groupBy("query_id", "range").agg(F.sum(F.col("w") * _share(k1, b)).alias("upper"))
        upper = cut(upper)
        best = upper.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "range"))).where(F.col("place") <= FIRST)
        first = self._scores(weights, best.select("query_id", "range"), k1, b)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = first.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        kept = F.col("upper") + _SLACK >= F.coalesce("least", F.lit(0.0))
        return weights, cut(upper.join(least, "query_id", "left").select("query_id", "range", "upper", kept.alias("kept"))).where("kept")

    def _scores(self, weights: DataFrame, pairs: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, doc_id, score of the documents in pairs (query_id, range): blocks of ranges that no pair has are left out
        before they move, the rest meets the weights in its range, where scores are summed."""
        from weftline.operators.retrieval import BROADCAST_ROWS, _bounded, _share

        blocks = self.blocks(weights.select("term").distinct()).select("term", "range", "postings")
        ranges = pairs.select("range").distinct()
        if ranges.count() <= BROADCAST_ROWS:
            blocks = blocks.join(F.broadcast(ranges), "range", "left_semi")
        wanting = pairs.groupBy("range").agg(F.collect_list("query_id").alias("w_queries"))  # a row a range, so that weights need not move to pairs
        held = blocks.repartition("range").join(wanting.hint("shuffle_hash"), "range").join(self._documents(), "range").join(_bounded(weights, weights.count()), "term")
        met = held.where(F.array_contains("w_queries", F.col("query_id"))).select("range", "query_id", "w", "avgdl", "docs", F.explode("postings").alias("p")).select("*", *_told())
        summed = met.groupBy("range", "query_id", "doc_id").agg(F.sum(F.col("w") * _share(k1, b)).alias("score"))
        if not self.single:
            summed = summed.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        return summed.select("query_id", "doc_id", F.round("score", 6).alias("score")).where("score > 0")


def _told() -> list[Column]:
    """tf, doc_id and dl of a posting p, by the docs of its range."""
    doc = F.get("docs", F.col("p").bitwiseAND(RANGE - 1))
    return [F.shiftright("p", RANGE.bit_length() - 1).alias("tf"), doc["doc_id"].alias("doc_id"), doc["dl"].alias("dl")]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def _packing() -> tuple[Callable, Callable]:
    """Functions of batches that make rows of a bucket and task to compressed tables (bucket, lot, page), and these to rows.

    By columns, rows as short as blocks take a third of what they take one by one.
    """
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("lot", pa.int32()), ("page", pa.binary())])

    def pages(held, lot):
        rows = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        at = 0
        for bucket, n in sorted((x["values"], x["counts"]) for x in rows.column("bucket").value_counts().to_pylist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(rows.slice(at, n))
            at += n
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "lot": lot, "page": sink.getvalue().to_pybytes()}], schema)

    def pack(batches):
        from pyspark import TaskContext

        lot, held, n = TaskContext.get().partitionId() % LOTS, [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PAGE:
                yield from pages(held, lot)
                held, n = [], 0
        if n:
            yield from pages(held, lot)

    def unpack(batches):
        for batch in batches:
            for page in batch.column("page"):
                yield from pa.ipc.open_stream(page.as_buffer())

    return pack, unpack


def _write(docs: DataFrame, path: str, batch: int, parts: list[str], buckets: int) -> None:
    texts = spread(docs.select("doc_id", *parts, "text"))
    if parts:
        texts = texts.sortWithinPartitions(*parts)
    # the number of the batch is in the range before texts move by it: a sum made afterwards would move all postings anew
    placed = texts.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE.bit_length() - 1) + F.lit(batch << 48))
    # texts move to their ranges, so that their tokens and postings need not
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PART)
    sized = placed.repartition(tasks, "range").select("doc_id", *parts, "range", identifier_bag(F.col("text")).alias("bag")).withColumn("dl", F.size("bag"))
    slot = F.dense_rank().over(Window.partitionBy("range").orderBy(*parts, "doc_id", "dl")) - 1
    each = sized.withColumn("slot", slot).select("doc_id", *parts, "range", "slot", "dl", F.explode(F.concat("bag", F.array(F.lit(WHOLE)))).alias("term"))
    tf = each.groupBy("doc_id", *parts, "range", "slot", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    doc = F.when(F.col("term") == WHOLE, F.struct("slot", "doc_id", "dl"))
    posting = F.col("tf") * RANGE + F.col("slot")
    made = tf.groupBy(*parts, "term", "range").agg(F.sum(F.col("tf") * F.col("dl")).alias("total"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(posting)).alias("postings"), F.collect_list(doc).alias("docs"))
    # docs are empty but not null elsewhere: of a column of null lists, Arrow's size is counted anew from the last list for each row
    moved = made.withColumn("bucket", _bucket(F.col("term"), buckets))
    # the blocks of a frequent term, which are many, go to several files of its bucket; what the postings tell is counted where they arrive
    pack, unpack = _packing()
    pages = moved.mapInArrow(pack, "bucket int, lot int, page binary").repartition(tasks, "bucket", "lot")
    dealt = pages.mapInArrow(unpack, moved.schema).sortWithinPartitions("bucket", "term", "range")
    tfs = lambda p: F.shiftright(p, RANGE.bit_length() - 1)
    n = F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + tfs(p))
    blocks = dealt.select(*parts, "term", "range", F.size("postings").cast("long").alias("df"), n.alias("n"), "total", tfs(F.array_max("postings")).alias("max_tf"), "min_dl", "postings", "docs", "bucket")
    schema = ", ".join(f"`{c}` {t}" for c, t in blocks.dtypes if c != "bucket") + ", batch int, bucket int"
    blocks.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks/batch={batch}")
    spark = docs.sparkSession
    whole = spark.range(1).select(_bucket(F.lit(WHOLE), buckets)).first()[0]
    ids = spark.read.schema(schema).parquet(f"{path}/blocks").where((F.col("batch") <= batch) & (F.col("bucket") == whole) & (F.col("term") == WHOLE)).select(F.inline("docs"))
    single = ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    row = spark.createDataFrame([(buckets, single, parts, schema)], "buckets int, single boolean, parts array<string>, schema string")
    row.coalesce(1).write.parquet(f"{path}/batches/batch={batch}")
