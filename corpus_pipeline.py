"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns all documents it keeps, with the columns of documents; the last one
adds each document's place in the mixture. Between stages the documents are written as Parquet and read again, in files of
a size that follows from that of the input, as a stage's partitions can be many and small.

Defined results: null and empty texts fail the quality rules, so no later stage meets them in run(); by themselves the
other stages keep them. Rows that repeat an id are judged by their texts, rows of null ids by themselves; repeats of an id
and text are copies. Columns beside those of documents are kept, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, mixing, ngram_join, pii, quality_rules
from weftline.llm.scratch import files_for, remove, shared_folder


def _compact(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.coalesce(files_for(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _compact(quality_rules.passing(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays."""
    return _compact(ngram_join.one_of_each(docs, threshold=0.8), docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return _compact(decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text."""
    clean = _compact(pii.redact(docs), docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot, phase and position in the mixture of sources."""
    return _compact(mixing.mix(docs, block=16), docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, written to the shared folder in between."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs


#: Near-duplicate groups, EM and the schedule are not expressible as one SQL query; tests hold run() against brute force.
ORACLE_SQL = None
