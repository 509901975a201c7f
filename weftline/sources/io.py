"""Readers and writers. Paths are whatever Spark's file systems know; nothing is opened by the driver's own file API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that a walk leaves out, and suffixes of sources.
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", "target", "coverage")
SOURCE_SUFFIXES = ("py", "java", "js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "css", "scss", "html", "go", "rs", "rb", "php", "c", "h", "cc", "cpp")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))


def read_rows(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """S01, S03. Rows of JSON lines (*.jsonl), of a JSON list, of the values of a JSON object, or of its "instances".

    Rows without the key, if one is named, are dropped.
    """
    if path.rstrip("/").endswith(".jsonl"):
        rows = read_jsonl(spark, path, schema)
    else:
        as_list = F.from_json("value", F.lit(f"array<struct<{_struct(schema)}>>"))
        envelope = F.from_json("value", F.lit(f"struct<instances: array<struct<{_struct(schema)}>>>"))["instances"]
        values = F.map_values(F.from_json("value", F.lit(f"map<string, struct<{_struct(schema)}>>")))
        text = F.ltrim(F.regexp_replace("value", "^﻿", ""))
        found = F.when(text.startswith("["), as_list).otherwise(F.coalesce(envelope, values))
        rows = _whole(spark, path).select(F.inline(found))
    return rows if key is None else rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))


def _struct(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S02. JSON lines; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """S04"""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S05. With a header; types are inferred where no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def flatten_tree(trees: DataFrame, key: str, tree: str = "tree") -> DataFrame:
    """S07. key, path, text, classes, functions (JSON) of every leaf of nested JSON objects: a leaf has a text.

    The depth is unbounded, so each tree is walked by a Python table function, one row at a time.
    """
    import json

    import pandas as pd

    def walk(parts):
        for pdf in parts:
            out = []
            for k, text in zip(pdf[key], pdf[tree], strict=True):
                stack = [("", json.loads(text or "{}"))]
                while stack:
                    path, node = stack.pop()
                    if isinstance(node, dict) and "text" in node:
                        body = node["text"]
                        out.append((k, path, "\n".join(body) if isinstance(body, list) else body, json.dumps(node.get("classes", [])), json.dumps(node.get("functions", []))))
                    elif isinstance(node, dict):
                        stack += [(f"{path}/{name}" if path else name, child) for name, child in reversed(node.items())]
            yield pd.DataFrame(out, columns=[key, "path", "text", "classes", "functions"])

    kind = dict(trees.dtypes)[key]
    return trees.select(key, tree).mapInPandas(walk, f"{key} {kind}, path string, text string, classes string, functions string")


def walk_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """S08. path below root and text of all source files outside of skipped folders."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.substring_index("file", base + "/", -1), "^/+", "")
    parts = F.split(path, "/")
    inside = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*(F.lit(x) for x in skipped)))
    return files.select(path.alias("path"), "text").where(inside & F.lower(F.substring_index("path", ".", -1)).isin(*suffixes))


def read_outputs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """S09. Rows of all files that a glob names, with their folder; files that cannot be parsed are skipped."""
    rows = spark.read.schema(schema).json(glob, mode="DROPMALFORMED")
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)/[^/]*$", 1))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S10. Nodes and edges of a node-link JSON file, unwrapped from "code_graph"; edges may be called links."""
    node = "array<struct<id: string, type: string, label: string, file: string, start_line: int, end_line: int>>"
    edge = "array<struct<source: string, target: string, src: string, dst: string, type: string, weight: double>>"
    one = f"nodes: {node}, edges: {edge}, links: {edge}"
    parsed = _whole(spark, path).select(F.from_json("value", F.lit(f"struct<{one}, code_graph: struct<{one}>>")).alias("g"))
    field = lambda k: F.coalesce(F.col(f"g.code_graph.{k}"), F.col(f"g.{k}"))
    nodes = parsed.select(F.inline(field("nodes")))
    edges = parsed.select(F.posexplode(F.coalesce(field("edges"), field("links"))).alias("pos", "e"))
    return nodes, edges.select(F.coalesce("e.src", "e.source").alias("src"), F.coalesce("e.dst", "e.target").alias("dst"), "e.type", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), F.col("pos").cast("long").alias("pos"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """S11, T25. Complete events of a Chrome trace with function, file and line; phases other than M and X are an error."""
    parsed = _whole(spark, path).select(F.inline(F.from_json("value", F.lit("struct<traceEvents: array<struct<ph: string, name: string, ts: double, dur: double, pid: int, tid: int>>>"))["traceEvents"]))
    checked = parsed.where(F.when(F.col("ph").isin("M", "X"), True).otherwise(F.raise_error(F.concat(F.lit("phase "), "ph")).cast("boolean")))
    name = r"^(.*) \((.*):(\d+)\)$"
    return checked.where("ph = 'X'").select("name", *(F.regexp_extract("name", name, i).alias(k) for i, k in ((1, "function"), (2, "file"))), F.regexp_extract("name", name, 3).try_cast("int").alias("line"), "ts", "dur", "pid", "tid")


def read_logs(spark: SparkSession, path: str, marker: str, rejected: tuple[str, ...] = ()) -> DataFrame:
    """S12. file and the part of each log after a marker; logs that hold a rejected text count as not run."""
    logs = _whole(spark, path)
    bad = F.lit(False)
    for x in rejected:
        bad = bad | F.contains("value", F.lit(x))
    ran = F.contains("value", F.lit(marker)) & ~bad
    return logs.select("file", ran.alias("ran"), F.when(ran, F.substring_index("value", marker, -1)).alias("log"))


def catalog_columns(spark: SparkSession) -> DataFrame:
    """S13. Tables and columns of the current catalog."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


class ObjectStore:
    """S14. Text objects below a root in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{key}".rstrip("/"))

    def write(self, key: str, text: str) -> None:
        out = self._fs.create(self._path(key), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, key: str) -> str:
        if not self._fs.exists(self._path(key)):
            raise FileNotFoundError(key)
        stream = self._fs.open(self._path(key))
        try:
            return bytes(b & 0xFF for b in self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def list(self, key: str = "") -> list[str]:
        """Names right below a key, folders with a slash."""
        if not self._fs.exists(self._path(key)):
            return []
        return sorted(s.getPath().getName() + "/" * s.isDirectory() for s in self._fs.listStatus(self._path(key)))

    def delete(self, key: str) -> None:
        """A key and all below it."""
        self._fs.delete(self._path(key), True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """S15. url and text of a cache: a list of objects, in which both have several names, or an object of texts."""
    names = "url string, image_url string, web_url string, text string, ocr_text string, content string"
    listed = F.from_json("value", F.lit(f"array<struct<{_struct(names)}>>"))
    mapped = F.from_json("value", F.lit("map<string, string>"))
    raw = _whole(spark, path)
    a = raw.where(F.ltrim("value").startswith("[")).select(F.inline(listed)).select(F.coalesce("url", "image_url", "web_url").alias("url"), F.coalesce("text", "ocr_text", "content").alias("text"))
    b = raw.where(F.ltrim("value").startswith("{")).select(F.explode(mapped).alias("url", "text"))
    return a.unionByName(b).where("url is not null and text is not null")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """K01, K02. JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """K03. The named columns in order, with a header; missing ones are empty."""
    df.select(*((F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns)).na.fill("").write.mode("overwrite").option("header", True).csv(path)


def markdown(summary: DataFrame, title: str, most: int = 1000) -> str:
    """K04. A table of a summary's rows with figures at two decimals; beyond most rows the report says how many it leaves out."""
    rows = summary.limit(most + 1).collect()
    cell = lambda x: "" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["", f"{summary.count() - most} more rows are not shown."] if len(rows) > most else [])]) + "\n"


def write_pretty_json(df: DataFrame, path: str) -> None:
    """K01. One indented JSON document a row, a line between them; nulls are kept."""
    whole = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(F.concat(whole, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K05. Node and edge rows as JSON lines in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def dot_lines(edges: DataFrame, label: Column | None = None) -> DataFrame:
    """K06, G22. value: an edge statement of DOT for each edge; quotes are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tail = F.concat(F.lit(' [label="'), F.coalesce(label if label is not None else F.col("type"), F.lit("")), F.lit('"];'))
    return edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), tail).alias("value"))


def incident_text(edges: DataFrame) -> DataFrame:
    """G22. node and its outgoing edges as one line of text."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.concat_ws("; ", F.array_sort(F.collect_list(F.concat_ws(" ", "type", "dst")))).alias("incident"))
