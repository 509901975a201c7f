"""Queries of sources and sinks: tables written in a form and read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import shared_folder, table
from weftline.sources import io as I


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}/{name}"


def _write_whole(spark, rows, path: str) -> None:
    """One text file without a line end, of a one-row frame (value)."""
    rows.coalesce(1).write.option("lineSep", " ").text(path)


@query("select n_nationkey, n_name, n_regionkey from nation union all select * from nation")
def jsonl_round_trip(spark, sf_dir):
    """Nations as JSON lines, written twice and read back."""
    n, path = table(spark, sf_dir, "nation"), _place(spark, "rows")
    I.write_json(n, path)
    I.write_json(n, path, append=True)
    return I.read_jsonl(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("select s_suppkey, s_name, '' as missing, s_acctbal from supplier")
def csv_round_trip(spark, sf_dir):
    """Suppliers with a column that is not there, as CSV."""
    path = _place(spark, "csv")
    I.write_csv(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name", "missing", "s_acctbal"])
    return I.read_csv(spark, path, "s_suppkey long, s_name string, missing string, s_acctbal double").na.fill("", ["missing"])


@query("select n_nationkey, n_name from nation where n_nationkey > 0 union all select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation")
def json_rows(spark, sf_dir):
    """Rows of a JSON list (those without a key go), of an object's values and of its instances."""
    n = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name").alias("r"))
    schema, out = "n_nationkey int, n_name string", None
    listed = F.to_json(F.collect_list(F.when(F.col("r.n_nationkey") > 0, F.col("r")).otherwise(F.struct(F.col("r.n_nationkey"), F.lit(" ").alias("n_name")))))
    forms = {"list": listed, "object": F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("r.n_name"), "r")))), "envelope": F.to_json(F.struct(F.collect_list("r").alias("instances")))}
    for name, form in forms.items():
        path = _place(spark, name)
        _write_whole(spark, n.agg(form.alias("value")), path)
        own = I.read_rows(spark, path, schema, "n_name")
        out = own if out is None else out.unionByName(own)
    return out


@query("select p_partkey, p_name from part union all select p_partkey, p_name from part")
def parquet_paths(spark, sf_dir):
    """Several paths as one table."""
    path = f"{sf_dir}/part.parquet"
    return I.read_parquet(spark, path, path).select("p_partkey", "p_name")


@query("select r_regionkey as region, r_name || '/' || n_name || '.py' as path, 'n' || n_nationkey || chr(10) || 'end' as text, '[{\"name\": \"C\"}]' as classes, '[]' as functions from nation join region on r_regionkey = n_regionkey")
def tree_leaves(spark, sf_dir):
    """Files of nested structures, one structure a region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaf = F.struct(F.array(F.concat(F.lit("n"), "n_nationkey"), F.lit("end")).alias("text"), F.array(F.struct(F.lit("C").alias("name"))).alias("classes"))
    files = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("n_name", F.lit(".py")), leaf))).alias("files"))
    trees = files.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("region"), F.to_json(F.create_map("r_name", "files")).alias("tree"))
    return I.flatten_tree(trees, "region")


@query("select 'r' || n_regionkey as folder, n_name from nation")
def outputs_of_runs(spark, sf_dir):
    """Result files of all runs, with their folders."""
    path = _place(spark, "runs")
    for k in range(5):
        _write_whole(spark, table(spark, sf_dir, "nation").where(F.col("n_regionkey") == k).agg(F.array_join(F.collect_list(F.to_json(F.struct("n_name"))), "\n").alias("value")), f"{path}/r{k}")
    return I.read_outputs(spark, f"{path}/*/*.txt", "n_name string").select("folder", "n_name")


@query("select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in' as type, 1.0e0 as weight from nation")
def graph_round_trip(spark, sf_dir):
    """A node-link graph inside an envelope, and its edges written as rows and read back."""
    n, path = table(spark, sf_dir, "nation"), _place(spark, "graph")
    node = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("type"))
    link = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("type"))
    _write_whole(spark, n.agg(F.to_json(F.struct(F.struct(F.collect_list(node).alias("nodes"), F.collect_list(link).alias("links")).alias("code_graph"))).alias("value")), path)
    nodes, edges = I.read_graph(spark, path)
    I.write_graph(nodes, edges, f"{path}-rows")
    return I.read_jsonl(spark, f"{path}-rows/edges", "src string, dst string, type string, weight double")


@query("select 'f' || o_orderkey as function, 'm' || o_custkey || '.py' as file, cast(o_orderkey % 100 as integer) as line, cast(o_orderkey as double) as ts, cast(o_orderkey % 2 as integer) as pid from orders")
def trace_rows(spark, sf_dir):
    """Calls of traces with function, file and line: a trace of every two thousand orders' keys, a file each."""
    path, k = _place(spark, "trace"), F.col("o_orderkey")
    name = F.concat(F.lit("f"), k, F.lit(" (m"), "o_custkey", F.lit(".py:"), k % 100, F.lit(")"))
    call = F.struct(F.lit("X").alias("ph"), name.alias("name"), k.cast("double").alias("ts"), F.lit(5.0).alias("dur"), (k % 2).alias("pid"), F.lit(1).alias("tid"))
    traces = table(spark, sf_dir, "orders").groupBy(F.floor(k / 2000).alias("trace")).agg(F.to_json(F.struct(F.collect_list(call).alias("traceEvents"))).alias("value"))
    traces.repartition("trace").write.option("maxRecordsPerFile", 1).partitionBy("trace").option("lineSep", " ").text(path)
    return I.read_trace(spark, path).select("function", "file", "line", "ts", "pid")


@query("select n_nationkey % 3 <> 2 as ran, case when n_nationkey % 3 <> 2 then 'ok ' || n_name || ' ' end as log from nation")
def log_parts(spark, sf_dir):
    """What logs say after a marker; those that failed to apply did not run."""
    path = _place(spark, "logs")
    logs = table(spark, sf_dir, "nation").select(F.concat(F.lit("setup"), F.when(F.col("n_nationkey") % 3 == 2, " cannot apply").otherwise(""), F.lit(" MARK"), F.lit("ok "), "n_name").alias("value"), "n_nationkey")
    logs.repartition(25, "n_nationkey").write.option("maxRecordsPerFile", 1).partitionBy("n_nationkey").option("lineSep", " ").text(path)
    return I.read_logs(spark, path, "MARK", ("cannot apply",)).select("ran", "log")


@query("select 'http://h/' || n_nationkey as url, n_name as text from nation union all select 'http://r/' || r_regionkey, r_name from region")
def cache_texts(spark, sf_dir):
    """Texts of addresses from a list of objects and from one object."""
    a, b = _place(spark, "list"), _place(spark, "object")
    listed = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("http://h/"), "n_nationkey").alias("image_url"), F.col("n_name").alias("ocr_text")))).alias("value"))
    mapped = table(spark, sf_dir, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("http://r/"), "r_regionkey"), "r_name")))).alias("value"))
    _write_whole(spark, listed, a)
    _write_whole(spark, mapped, b)
    return I.read_cache(spark, a).unionByName(I.read_cache(spark, b))


@query("select 'r' || r_regionkey || '/a.py' as path, 'x = ' || r_regionkey || ' ' as text from region")
def source_walk(spark, sf_dir):
    """Sources below a root, without the folders of tools and files of other kinds."""
    root = _place(spark, "tree")
    store = I.ObjectStore(spark, root)
    for r in table(spark, sf_dir, "region").collect():  # five rows
        for folder in ("", "node_modules/"):
            store.write(f"r{r.r_regionkey}/{folder}a.py", f"x = {r.r_regionkey} ")
        store.write(f"r{r.r_regionkey}/a.lock", "z")
    return I.walk_sources(spark, root)


@query("select 'r' || r_regionkey || '.txt' as key, r_name || 'é' as text from region where r_regionkey <> 2")
def object_store(spark, sf_dir):
    """Objects written, listed, deleted and read."""
    store = I.ObjectStore(spark, _place(spark, "objects"))
    for r in table(spark, sf_dir, "region").collect():  # five rows
        store.write(f"in/r{r.r_regionkey}.txt", r.r_name + "é")
    store.delete("in/r2.txt")
    return spark.createDataFrame([(k, store.read(f"in/{k}")) for k in store.list("in")], "key string, text string")
