"""Queries of repositories: entities, relations, documents and gold answers of source files made of the suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import code as C
from weftline.operators import lookup as O
from weftline.plans import retrieval_plans  # noqa: F401  (enters bm25_topk)
from weftline.plans.registry import ORACLE_SQL, query
from weftline.session import table
from weftline.sources import io as I

_K = "s_suppkey"
_NEXT = "(s_suppkey * 7) % (select count(*) from supplier)"
_LINES = ("import {{ helper }} from './s{n}'", "export class C{k} extends Base {{", "  run() {{", "    helper();", "  }}", "}}", "export function make{k}() {{", "  return new C{k}();", "}}")


def _sql_text(first: int = 1, last: int = len(_LINES)) -> str:
    """Lines first to last of a file as SQL."""
    said = [x.format(k="#K#", n="#N#") for x in _LINES[first - 1 : last]]
    quoted = ["'" + x.replace("'", "''").replace("#K#", f"' || {_K} || '").replace("#N#", f"' || ({_NEXT}) || '") + "'" for x in said]
    return " || chr(10) || ".join(quoted)


def files(spark, sf_dir):
    """file and text: one JavaScript file a supplier, which imports that of another one."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    k, other = F.col(_K).cast("string"), ((F.col(_K) * 7) % n).cast("string")
    text = F.lit("\n".join(_LINES).replace("{{", "{").replace("}}", "}").replace("{k}", "\x01").replace("{n}", "\x02"))
    return s.select(F.concat(F.lit("src/s"), k, F.lit(".js")).alias("file"), F.replace(F.replace(text, F.lit("\x01"), k), F.lit("\x02"), other).alias("text"))


_F = "'src/s' || s_suppkey || '.js'"
_ENT = f"""(select {_F} as file, 'class' as kind, 'C' || s_suppkey as name, 'C' || s_suppkey as qualified_name, 2 as start_line, 6 as end_line from supplier
union all select {_F}, 'method', 'run', 'C' || s_suppkey || '.run', 3, 5 from supplier union all select {_F}, 'function', 'make' || s_suppkey, 'make' || s_suppkey, 7, 9 from supplier)"""


@query(f"select * from {_ENT}")
def code_entities(spark, sf_dir):
    """Classes, methods and functions with their blocks."""
    return C.pattern_entities(files(spark, sf_dir)).select("file", "kind", "name", "qualified_name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query(f"select case kind when 'method' then file || '::C' || substr(file, 6, length(file) - 8) else file end as src, file || '::' || qualified_name as dst, 'defines' as type from {_ENT}")
def code_defines(spark, sf_dir):
    """What files and classes define."""
    return C.defines(C.pattern_entities(files(spark, sf_dir)))


@query(
    """select 'g' || s_suppkey || '.go' as file, 'class' as kind, 'S' || s_suppkey as name, 1 as start_line, 2 as end_line from supplier
union all select 'g' || s_suppkey || '.go', 'function', 'Run' || s_suppkey, 3, 6 from supplier
union all select 'b' || s_suppkey || '.py', 'class', 'K' || s_suppkey, 1, 4 from supplier
union all select 'b' || s_suppkey || '.py', 'function', 'run', 2, 4 from supplier"""
)
def code_entities_by_lines(spark, sf_dir):
    """Structs and Go functions by braces, Python files that do not parse by indentation."""
    s = table(spark, sf_dir, "supplier").select(F.col(_K).cast("string").alias("k"))
    go = F.concat(F.lit("struct S"), "k", F.lit(" {\n}\nfunc Run"), "k", F.lit("(x int) {\n  if x {\n  }\n}\n// class No"))
    bad = F.concat(F.lit("class K"), "k", F.lit(":\n  def run(self):\n    x = (\n# note\nx ="))
    both = s.select(F.concat(F.lit("g"), "k", F.lit(".go")).alias("file"), go.alias("text")).unionByName(s.select(F.concat(F.lit("b"), "k", F.lit(".py")).alias("file"), bad.alias("text")))
    found = C.pattern_entities(both).unionByName(C.python_entities(both))
    return found.select("file", "kind", "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


_SAID = {"imports": "'./s' || (" + _NEXT + ")", "extends": "'Base'", "instantiates": "'C' || s_suppkey"}
_MORE = [("exports", "'C' || s_suppkey"), ("exports", "'make' || s_suppkey"), ("calls", "'run'"), ("calls", "'helper'"), ("calls", "'make' || s_suppkey"), ("calls", "'C' || s_suppkey")]


@query(" union all ".join(f"select {_F} as file, '{t}' as type, {x} as target from supplier" for t, x in [*_SAID.items(), *_MORE]))
def code_mentions(spark, sf_dir):
    """What every file imports, exports, extends, calls and instantiates."""
    return C.mentions(files(spark, sf_dir))


_RESOLVED = [("calls", "C' || s_suppkey || '.run'"), ("calls", "make' || s_suppkey"), ("calls", "C' || s_suppkey"), ("instantiates", "C' || s_suppkey"), ("exports", "C' || s_suppkey"), ("exports", "make' || s_suppkey")]


@query(" union all ".join(f"select {_F} as src, {_F} || '::{x} as dst, '{t}' as type from supplier" for t, x in _RESOLVED))
def code_symbol_edges(spark, sf_dir):
    """References resolved to entities."""
    f = files(spark, sf_dir)
    return C.symbol_edges(C.mentions(f), C.pattern_entities(f))


@query(f"select {_F} as src, 'src/s' || ({_NEXT}) || '.js' as dst, 'imports' as type from supplier")
def code_import_edges(spark, sf_dir):
    """Relative imports resolved to the first candidate file."""
    return C.import_edges(files(spark, sf_dir))


@query(
    f"""select {_F} as doc_id, 'file' as level, sha256({_F} || chr(10) || {_sql_text()}) as text from supplier
union all select {_F} || '::C' || s_suppkey, 'module', sha256({_F} || chr(10) || 'C' || s_suppkey || chr(10) || {_sql_text(2, 6)}) from supplier
union all select {_F} || '::C' || s_suppkey || '.run', 'function', sha256({_F} || chr(10) || 'C' || s_suppkey || '.run' || chr(10) || {_sql_text(3, 5)}) from supplier
union all select {_F} || '::make' || s_suppkey, 'function', sha256({_F} || chr(10) || 'make' || s_suppkey || chr(10) || {_sql_text(7, 9)}) from supplier"""
)
def code_documents(spark, sf_dir):
    """Documents of files, modules and functions."""
    f = files(spark, sf_dir)
    return C.documents(f, C.pattern_entities(f)).select("doc_id", "level", F.sha2("text", 256).alias("text"))


@query(f"select {_F} as file, 'C' || s_suppkey as name, {_sql_text(2, 6)} as code from supplier union all select {_F}, 'run', {_sql_text(3, 5)} from supplier union all select {_F}, 'make' || s_suppkey, {_sql_text(7, 9)} from supplier")
def code_of_entities(spark, sf_dir):
    """The lines of every entity."""
    f = files(spark, sf_dir)
    return O.code_of(f, C.pattern_entities(f)).select("file", "name", "code")


@query(f"select s_suppkey as instance_id, 'file' as level, {_F} as item from supplier union all select s_suppkey, 'module', {_F} || '::C' || s_suppkey from supplier union all select s_suppkey, 'function', {_F} || '::C' || s_suppkey || '.run' from supplier")
def gold_of_patches(spark, sf_dir):
    """Files, modules and functions that a patch of every file touches."""
    f = files(spark, sf_dir)
    diff = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -4,2 +4,2 @@\n-    helper();\n+    other();\n   }"))
    patches = f.select(F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("instance_id"), diff.alias("patch"))
    return C.gold_entities(patches, C.pattern_entities(f)).select("instance_id", "level", "item")


@query(f"select s_suppkey as instance_id, {_F} as file, 'file' as kind, null as name, null::integer as line from supplier union all select s_suppkey, {_F}, 'function', 'make' || s_suppkey, null from supplier union all select s_suppkey, {_F}, 'line', null, cast(s_nationkey as integer) from supplier")
def located_answers(spark, sf_dir):
    """Files, functions and lines of answers."""
    s = table(spark, sf_dir, "supplier")
    said = F.concat(F.lit("I looked.\nfunction: lost\n./src/s"), _K, F.lit(".js\nfunction: make"), _K, F.lit("\nnoise\n line: "), "s_nationkey")
    return O.located_spans(s.select(F.col(_K).alias("instance_id"), said.alias("output"))).select("instance_id", "file", "kind", "name", "line")


_SPANS = ((0, 100, None), (10, 80, 0), (20, 10, 1), (120, 5, None))


@query(" union all ".join(f"select s_suppkey * 4 + {i} as id, 'f{i}' as name, {'null' if p is None else f's_suppkey * 4 + {p}'}::bigint as parent, {0 if p is None else 1 + (p > 0)} as depth from supplier" for i, (_, _, p) in enumerate(_SPANS)))
def trace_tree(spark, sf_dir):
    """Calls with the nearest call around them and their depth, one thread a supplier."""
    s = table(spark, sf_dir, "supplier")
    calls = [F.struct((F.col(_K) * 4 + i).alias("id"), F.lit(1).alias("pid"), F.col(_K).alias("tid"), F.lit(float(a)).alias("ts"), F.lit(float(d)).alias("dur"), F.lit(f"f{i}").alias("name")) for i, (a, d, _) in enumerate(_SPANS)]
    return C.call_tree(s.select(F.inline(F.array(*calls)))).select("id", "name", F.col("parent").cast("long").alias("parent"), F.col("depth").cast("int").alias("depth"))


@query(
    """with g as (select distinct o_orderkey // 100 as g from orders)
select o_orderkey + 1 as id, 'order' as name, -2 - o_orderkey // 100 as parent, 2 as depth from orders
union all select -2 - g, 'hundred', -1, 1 from g union all select -1, 'all', null, 0 from orders having count(*) > 0"""
)
def trace_of_one_thread(spark, sf_dir):
    """Calls of one thread that made all orders, by hundreds of keys, with the nearest call around them and their depth."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    call = lambda i, name, ts, dur: [F.lit(1).alias("pid"), F.lit(1).alias("tid"), i.cast("long").alias("id"), F.lit(name).alias("name"), ts.cast("double").alias("ts"), dur.cast("double").alias("dur")]
    hundreds = orders.select(F.floor(k / 100).alias("g")).distinct()
    calls = orders.select(*call(k + 1, "order", k * 10, F.lit(8)))
    calls = calls.unionByName(hundreds.select(*call(-2 - F.col("g"), "hundred", F.col("g") * 1000, F.lit(1000))))
    calls = calls.unionByName(orders.agg(F.max(k).alias("k")).where("k is not null").select(*call(F.lit(-1), "all", F.lit(-1), F.col("k") * 10 + 2000)))
    return C.call_tree(calls).select("id", "name", "parent", F.col("depth").cast("int").alias("depth"))


@query(f"select 'f' || s_suppkey as src, 'f' || ({_NEXT}) as dst, t as type from supplier, (values ('renders'), ('passes_props')) as v(t) where s_suppkey <> {_NEXT}")
def ui_function_edges(spark, sf_dir):
    """Components that functions render and pass properties to."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    name = F.concat(F.lit("C"), _K)
    body = F.concat(F.lit("return <C"), (F.col(_K) * 7) % n, F.lit(" x={1} />"))
    return C.ui_edges(s.select(F.concat(F.lit("f"), _K).alias("id"), name.alias("name"), name.alias("qualified_name"), body.alias("body")))


_P = "'p' || s_suppkey || '.py'"


@query(
    f"""select {_P} as file, 'P' || s_suppkey as owner, 'entity class' as kind, 'P' || s_suppkey as target from supplier
union all select {_P}, 'P' || s_suppkey || '.__init__', 'entity method', '__init__' from supplier union all select {_P}, '', 'imports', 'os.path' from supplier
union all select {_P}, 'P' || s_suppkey, 'inherits', 'Base' from supplier union all select {_P}, 'P' || s_suppkey, 'invokes', 'go' || s_nationkey from supplier
union all select {_P}, 'P' || s_suppkey || '.__init__', 'invokes', 'go' || s_nationkey from supplier"""
)
def python_references(spark, sf_dir):
    """Entities and references of Python files; a file that does not parse has none."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("from os import path\nclass P"), _K, F.lit("(m.Base):\n    def __init__(self):\n        x.go"), "s_nationkey", F.lit("()\n"))
    rows = s.select(F.concat(F.lit("p"), _K, F.lit(".py")).alias("file"), text.alias("text"))
    entities, references = C.python_graph(rows.unionByName(spark.createDataFrame([("bad.py", "def (")], "file string, text string")))
    return entities.select("file", F.col("qualified_name").alias("owner"), F.concat(F.lit("entity "), "kind").alias("kind"), F.col("name").alias("target")).unionByName(references.select("file", "owner", "kind", "target"))


@query(ORACLE_SQL["bm25_topk"])
def retriever_interface(spark, sf_dir):
    """BM25 through the interface that retrieval strategies share."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return O.LexicalRetriever(docs).search(items, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("select 'weftline_region' as table_name, unnest(['r_regionkey', 'r_name']) as column_name, unnest(['int', 'string']) as data_type")
def catalog_listing(spark, sf_dir):
    """Columns of a table in the catalog."""
    table(spark, sf_dir, "region").createOrReplaceTempView("weftline_region")
    return I.catalog_columns(spark).where("table_name = 'weftline_region'").select("table_name", "column_name", "data_type")
