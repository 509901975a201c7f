"""Queries of text functions, path predicates and patch shapes, over names and texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import diffs as D
from weftline.operators import lookup as O
from weftline.plans.registry import query
from weftline.session import table

_FOLDER = "case p_partkey % 9 when 0 then './tests/' when 1 then 'a/src/test_' when 2 then 'docs/' when 3 then 'lib/__mocks__/' when 4 then 'x/node_modules/' when 5 then '/usr/lib/' when 6 then 'src/README' when 7 then '../.github/ISSUE_TEMPLATE/' else 'src/app/' end"
_TAIL = "case p_partkey % 7 when 0 then '.ts' when 1 then '.JSX' when 2 then '.py' when 3 then '.toml' when 4 then '.md' when 5 then '.svelte' else '' end"
_PATH = f"{_FOLDER} || replace(p_name, ' ', '_') || {_TAIL}"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH).alias("path"))


def _either(names) -> str:
    return "(" + "|".join(x.replace(".", "\\.") for x in names) + ")"


def _quoted(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


_NORMAL = r"regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^[./]+', ''), '^[ab]/', '')"


@query(
    rf"""with p as (select p_partkey, {_PATH} as path from part), n as (select *, {_NORMAL} as normal, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') as stem from p)
select p_partkey, len(list_filter(regexp_split_to_array(lower(path), '[ _/]'), lambda x: starts_with(x, 'test'))) > 0 as test_path,
  list_has_any(string_split(lower(normal), '/'), [{_quoted(X.TEST_FOLDERS)}]) as test_folder,
  regexp_matches(lower(normal), '{_either(X.CODE_SUFFIXES)}$') and regexp_replace(regexp_extract(lower(normal), '[^/]*$'), '\.[^.]*$', '') not in ({_quoted(X.DOC_STEMS)})
    and not contains(lower(normal), 'issue_template') and not regexp_matches(lower(normal), '^(docs|doc|documentation)/') as code_path,
  regexp_matches(path, '{O.TOOL_PATH}') as tool_path,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(stem), '[^a-zA-Z0-9]'), lambda t: length(t) > 2))), ',') as stems
from n"""
)
def path_predicates(spark, sf_dir):
    """What the paths made of part names are, and their stems' tokens."""
    c = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", X.is_test_path(c).alias("test_path"), X.in_test_folder(c).alias("test_folder"), X.is_code_path(c).alias("code_path"), O.is_tool_path(c).alias("tool_path"), F.array_join(F.array_sort(X.stem_tokens(c)), ",").alias("stems"))


@query(
    r"""select o_orderkey, 'own' || o_custkey || '/re-po' as repository, 'f.ts::C.m' || o_orderkey as entity, case when o_orderkey % 2 = 0 then 'f.ts::C' else 'f.ts' end as module,
  case when o_totalprice / 40000 >= 5 then 'high' when o_totalprice / 40000 >= 3 then 'medium' else 'low' end as confidence,
  case o_orderkey % 3 when 0 then 1.0e0 when 1 then 0.0e0 else cast(o_custkey as double) end as weight,
  case o_orderkey % 3 when 0 then o_orderpriority else o_orderstatus end as named, o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 as filled
from orders"""
)
def id_functions(spark, sf_dir):
    """Ids, coerced weights, first filled values and validity of rows made of orders."""
    k = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("own"), "o_custkey", F.lit("__re-po-"), "o_orderkey").alias("instance"),
        F.concat(F.when(k % 2 == 0, "C.m").otherwise("m"), "o_orderkey").alias("qualified"),
        (F.col("o_totalprice") / 40000).alias("score"),
        F.when(k % 3 == 0, "none").when(k % 3 == 1, "-4").otherwise(F.col("o_custkey").cast("string")).alias("raw"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise(" ").alias("first"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("second"),
        "o_orderpriority",
    )
    return made.select(
        "o_orderkey",
        X.repository_of(F.col("instance")).alias("repository"),
        X.entity_id(F.lit("f.ts"), F.concat(F.lit("C.m"), "o_orderkey")).alias("entity"),
        X.module_id(F.lit("f.ts"), F.col("qualified")).alias("module"),
        X.confidence(F.col("score")).alias("confidence"),
        X.weight(F.col("raw")).alias("weight"),
        X.first_truthy(F.col("first"), F.col("o_orderpriority")).alias("named"),
        O.is_filled("first", "second").alias("filled"),
    )


@query(
    r"""with s as (select doc_id, text, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) as t, string_split(text, chr(10)) as l from documents)
select doc_id, length(t) as squeezed, case when length(t) <= 220 then t else rtrim(substr(t, 1, 217)) || '...' end as cut,
  sha256(array_to_string(list_transform(l, lambda x, i: lpad(cast(i as varchar), cast(length(cast(len(l) as varchar)) as integer), ' ') || ' | ' || x), chr(10))) as numbered,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+\.[A-Za-z][A-Za-z0-9]*'))), ' ') as files,
  sha256(replace(replace(text, 'ing', '<secret_hidden>'), 'th', '<secret_hidden>')) as hidden
from s"""
)
def text_forms(spark, sf_dir):
    """Whole documents squeezed, cut to a line, numbered, searched for paths, and without given secrets."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.squeeze(t)).cast("long").alias("squeezed"), X.truncate(t).alias("cut"), F.sha2(X.numbered(t), 256).alias("numbered"), F.array_join(F.array_sort(X.file_mentions(t)), " ").alias("files"), F.sha2(X.redact_secrets(t, ["th", "ing", ""]), 256).alias("hidden"))


@query(
    r"""select event_id, case event_id % 4 when 0 then event_type || ',b' when 1 then event_type when 2 then '' else '[' || event_type end as items,
  event_type || ',x' || event_id as keys, 'import ' || event_type || '|from a import ' || event_type as imports,
  case event_id % 5 when 0 then 'a' when 1 then 'b,c' when 2 then event_type else '' end as flat, case event_id % 3 when 0 then event_type when 1 then '' end as present
from events"""
)
def list_parsing(spark, sf_dir):
    """Lists in several spellings, keys, import lines, nested values and first present arrays."""
    k, e = F.col("event_id"), F.col("event_type")
    spelled = F.when(k % 4 == 0, F.concat(F.lit('["'), e, F.lit('", "", "b"]'))).when(k % 4 == 1, e).when(k % 4 == 2, " ").otherwise(F.concat(F.lit("["), e))
    nested = F.when(k % 5 == 0, '{"file": "a", "name": "z"}').when(k % 5 == 1, '["b", ["c"]]').when(k % 5 == 2, e).when(k % 5 == 3, "")
    code = F.concat(F.lit(" import "), e, F.lit("\nfrom a import "), e, F.lit("\nimportant = 1\nfrom b"))
    row = F.when(k % 3 == 0, F.create_map(F.lit("b"), F.array(e))).when(k % 3 == 1, F.create_map(F.lit("a"), F.array().cast("array<string>"), F.lit("b"), F.array(e))).otherwise(F.create_map(F.lit("c"), F.array(e)))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.array_join(X.string_list(spelled), ",").alias("items"),
        F.array_join(X.config_keys(F.concat(e, F.lit(": 1 x"), k, F.lit(" :"))), ",").alias("keys"),
        F.array_join(X.import_lines(code), "|").alias("imports"),
        F.array_join(O.flatten_mixed(nested), ",").alias("flat"),
        F.array_join(O.first_present(row, ["a", "b"]), ",").alias("present"),
    )


_PATCH = """'diff --git a/f' || l_partkey || '.py b/f' || l_partkey || '.py' || chr(10) || '--- a/f' || l_partkey || '.py' || chr(10) || '+++ b/f' || l_partkey || '.py' || chr(10) || '@@ -' || l_suppkey || ',4 +1,4 @@' || chr(10) || ' ctx' || chr(10) || '-old ' || l_returnflag || chr(10) || '+new  ' || l_linestatus || chr(10) || ' end'"""


@query(f"with g as (select l_orderkey, count(*) as n, string_agg('-old' || l_returnflag || chr(10) || '+new' || l_linestatus, chr(10) order by l_linenumber, {_PATCH}) as t from lineitem group by l_orderkey) select l_orderkey, n as files, n as hunks, n as added, n as removed, 2 * n as modified, sha256(t) as normal from g")
def patch_shapes(spark, sf_dir):
    """Files, hunks and lines of a patch made of every order's items, and its changed lines without blanks."""
    one = F.expr(_PATCH.replace("chr(10)", "char(10)"))
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("p")))).alias("p")).select("l_orderkey", F.array_join("p.p", "\n").alias("patch"))
    shape = {k: v.cast("long").alias(k) for k, v in O.patch_shape(F.col("patch")).items()}
    return made.select("l_orderkey", *(shape[k] for k in ("files", "hunks", "added", "removed")), D.modified_lines(F.col("patch")).cast("long").alias("modified"), F.sha2(D.normalized_patch(F.col("patch")), 256).alias("normal"))


@query(r"select o_orderkey as instance_id, chr(10) || 'type ' || o_orderstatus || chr(10) || 'said ' || o_orderpriority || case when o_orderkey % 2 = 0 then chr(10) || 'img' else '' end as evidence from orders")
def evidence_text(spark, sf_dir):
    """The query text of every instance, its filled parts line by line after the summary."""
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"), F.lit("").alias("a"), F.concat(F.lit("type "), "o_orderstatus").alias("b"), F.concat(F.lit("said "), "o_orderpriority").alias("c"), F.when(F.col("o_orderkey") % 2 == 0, "img").alias("d"))
    return parts.select("instance_id", X.evidence(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("evidence"))


@query("select l_orderkey, array_to_string(list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda x: list_position(u, x[1]) = x[2]), lambda x: x[1]), ',') as items from (select l_orderkey, list(regexp_replace(lower(l_returnflag || '/' || l_linestatus), '^[ab]/', '') order by l_linenumber, l_returnflag || l_linestatus) as u from lineitem group by l_orderkey)")
def ordered_unique(spark, sf_dir):
    """Normalised items of every order, each where it first stands."""
    flags = F.concat(F.lit("./"), "l_returnflag", F.lit("/"), "l_linestatus")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", flags.alias("f")))), lambda x: x["f"]).alias("items"))
    return lists.select("l_orderkey", F.array_join(X.ordered_unique(F.transform("items", lambda x: F.lower(x))), ",").alias("items"))
