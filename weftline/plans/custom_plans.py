"""Queries that need Arrow functions, streams or Python table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import fuzzy as Z
from weftline.plans.registry import query
from weftline.session import table
from weftline.streaming import logs as L


@query()
def fuzzy_token_set(spark, sf_dir):
    """Part names nearest to every brand and type, by token sets."""
    p = table(spark, sf_dir, "part")
    return Z.matches(p.select(F.col("p_name").alias("name")), p.select(F.concat_ws(" ", "p_brand", "p_type").alias("query")), Z.token_set, 3)


@query()
def difflib_match(spark, sf_dir):
    """Part names close to part types."""
    p = table(spark, sf_dir, "part")
    return Z.matches(p.select(F.lower("p_name").alias("name")), p.select(F.lower("p_type").alias("query")), lambda query, name: Z.close(name, query), 3, 0.3, Z.close_at_most)


@query()
def bm25_stemmed_chunks(spark, sf_dir):
    """Chunks of documents for every benchmark item, by stems."""
    from weftline.operators import retrieval as R

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = R.chunk_bm25(table(spark, sf_dir, "documents"), items)
    return found.select("query_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score", F.col("rank").cast("long").alias("rank"))


@query()
def lcs_chunks(spark, sf_dir):
    """Three chunks of five lines nearest to each benchmark item's whole text, in the document of its best hit."""
    from weftline.operators import retrieval as R

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents")
    hit = R.bm25(docs, items, 1).select("query_id", "doc_id")
    chunks = docs.join(hit, "doc_id").join(items.select("query_id", F.col("text").alias("item")), "query_id").select("query_id", "doc_id", "item", F.inline(X.fixed_chunks(F.col("text"), 5)))
    scored = chunks.withColumn("score", F.round(Z.chunk_ratio(F.col("chunk"), F.col("item")), 6))
    return R.top_k(scored, 3, [F.desc("score"), F.col("start")]).select("query_id", "doc_id", "start", "end", "score", F.col("rank").cast("long").alias("rank"))


@query()
def close_names(spark, sf_dir):
    """Part names with a letter before them: the three most similar names of each, of 0.8 or more."""
    p = table(spark, sf_dir, "part")
    return Z.close_matches(p.select(F.col("p_name").alias("name")), p.select(F.concat_ws(" ", F.lit("x"), "p_name").alias("query")), 3, 0.8)


@query()
def resolved_paths(spark, sf_dir):
    """Addresses of pages, as files of a tree, that are named whole, by their end, by their base name, or misspelled."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("."), F.col("page_id"), F.lit(".html"))
    kind = F.pmod("page_id", F.lit(4))
    mention = F.when(kind == 0, path).when(kind == 1, F.regexp_extract(path, r"([^/]*/[^/]*)$", 1)).when(kind == 2, F.regexp_extract(path, r"([^/]*)$", 1)).otherwise(F.concat(path, F.lit("x")))
    return Z.resolve_paths(p.select(mention.alias("mention")), p.select(path.alias("path")))


@query()
def similar_entities(spark, sf_dir):
    """Parts by all tiers: id, id of a module, name, name in any case, last part of a dotted name, similarity of 0.8."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lower("p_brand").alias("brand"))
    id_ = F.concat_ws(".", F.concat("brand", F.col("p_partkey")), "name")
    entities = p.select(F.when(F.col("p_partkey") % 5 == 0, F.concat(id_, F.lit(".__init__"))).otherwise(id_).alias("id"), "name")
    kind = F.pmod("p_partkey", F.lit(6))
    asked = F.when(kind == 0, id_).when(kind == 1, F.col("name")).when(kind == 2, F.upper("name")).when(kind == 3, F.concat(F.lit("any."), "name")).otherwise(F.concat("name", F.lit("s")))
    return Z.entity_search(entities, p.select(asked.alias("query")))


@query(
    """with e as (select distinct lower(p_brand) || '.' || p_partkey as id, p_partkey::varchar as name from part), q as (select distinct case when l_partkey % 3 = 0 then 'x.' || l_partkey else l_partkey::varchar end as query from lineitem)
select query, id, case when starts_with(query, 'x.') then 4 else 2 end as tier from q join e on e.name = replace(query, 'x.', '')"""
)
def entity_cascade(spark, sf_dir):
    """Parts by name or by the last part of a dotted name."""
    p = table(spark, sf_dir, "part").select(F.concat_ws(".", F.lower("p_brand"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("string").alias("name"))
    q = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("x."), "l_partkey")).otherwise(F.col("l_partkey").cast("string")).alias("query"))
    return Z.entity_search(p, q, 1.1)


@query("select user_id, event_type, count(*) as n from events group by all")
def stream_counts(spark, sf_dir):
    """Running counts of the event stream, at its end."""
    return L.run(L.counts(L.event_stream(spark, sf_dir), ["user_id", "event_type"]), "complete")


@query("select distinct user_id, props from events")
def stream_dedupe(spark, sf_dir):
    """Keys as they are first seen."""
    return L.run(L.first_seen(L.event_stream(spark, sf_dir).select("user_id", "props"), ["user_id", "props"]), "append")


@query()
def stream_condense(spark, sf_dir):
    """Ids that every user's log retains, after each batch."""
    found = L.run(L.rolling_retention(L.event_stream(spark, sf_dir), "user_id", ["ts", "event_id"]), "update")
    return found.select("user_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))
