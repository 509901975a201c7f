"""Queries over the text tables: tokens, retrieval, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import retrieval as R
from weftline.operators.index import PostingIndex
from weftline.operators.vectors import VectorIndex
from weftline.plans.registry import ORACLE_SQL, query
from weftline.session import shared_folder, table


def tokens_sql(c: str = "text") -> str:
    parts = r"list_transform(string_split_regex(replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), ' +'), lambda p: lower(p))"
    own = f"list_concat([lower(r)], list_filter({parts}, lambda p: p <> '' and p <> lower(r)))"
    return f"flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+'), lambda r: {own}))"


@query(f"select term, count(*) as tf, count(distinct doc_id) as df from (select doc_id, unnest({tokens_sql()}) as term from documents) group by term")
def tokenize_terms(spark, sf_dir):
    """Every term's total and document frequency."""
    posts = R.postings(table(spark, sf_dir, "documents"), ["doc_id"], X.identifier_bag(F.col("text")))
    return posts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(
    r"""with a as (select p_partkey, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '([a-z0-9$])([A-Z])', '\1 \2', 'g'), '[\\/_\-\.\s]+', ' ', 'g'), '[^A-Za-z0-9$\s]+', ' ', 'g')), '\s+'), lambda t: t <> '') as t from part),
e as (select p_partkey, t[i] as alias, i from a, unnest(range(1, len(t) + 1)) as u(i))
select p_partkey, alias, min(i) as first_at from e group by p_partkey, alias"""
)
def alias_tokens(spark, sf_dir):
    """Distinct aliases of part names with their first place (from 1)."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(X.aliases(F.col("p_name"))).alias("i", "alias"))
    whole = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("p_name"), r"([a-z0-9$])([A-Z])", "$1 $2"), r"[\\/_\-\.\s]+", " "), r"[^A-Za-z0-9$\s]+", " ")), r"\s+"), lambda t: t != "")).alias("j", "alias"))
    first = whole.groupBy("p_partkey", "alias").agg(F.min("j").alias("j"))
    return a.join(first, ["p_partkey", "alias"]).select("p_partkey", "alias", (F.col("j") + 1).cast("long").alias("first_at"))


@query("select source, count(distinct t) as n_tokens from (select source, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 3)) as t from documents) group by source")
def signal_tokens(spark, sf_dir):
    """Distinct signal tokens of every source."""
    t = table(spark, sf_dir, "documents").select("source", F.explode(X.signal_tokens(F.col("text"))).alias("t")).distinct()
    return t.groupBy("source").agg(F.count("*").alias("n_tokens"))


@query("select doc_id, count(distinct t) as n_terms from (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}'))) as t from documents) where t not in ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'function', 'class') group by doc_id")
def term_sets(spark, sf_dir):
    """Size of every document's term set."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.terms(F.col("text"))).cast("long").alias("n_terms")).where("n_terms > 0")


@query(f"select n as df, count(*) as n_terms from (select term, count(distinct doc_id) as n from (select doc_id, unnest({tokens_sql()}) as term from documents) group by term) group by n")
def posting_histogram(spark, sf_dir):
    """How many terms have postings of each length."""
    posts = R.postings(table(spark, sf_dir, "documents"), ["doc_id"], X.identifier_bag(F.col("text")))
    return R.document_frequency(posts).groupBy("df").agg(F.count("*").alias("n_terms"))


@query(f"select lang, round(avg(len({tokens_sql()})), 6) as avg_len, count(*) as n_docs from documents group by lang")
def avg_doc_len(spark, sf_dir):
    """Mean length in tokens by language, empty documents included."""
    d = table(spark, sf_dir, "documents").select("lang", F.size(X.identifier_bag(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("avg_len"), F.count("*").alias("n_docs"))


def bm25_sql(docs: str, queries: str, k: int, part: str = "0", having: str = "") -> str:
    """docs: doc_id, text, part; queries: query_id, text, part."""
    return f"""
d as (select doc_id, {part} as part, {tokens_sql()} as t from {docs}),
stats as (select part, count(*) as n, greatest(avg(len(t)), 1e-9) as avgdl from d group by part),
q as (select query_id, part, term, least(count(*), 3) as qf from (select query_id, {part} as part, unnest({tokens_sql()}) as term from {queries}) group by query_id, part, term),
tf as (select doc_id, part, dl, term, count(*) as tf from (select doc_id, part, len(t) as dl, unnest(t) as term from d) where term in (select term from q) group by all),
df as (select part, term, count(*) as df from tf group by part, term),
hits as (
  select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * qf), 6) as score
  from tf join df using (part, term) join stats using (part) join q using (part, term) group by query_id, doc_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits where score > 0),
bm25 as (select query_id, doc_id, score, rank from ranked where rank <= {k})"""


_BENCH = "(select item_id as query_id, text from benchmark)"


@query(f"with {bm25_sql('documents', _BENCH, 10)} select * from bm25")
def bm25_topk(spark, sf_dir):
    """Ten best documents for every benchmark item."""
    return R.bm25(table(spark, sf_dir, "documents"), _items(spark, sf_dir), 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"with {bm25_sql('documents', '(select item_id as query_id, text, lang from benchmark, (select distinct lang from documents))'.replace('item_id as query_id', "item_id || '/' || lang as query_id"), 5, 'lang')} select * from bm25")
def bm25_by_lang_partition(spark, sf_dir):
    """Five best documents of each language for every item, by statistics of the language's own corpus."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").crossJoin(docs.select("lang").distinct())
    q = items.select(F.concat_ws("/", F.col("item_id").cast("string"), "lang").alias("query_id"), "text", "lang")
    return R.bm25(docs, q, 5, within="lang").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {bm25_sql("documents", _BENCH, 40)},
m as (select b.query_id, b.doc_id, b.score, lang = 'en' as ok, max(lang = 'en') over (partition by b.query_id) as any_ok from bm25 b join documents using (doc_id)),
r as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from m where ok or not any_ok)
select * from r where rank <= 10"""
)
def bm25_filtered_fallback(spark, sf_dir):
    """English hits only, unless a query has none among its forty best."""
    docs = table(spark, sf_dir, "documents")
    hits = R.bm25(docs, _items(spark, sf_dir), 40)
    found = R.filtered_or_all(hits, docs.where("lang = 'en'"), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with whole as (select cast(regexp_replace(source, 'src', '') as bigint) as doc_id, string_agg(text, chr(10) order by doc_id) as text from documents group by source),
first as (with {bm25_sql("whole", _BENCH, 40)} select query_id, doc_id as src from bm25),
restricted as (select query_id as part_id, doc_id, text from documents join first on 'src' || src = source),
second as (with {bm25_sql("restricted", "(select query_id, text, query_id as part_id from " + _BENCH + ")", 15, "part_id")} select * from bm25)
select * from second"""
)
def cascade_retrieval(spark, sf_dir):
    """Forty best sources, then fifteen best documents in them with the restricted corpus's statistics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("source", "src", "").cast("long").alias("src"))
    found = R.cascade(docs, _items(spark, sf_dir), "src", pool=40, k=15)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _stored(spark, docs, *parts):
    """An index of documents in two batches, in the shared folder."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return PostingIndex.build(docs.where(half), path, parts).append(docs.where(~half))


@query(f"with {bm25_sql('documents', _BENCH, 10)} select * from bm25")
def index_topk(spark, sf_dir):
    """Ten best documents for every benchmark item from a stored index, by the ranges whose bounds reach them."""
    found = _stored(spark, table(spark, sf_dir, "documents")).search(_items(spark, sf_dir), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_LONG = "(select item_id as query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')))[1:3], ' ') as text from benchmark)"


@query(f"with {bm25_sql('documents', _LONG, 10)} select * from bm25")
def index_short_queries(spark, sf_dir):
    """The same for queries of three long words of each item."""
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))), 1, 3)
    found = _stored(spark, table(spark, sf_dir, "documents")).search(_items(spark, sf_dir).select("query_id", F.array_join(words, " ").alias("text")), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(ORACLE_SQL["cascade_retrieval"])
def index_cascade(spark, sf_dir):
    """The cascade of sources and documents from a stored index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("source", "src", "").cast("long").alias("src"))
    found = R.cascade(_stored(spark, docs, "src"), _items(spark, sf_dir), "src", pool=40, k=15)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(ORACLE_SQL["posting_histogram"])
def index_posting_lengths(spark, sf_dir):
    """How many terms have postings of each length, from the heads of a stored index's blocks."""
    df = _stored(spark, table(spark, sf_dir, "documents")).blocks().where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    return df.groupBy("df").agg(F.count("*").alias("n_terms"))


_DENSE = """e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, label, list_transform(v, lambda x: x / case when sqrt(list_inner_product(v, v)) = 0 then 1 else sqrt(list_inner_product(v, v)) end) as v from e),
s as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_inner_product(q.v, d.v), 6) as score from u q join u d on true where q.vec_id % 50 = 0),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10)"""


def dense_hits(spark, sf_dir, k=10):
    e = table(spark, sf_dir, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.dense(docs, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


@query(f"with {_DENSE} select query_id, doc_id, score, rank from dense")
def dense_topk(spark, sf_dir):
    """Ten nearest vectors by cosine for every fiftieth vector, among all."""
    return dense_hits(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_DENSE} select query_id, doc_id, score, rank from dense")
def vector_index_topk(spark, sf_dir):
    """The same from a stored index, by cells that can hold one of the ten."""
    e = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    found = index.search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_DENSE} select query_id, doc_id, score from s where score >= 0.25 and query_id <> doc_id")
def dense_pair_threshold(spark, sf_dir):
    """Pairs of the query vectors and all others with a cosine of 0.25 or more."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return R.near_pairs(e.withColumnRenamed("vec_id", "doc_id"), e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 0.25)


@query(
    f"""with {bm25_sql("documents", _BENCH, 20)},
other as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
  select query_id, doc_id, round(cast(list_sum(list_transform(list_intersect(q, t), lambda x: 1)) as double) / len(q), 6) as score
  from (select item_id as query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 6)) as q from benchmark),
    (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 6)) as t from documents) where len(list_intersect(q, t)) > 0) qualify rank <= 20),
both_ as (select * from bm25 union all select * from other),
f as (select query_id, doc_id, round(sum(1.0e0 / (60 + rank)), 6) as score, min(rank) as best_rank from both_ group by query_id, doc_id),
r as (select *, row_number() over (partition by query_id order by score desc, best_rank, doc_id) as rank from f)
select query_id, doc_id, score, best_rank, rank from r where rank <= 15"""
)
def rrf_fusion(spark, sf_dir):
    """Fusion of two rankings over whole texts, by BM25 and by the share of an item's long signal tokens."""
    docs, items = table(spark, sf_dir, "documents"), _items(spark, sf_dir)
    fused = R.reciprocal_rank_fusion(R.bm25(docs, items, 20).select("query_id", "doc_id", "rank").unionByName(R.token_share(docs, items, 20, least=6).select("query_id", "doc_id", "rank")))
    return fused.select("query_id", "doc_id", "score", F.col("best_rank").cast("long").alias("best_rank"), F.col("rank").cast("long").alias("rank"))


@query(r"select symbol, count(*) as n from (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda t: regexp_matches(t, '[A-Z_$]')))) as symbol from documents) group by symbol")
def identifier_symbols(spark, sf_dir):
    """R16 (its identifiers): documents of every symbol with a capital, underscore or dollar."""
    names = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)), lambda t: t.rlike("[A-Z_$]")))
    return table(spark, sf_dir, "documents").select(F.explode(names).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    r"""with p as (select page_id, '.\src/' || regexp_replace(url, '^[a-z]+://', '') as path from pages),
n as (select page_id, regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '^[./]+', ''), '^[ab]/', '') as path from p)
select page_id, path, case when regexp_matches(path, '\.html$') then 'html' when contains(path, '/fr/') then 'fr' else '' end as kind from n"""
)
def path_normalize(spark, sf_dir):
    """Addresses as paths, normalised."""
    p = table(spark, sf_dir, "pages").select("page_id", X.normalize_path(F.concat(F.lit(".\\src/"), F.regexp_replace("url", "^[a-z]+://", ""))).alias("path"))
    return p.select("page_id", "path", F.when(F.col("path").rlike(r"\.html$"), "html").when(F.contains(F.col("path"), F.lit("/fr/")), "fr").otherwise("").alias("kind"))


_SUFFIX = "case p_partkey % 7 when 0 then '.ts' when 1 then '.JSX' when 2 then '.py' when 3 then '.java' when 4 then '.md' when 5 then '.mts' else '' end"


@query(f"select regexp_extract(p, '[^/]*$') as name, case when regexp_matches(lower(p), '\\.(ts|tsx|mts|cts)$') then 'typescript' when regexp_matches(lower(p), '\\.(js|jsx|mjs|cjs)$') then 'javascript' when regexp_matches(lower(p), '\\.py$') then 'python' when regexp_matches(lower(p), '\\.java$') then 'java' else '' end as language from (select replace(p_name, ' ', '_') || p_partkey || {_SUFFIX} as p from part)")
def language_case(spark, sf_dir):
    """language of part names made into files."""
    p = table(spark, sf_dir, "part").select(F.expr(f"concat(replace(p_name, ' ', '_'), p_partkey, {_SUFFIX})").alias("p"))
    return p.select(F.regexp_extract("p", "[^/]*$", 0).alias("name"), X.language_of(F.col("p")).alias("language"))


@query(r"select page_id from pages where regexp_matches(url, '^(?s:http.*/fr/.*[0-9][02468])$') union all select page_id from pages where contains(url, 'blog') and not regexp_matches(url, '^(?s:http.*/fr/.*[0-9][02468])$')")
def glob_filter(spark, sf_dir):
    """by a glob, or by a substring."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").where(X.matches_path(u, "http*/fr/*[0-9][02468]") | X.matches_path(u, "blog")).select("page_id")


@query(r"select coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ''), '<unknown>') as domain, count(*) as n from pages group by 1")
def url_domain_counts(spark, sf_dir):
    """Pages of every domain."""
    return table(spark, sf_dir, "pages").groupBy(X.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(r"""select page_id, count(distinct h) as n_links, count(distinct h) filter (regexp_matches(h, '^https?://')) as n_absolute from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as h from pages) group by page_id""")
def href_split(spark, sf_dir):
    """Distinct links of every page, and those that are absolute."""
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("h"))
    return h.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("h").rlike("^https?://")).alias("n_absolute"))


@query(r"""select class, count(*) as n_pages from (select distinct page_id, unnest(list_filter(string_split_regex(v, '\s+'), lambda t: t <> '')) as class from (select page_id, trim(unnest(regexp_extract_all(html, 'class\s*=\s*[''"]([^''"]+)[''"]', 1))) as v from pages)) group by class""")
def dom_class_extract(spark, sf_dir):
    """Pages of every DOM class."""
    c = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.filter(F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"class\s*=\s*['\"]([^'\"]+)['\"]"), F.lit(1)), lambda v: F.split(F.trim(v), r"\s+"))), lambda t: t != ""))).alias("class"))
    return c.groupBy("class").agg(F.count("*").alias("n_pages"))


@query(r"select class, count(distinct page_id) as n_pages from (select page_id, unnest(regexp_extract_all(html, '\.([a-zA-Z0-9_-]+)', 1)) as class from pages) group by class")
def css_class_extract(spark, sf_dir):
    """Pages of every name after a dot."""
    return table(spark, sf_dir, "pages").select(F.explode(X.css_classes(F.col("html"))).alias("class")).groupBy("class").agg(F.count("*").alias("n_pages"))


@query(
    r"""with d as (select doc_id, string_split(text, chr(10)) as l from documents),
c as (select doc_id, a + 1 as line_from, least(a + 12, len(l)) as line_to, trim(array_to_string(l[a + 1:a + 12], chr(10)), ' ') as chunk from d, unnest(range(0, len(l), 10)) as u(a))
select doc_id, line_from, line_to, md5(chunk) as chunk from c where chunk <> ''"""
)
def chunk_lines_overlap(spark, sf_dir):
    """Windows of twelve lines, ten apart."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.line_windows(F.col("text"), 12, 10)).alias("c"))
    return c.select("doc_id", F.col("c.start").cast("long").alias("line_from"), F.col("c.end").cast("long").alias("line_to"), F.md5("c.chunk").alias("chunk"))


@query(
    r"""with d as (select doc_id, string_split(text, chr(10)) as l from documents)
select doc_id, a + 1 as line_from, least(a + 5, len(l)) as line_to, md5(array_to_string(l[a + 1:a + 5], chr(10))) as chunk from d, unnest(range(0, len(l), 5)) as u(a)"""
)
def chunk_fixed(spark, sf_dir):
    """Groups of five lines."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.fixed_chunks(F.col("text"), 5)).alias("c"))
    return c.select("doc_id", F.col("c.start").cast("long").alias("line_from"), F.col("c.end").cast("long").alias("line_to"), F.md5("c.chunk").alias("chunk"))


@query(
    """with n as (select s_suppkey, lower(s_name) as x from supplier), p as (select distinct lower(p_name) as y from part),
d as (select s_suppkey, y, case when contains(x, y) or contains(y, x) then 0.0e0 else levenshtein(x, y) / greatest(length(x), length(y)) end as d from n, p),
r as (select s_suppkey, y as name, round(d, 6) as distance, row_number() over (partition by s_suppkey order by round(d, 6), y) as rank from d)
select s_suppkey, name, distance, rank from r where rank <= 5"""
)
def lev_search(spark, sf_dir):
    """Five part names nearest to each supplier's name."""
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("query"))
    found = R.nearest_names(table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")), q, "s_suppkey", 5)
    return found.select("s_suppkey", "name", "distance", F.col("rank").cast("long").alias("rank"))


@query(
    r"""with n as (select conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda t: t not in ('', 'a', 'an', 'the', 'usd')) as t from conversations)
select conv_id, turn, array_to_string(t, ' ') as answer from n"""
)
def answer_normalize(spark, sf_dir):
    """Normalised answers."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("answer"))
