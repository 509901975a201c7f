"""Queries of code entities: predicates, alignment joins, listings and rankings, over entities made of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import code as C
from weftline.operators import graph as G
from weftline.operators import lookup as O
from weftline.operators import rank as K
from weftline.operators import retrieval as R
from weftline.operators import summary as S
from weftline.plans.registry import query
from weftline.session import table

_KIND = "case p_partkey % 4 when 0 then 'class' when 1 then 'method' when 2 then 'function' else 'file' end"
_ENT = f"""e as (select 'src/' || lower(p_brand) || '/f' || p_size || '.ts' as file, {_KIND} as kind, 'n' || p_partkey as name,
  case p_partkey % 4 when 1 then 'n' || (p_partkey - 1) || '.n' || p_partkey else 'n' || p_partkey end as qualified_name, cast(p_partkey as integer) as start_line, cast(p_partkey + p_size as integer) as end_line, p_partkey as pos from part)"""


def entities(spark, sf_dir):
    """The parts as entities: classes, methods (of the class before them), functions and files."""
    p = table(spark, sf_dir, "part")
    n = F.concat(F.lit("n"), "p_partkey")
    return p.select(
        F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/f"), "p_size", F.lit(".ts")).alias("file"),
        F.expr(_KIND).alias("kind"),
        n.alias("name"),
        F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("n"), F.col("p_partkey") - 1, F.lit("."), n)).otherwise(n).alias("qualified_name"),
        F.col("p_partkey").cast("int").alias("start_line"),
        (F.col("p_partkey") + F.col("p_size")).cast("int").alias("end_line"),
        F.col("p_partkey").alias("pos"),
    )


_NODES = "n as (select file || '::' || qualified_name as id, kind as type, name as label, name, file, start_line, end_line, pos from e)"
_EDGES = "g as (select distinct s.id as src, t.id as dst, case l_linenumber % 3 when 0 then 'references' when 1 then 'contains' else 'calls' end as type, l_linenumber * 300 as line from lineitem join n s on s.pos = l_partkey join n t on t.pos = 1 + l_suppkey)"


def nodes(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.select(X.entity_id(F.col("file"), F.col("qualified_name")).alias("id"), F.col("kind").alias("type"), F.col("name").alias("label"), "name", "file", "start_line", "end_line", "pos")


def edges(spark, sf_dir):
    n = nodes(spark, sf_dir).select("id", "pos")
    l = table(spark, sf_dir, "lineitem")
    s, t = n.select(F.col("id").alias("src"), F.col("pos").alias("a")), n.select(F.col("id").alias("dst"), F.col("pos").alias("b"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "references").when(F.col("l_linenumber") % 3 == 1, "contains").otherwise("calls")
    return l.join(s, F.col("l_partkey") == F.col("a")).join(t, F.col("l_suppkey") + 1 == F.col("b")).select("src", "dst", kind.alias("type"), (F.col("l_linenumber") * 300).alias("line")).distinct()


@query(f"with {_ENT}, {_NODES}, {_EDGES} select g.src, g.dst, g.type, s.file as s_file, t.file as t_file, line from g join n s on s.id = src join n t on t.id = dst where s.file <> t.file and line < s.start_line")
def cross_file_uses(spark, sf_dir):
    """Edges into other files that stand before their source begins."""
    return O.cross_file(edges(spark, sf_dir), nodes(spark, sf_dir), True).select("src", "dst", "type", "s_file", "t_file", F.col("line").cast("long").alias("line"))


@query(f"with {_ENT}, {_NODES}, {_EDGES} select distinct src as node, dst as other from g where type = 'references' union select distinct dst, src from g where type = 'contains'")
def code_dependencies(spark, sf_dir):
    """What every node references and what contains it."""
    return O.dependencies(edges(spark, sf_dir))


@query(f"with {_ENT}, c as (select file, qualified_name, start_line, end_line from e where kind = 'class'), m as (select file, regexp_replace(qualified_name, '\\.[^.]*$', '') as qualified_name, string_agg(name || ':' || start_line, ',' order by start_line) as methods from e where kind = 'method' group by all) select file, qualified_name, start_line, end_line, coalesce(methods, '') as methods from c left join m using (file, qualified_name)")
def classes_with_methods(spark, sf_dir):
    """classes with their methods."""
    spelled = F.array_join(F.transform("methods", lambda m: F.concat(m["name"], F.lit(":"), m["start_line"])), ",")
    return O.with_methods(entities(spark, sf_dir)).select("file", "qualified_name", "start_line", "end_line", F.coalesce(spelled, F.lit("")).alias("methods"))


@query(
    f"""with {_ENT}, k as (select case when kind = 'file' then [regexp_extract(file, '[^/]*$'), regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '')] else [name] end as names, file || '::' || qualified_name as id from e),
x as (select distinct unnest(list_distinct(list_concat(names, list_transform(names, lambda y: lower(y))))) as name, id from k)
select name, string_agg(id, ',' order by id) as ids from x group by name"""
)
def name_dictionary(spark, sf_dir):
    """Ids by name, base name and stem."""
    return O.name_index(entities(spark, sf_dir)).select("name", F.array_join("ids", ",").alias("ids"))


@query(f"with {_ENT}, {_NODES} select id, label, type from n where file = 'src/brand#11/f7.ts'")
def nodes_of_file(spark, sf_dir):
    """start nodes by their file."""
    return O.select_start(nodes(spark, sf_dir), file="src/brand#11/f7.ts").select("id", "label", "type")


@query(f"with {_ENT}, {_NODES}, {_EDGES} select 'node' as what, id as a, '' as b from n where type = 'class' and end_line - start_line > 25 union all select 'edge', src, dst from g where type = 'calls' and line > 600")
def predicate_filters(spark, sf_dir):
    """Nodes and edges by any predicate."""
    big = G.get_nodes(nodes(spark, sf_dir), lambda n: (n["type"] == "class") & (n["end_line"] - n["start_line"] > 25))
    late = G.get_edges(edges(spark, sf_dir), lambda e: (e["type"] == "calls") & (e["line"] > 600))
    return big.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(late.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"with {_ENT} select distinct file, name from e where (name like 'n1%' and kind <> 'file') and (pos % 2 = 0 or file like '%brand#1%')")
def sensitive_nodes(spark, sf_dir):
    """calls of watched names, some only in some files."""
    e = entities(spark, sf_dir)
    calls = e.select("file", "name", "kind", "pos").where("kind <> 'file'")
    watched = e.where("name like 'n1%'").select("name", F.when(F.col("pos") % 2 == 0, F.array().cast("array<string>")).otherwise(F.when(F.contains("file", F.lit("brand#1")), F.array("file")).otherwise(F.array(F.lit("other")))).alias("files"))
    return O.sensitive_calls(calls, watched).select("file", "name").distinct()


@query(f"with {_ENT}, {_NODES}, {_EDGES}, b as (select distinct dst as id from g where src = (select min(src) from g where type = 'contains') and type = 'contains') select n.id, n.type from n join b using (id) where type in ('function', 'method') or (type = 'class' and end_line - start_line <= 30)")
def children_of_node(spark, sf_dir):
    """Functions and short classes right below a node."""
    g = edges(spark, sf_dir)
    first = g.where("type = 'contains'").agg(F.min("src")).first()[0]
    return O.children(g, nodes(spark, sf_dir), first, 30).select("id", "type")


@query(f"with {_ENT}, {_NODES} select id, type from n where type = 'method' and end_line - start_line > 40 order by pos limit 1")
def first_method(spark, sf_dir):
    """The first node of a traversal that meets a condition."""
    return O.first_in_preorder(nodes(spark, sf_dir).withColumn("preorder", F.col("pos")), (F.col("type") == "method") & (F.col("end_line") - F.col("start_line") > 40)).select("id", "type")


@query(
    f"""with {_ENT}, {_NODES}, {_EDGES}, r as (select dst as node, min(case type when 'calls' then 1 when 'references' then 99 else 10 end) as place, min_by(type, case type when 'calls' then 1 when 'references' then 99 else 10 end) as via from g group by dst)
select id, type, label, 1 as depth, via from r join n on n.id = r.node order by place, case type when 'file' then 1 when 'class' then 2 when 'function' then 3 when 'method' then 3 else 99 end, label, id limit 50"""
)
def neighbors_in_order(spark, sf_dir):
    """Fifty neighbors by edge type, node type and label."""
    place = F.when(F.col("type") == "calls", 1).when(F.col("type") == "references", 99).otherwise(10)
    reached = edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.min_by("type", place).alias("via")).withColumn("depth", F.lit(1))
    return O.ordered_neighbors(reached, nodes(spark, sf_dir)).select("id", "type", "label", "depth", "via")


@query("select p_partkey as id, 100 - p_size - 50 + 40 * cast(p_partkey % 2 as integer) + 20 * cast(p_partkey % 3 as integer) as score, row_number() over (order by 100 - p_size - 50 + 40 * cast(p_partkey % 2 as integer) + 20 * cast(p_partkey % 3 as integer), p_partkey) as rank from part where p_size + 50 > 50")
def trace_combined(spark, sf_dir):
    """Calls by relevance, file and distance."""
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 50).alias("relevance"), (F.col("p_partkey") % 2 == 1).alias("other_file"), (F.col("p_partkey") % 3).cast("int").alias("layers"))
    return O.trace_scores(calls).select("id", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """with t as (select p_partkey, p_size, p_name, p_type, p_brand, ['steel', 'brushed', 'small'] as words from part)
select p_partkey, 5 + 3 * len(list_filter(words, lambda k: contains(lower(p_type), k))) + 2 * len(list_filter(words, lambda k: contains(lower(p_name), k))) + len(list_filter(words, lambda k: contains(lower(p_brand), k))) + case when p_size > 40 then 25 else 0 end as score from t"""
)
def node_scores(spark, sf_dir):
    """A prior, keywords in name, path and content, and anchors."""
    words = F.array(F.lit("steel"), F.lit("Brushed"), F.lit("small"))
    score = C.node_score(words, F.lit(5), F.col("p_type"), F.col("p_name"), F.col("p_brand"), F.col("p_size") > 40)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("int").alias("score"))


@query("with s as (select distinct 'd' || p_size || '/' || replace(p_brand, '#', '') as folder_stem, p_partkey % 3 as k from part), f as (select folder_stem || case k when 0 then '.ts' when 1 then '.css' else '.test.ts' end as file, folder_stem from s) select x.file as a, y.file as b from f x join f y using (folder_stem) where x.file <> y.file")
def files_beside(spark, sf_dir):
    """Files of one folder and stem."""
    k = F.col("p_partkey") % 3
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_size", F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.when(k == 0, ".ts").when(k == 1, ".css").otherwise(".test.ts")).alias("file")).distinct()
    return O.sibling_files(files)


@query(r"with f as (select 's/' || replace(s_name, '#', '_') || '-' || s_nationkey || 'key.py' as file from supplier), t as (select distinct file, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_extract(file, '[^/]*$'), '(.)\.[^.]*$', '\1')), '[^a-zA-Z0-9]'), lambda x: length(x) > 2 and not starts_with(x, 'supplier'))) as token from f) select distinct x.file as a, y.file as b from t x join t y using (token) where x.file <> y.file")
def files_alike(spark, sf_dir):
    """Files whose stems share a token, by tokens that not all have."""
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("-"), "s_nationkey", F.lit("key.py")).alias("file"))
    return O.related_files(files, least_share=0.5)


@query(
    f"""with {_ENT}, {_NODES}, a as (select c_custkey as anchor, 'n' || (c_custkey % 300) as token from customer where c_custkey % 4 < 3),
s as (select anchor, n.id, n.pos from a join n on n.name = a.token and length(token) >= 3)
select anchor, arg_min(id, pos) as id, 1 as score, 'low' as confidence from s group by anchor"""
)
def anchors_to_nodes(spark, sf_dir):
    """The code node of every named anchor."""
    anchors = table(spark, sf_dir, "customer").where("c_custkey % 4 < 3").select(F.col("c_custkey").alias("anchor"), F.concat(F.lit("see n"), F.col("c_custkey") % 300).alias("text"))
    own = nodes(spark, sf_dir).withColumn("file", F.lit("x.ts"))
    return O.anchor_matches(anchors, own).select("anchor", "id", F.col("score").cast("int").alias("score"), "confidence")


@query(
    """with m as (select c_custkey as anchor, 'c' || c_nationkey as id from customer), s as (select o_custkey as src, 1 + o_orderkey % 50 as dst, 'r' || o_orderkey % 2 as relation from orders),
g as (select 'c' || a.n_nationkey as src, 'c' || b.n_nationkey as dst, t as type from nation a join nation b on a.n_regionkey = b.n_regionkey, (values ('calls'), ('uses')) as v(t))
select distinct s.src, s.dst, relation, a.id as c_src, b.id as c_dst, case relation when 'r0' then 'uses' else 'calls' end as type from s join m a on a.anchor = s.src join m b on b.anchor = s.dst join g on g.src = a.id and g.dst = b.id"""
)
def relations_aligned(spark, sf_dir):
    """Scene relations whose matched ends have a code edge, with the preferred type."""
    n = table(spark, sf_dir, "nation")
    matches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("anchor"), F.concat(F.lit("c"), "c_nationkey").alias("id"))
    scene = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (1 + F.col("o_orderkey") % 50).alias("dst"), F.concat(F.lit("r"), F.col("o_orderkey") % 2).alias("relation"))
    pairs = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey")
    code = pairs.select(F.concat(F.lit("c"), "a").alias("src"), F.concat(F.lit("c"), "b").alias("dst"), F.explode(F.array(F.lit("calls"), F.lit("uses"))).alias("type"))
    preferred = spark.createDataFrame([("r0", "uses", 1), ("r0", "calls", 2)], "relation string, type string, rank int")
    return O.aligned_relations(scene, matches, code, preferred).select("src", "dst", "relation", "c_src", "c_dst", "type")


@query("select user_id, min_by(event_id, struct_pack(v := value, e := event_id)) as event_id, min(value) as value from events group by user_id")
def least_per_key(spark, sf_dir):
    """The row of the least score of every key."""
    return K.min_per_key(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("select l_returnflag as name, count(*) as calls, round(sum(l_extendedprice), 2) as cost, max(l_quantity) as most from lineitem group by l_returnflag")
def metrics_merged(spark, sf_dir):
    """Metrics of single runs, merged twice over."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.count("*").alias("calls"), F.sum("l_extendedprice").alias("cost"), F.max("l_quantity").alias("most"))
    odd, even = (S.merge_metrics(runs.where(F.col("l_orderkey") % 2 == k), ["name"], ["calls", "cost"], ["most"]) for k in (0, 1))
    return S.merge_metrics(odd.unionByName(even), ["name"], ["calls", "cost"], ["most"]).select("name", F.col("calls").cast("long").alias("calls"), F.round("cost", 2).alias("cost"), "most")


@query(
    f"""with {_ENT}, q as (select file, name, start_line, qualified_name, kind, case when name in ('n104', 'n1001', 'n37') then 1 else 0 end + case when regexp_matches(qualified_name, '^(n104|n1001|n37)\\.') then 1 else 0 end as overlap from e)
select file, name, overlap, rank from (select *, row_number() over (partition by file order by overlap desc, case when kind in ('function', 'method') then 1 else 0 end desc, start_line) as rank from q) where rank <= 10"""
)
def symbols_ranked(spark, sf_dir):
    """Symbols of every file by terms shared with a problem."""
    found = O.symbols_in_file(entities(spark, sf_dir), F.lit("n104 fails, as n1001 and n37"))
    return found.select("file", "name", F.col("overlap").cast("int").alias("overlap"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {_ENT}, q as (select *, case when name in ('n104', 'n1001', 'n37x') then 1 else 0 end + case when split_part(qualified_name, '.', 1) <> name and split_part(qualified_name, '.', 1) in ('n104', 'n1001') then 1 else 0 end
  + case when contains('n104 fails, as n1001 and n37x', name) then 3 else 0 end + case when contains('n104 fails, as n1001 and n37x', qualified_name) then 5 else 0 end as score from e)
select file, name, score, rank from (select *, row_number() over (order by score desc, end_line - start_line, start_line desc, qualified_name) as rank from q) where rank <= 15"""
)
def entities_ranked(spark, sf_dir):
    """Fifteen entities by what a context says of them."""
    found = C.rank_entities(entities(spark, sf_dir), F.lit("n104 fails, as n1001 and n37x"))
    return found.select("file", "name", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("select 'p' || p_size || '/' || lower(replace(p_brand, '#', '')) || '.ts' as path, count(*) as n, case when lower(replace(p_brand, '#', '')) in ('brand11', 'brand23') then 1 else 0 end as overlap, 2 as depth from part group by p_size, p_brand")
def files_by_mentions(spark, sf_dir):
    """Candidate files by frequency and shared terms."""
    c = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_size", F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".ts")).alias("path"), F.lit("brand11 and Brand23 fail").alias("said"))
    return C.rank_files(c, F.col("said")).select("path", "n", F.col("overlap").cast("int").alias("overlap"), F.col("depth").cast("int").alias("depth"))


@query("select n_name || ' -> ' || r_name as pair, '\"' || n_name || '\" -> \"' || r_name || '\" [label=\"in\"];' as value from nation join region on r_regionkey = n_regionkey")
def dot_edges(spark, sf_dir):
    """Edges of nations and regions as DOT statements."""
    from weftline.sources import io as I

    g = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("type"))
    return I.dot_lines(g).select(F.regexp_replace(F.regexp_replace("value", ' \\[.*', ""), '"', "").alias("pair"), "value")


@query("select 'o' || l_orderkey as node, string_agg('has p' || l_partkey, '; ' order by 'has p' || l_partkey) as incident from lineitem group by l_orderkey")
def incident_lists(spark, sf_dir):
    """Every order's items as a line of text."""
    from weftline.sources import io as I

    return I.incident_text(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("has").alias("type")))


@query(
    """with h as (select p_partkey as doc_id, p_brand as file, 'q' || p_type as query_id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rank from part),
b as (select query_id, file, min(rank) as best from h where rank <= 100 group by all)
select query_id, file, row_number() over (partition by query_id order by best) as rank from b"""
)
def files_of_hits(spark, sf_dir):
    """Files in the order of their best chunks among a hundred."""
    p = table(spark, sf_dir, "part")
    scored = p.select(F.concat(F.lit("q"), "p_type").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score"))
    hits = R.top_k(scored, 100, [F.desc("score"), F.col("doc_id")])
    return O.file_hits(hits, p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("file"))).select("query_id", "file", F.col("rank").cast("long").alias("rank"))
