"""Queries over graphs and intervals made of the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import intervals as I
from weftline.plans.registry import query
from weftline.session import table

# region -contains-> nation -contains-> customer -places-> order -references-> part
_EDGES = """edges as (
  select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 'contains' as type from nation
  union select 'n' || c_nationkey, 'c' || c_custkey, 'contains' from customer
  union select 'c' || o_custkey, 'o' || o_orderkey, 'places' from orders
  union select 'o' || l_orderkey, 'p' || l_partkey, 'references' from lineitem)"""
_NODES = """nodes as (
  select 'r' || r_regionkey as id, 'region' as type, r_name as label from region
  union all select 'n' || n_nationkey, 'nation', n_name from nation
  union all select 'c' || c_custkey, 'customer', c_mktsegment from customer
  union all select 'o' || o_orderkey, 'order', o_orderpriority from orders
  union all select 'p' || p_partkey, 'part', p_brand from part)"""


def edges(spark, sf_dir, levels=4):
    def link(name, a, b, kind, x, y):
        return table(spark, sf_dir, name).select(F.concat(F.lit(x), F.col(a)).alias("src"), F.concat(F.lit(y), F.col(b)).alias("dst"), F.lit(kind).alias("type"))

    own = [link("nation", "n_regionkey", "n_nationkey", "contains", "r", "n"), link("customer", "c_nationkey", "c_custkey", "contains", "n", "c"), link("orders", "o_custkey", "o_orderkey", "places", "c", "o"), link("lineitem", "l_orderkey", "l_partkey", "references", "o", "p")]
    out = own[0]
    for x in own[1:levels]:
        out = out.unionByName(x)
    return out.distinct()


def nodes(spark, sf_dir):
    own = [("region", "r", "r_regionkey", "region", "r_name"), ("nation", "n", "n_nationkey", "nation", "n_name"), ("customer", "c", "c_custkey", "customer", "c_mktsegment"), ("orders", "o", "o_orderkey", "order", "o_orderpriority"), ("part", "p", "p_partkey", "part", "p_brand")]
    out = None
    for name, x, k, kind, label in own:
        df = table(spark, sf_dir, name).select(F.concat(F.lit(x), F.col(k)).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"with {_EDGES}, {_NODES}, a as (select src as node, dst as other, type, 'out' as direction from edges union all select dst, src, type, 'in' from edges) select node, other, a.type, direction, n.type as other_type from a join nodes n on n.id = other where a.type in ('contains', 'places') and n.type <> 'order'")
def graph_neighbors(spark, sf_dir):
    """Neighbours both ways by some edge and node types."""
    return G.neighbors(edges(spark, sf_dir), nodes(spark, sf_dir), ["contains", "places"], ["region", "nation", "customer", "part"])


_DOWN = "select {a} as root, {b} as node, 1 as depth from edges where starts_with({a}, '{x}') union select r.root, e.{d}, r.depth + 1 from reach r join edges e on e.{s} = r.node where r.depth < {hops}"


def _reach_sql(root_type, prefix, hops, up=False):
    s, d = ("dst", "src") if up else ("src", "dst")
    return f"reach as ({_DOWN.format(a=s, b=d, x=prefix, d=d, s=s, hops=hops)})"


@query(f"with recursive {_EDGES}, {_reach_sql('region', 'r', 3)} select root, node, min(depth)::bigint as depth from reach group by root, node union all select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region")
def graph_khop_down(spark, sf_dir):
    """What regions reach in three hops."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return G.reach(edges(spark, sf_dir), roots, 3, "down").withColumn("depth", F.col("depth").cast("long"))


@query(f"with recursive {_EDGES}, {_reach_sql('part', 'p', 2, up=True)} select root, node, min(depth)::bigint as depth from reach group by root, node union all select 'p' || p_partkey, 'p' || p_partkey, 0 from part")
def graph_khop_up(spark, sf_dir):
    """Orders and customers above every part."""
    roots = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("root"))
    return G.reach(edges(spark, sf_dir), roots, 2, "up").withColumn("depth", F.col("depth").cast("long"))


@query(
    f"""with recursive {_EDGES}, d as (select src as root, dst as node, 1 as depth from edges where starts_with(src, 'c') union select r.root, e.dst, r.depth + 1 from d r join edges e on e.src = r.node where r.depth < 2),
u as (select dst as root, src as node, 1 as depth from edges where starts_with(dst, 'c') union select r.root, e.src, r.depth + 1 from u r join edges e on e.dst = r.node where r.depth < 2)
select root, node, min(depth)::bigint as depth from (select * from d union all select * from u union all select 'c' || c_custkey, 'c' || c_custkey, 0 from customer) group by root, node"""
)
def graph_khop_both(spark, sf_dir):
    """What lies two hops below and above every customer."""
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("root"))
    return G.reach(edges(spark, sf_dir), roots, 2, "both").withColumn("depth", F.col("depth").cast("long"))


@query(f"select 'r' || r_regionkey as a, 'o' || o_orderkey as b, case when n_regionkey = r_regionkey then 3 else 999999 end as hops from region, orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def graph_shortest_hops(spark, sf_dir):
    """Hops between every region and every order."""
    pairs = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("a")).crossJoin(table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("b")))
    return G.shortest_hops(edges(spark, sf_dir), pairs, 3)


@query(f"with {_EDGES}, {_NODES}, s as (select id from nodes where label in ('BUILDING', '1-URGENT', 'Brand#11') or type in ('region', 'nation')) select * from edges where src in (select id from s) and dst in (select id from s)")
def graph_induced(spark, sf_dir):
    """Edges within a set of nodes."""
    chosen = nodes(spark, sf_dir).where(F.col("label").isin("BUILDING", "1-URGENT", "Brand#11") | F.col("type").isin("region", "nation"))
    return G.induced(edges(spark, sf_dir), chosen)


@query(f"with {_EDGES}, {_NODES} select src, dst, e.type from edges e join nodes s on s.id = src join nodes t on t.id = dst where e.type = 'places' and s.type = 'customer' and s.label = 'BUILDING' and contains(t.label, 'URGENT')")
def graph_pattern(spark, sf_dir):
    """Urgent orders of one market segment."""
    found = G.pattern(edges(spark, sf_dir), nodes(spark, sf_dir), (F.col("s_type") == "customer") & (F.col("s_label") == "BUILDING"), F.col("type") == "places", F.contains("t_label", F.lit("URGENT")))
    return found.select("src", "dst", "type")


@query(f"with {_EDGES} select dst as node, string_agg(src, ',' order by src) as sources from (select distinct src, dst from edges) group by dst")
def graph_reverse_adj(spark, sf_dir):
    """Sorted sources of every node."""
    return G.reverse_adjacency(edges(spark, sf_dir)).select("node", F.concat_ws(",", "sources").alias("sources"))


@query(f"with {_EDGES} select dst as node, min(src) as parent from edges where type = 'contains' group by dst")
def graph_parent(spark, sf_dir):
    """Containing parent."""
    return G.membership_parent(edges(spark, sf_dir))


@query(
    r"""with p as (select distinct list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as a from pages)
select distinct array_to_string(a[1:k], '/') as src, array_to_string(a[1:k + 1], '/') as dst, 'contains' as type from p, unnest(range(1, len(a))) as u(k)"""
)
def graph_dirchain(spark, sf_dir):
    """Containment of the pages' address paths."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    return G.path_chain(paths)


_SMALL = """edges as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union select 'n' || s_nationkey, 's' || s_suppkey from supplier)"""


def _small(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return a.unionByName(b).distinct()


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))


@query(f"with recursive {_SMALL}, p as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 0 as depth, 'r' || r_regionkey as path from region union all select p.root, e.dst, p.depth + 1, p.path || '/' || e.dst from p join edges e on e.src = p.node where p.depth < 2) select root, node, depth::bigint as depth, path from p")
def graph_tree_json(spark, sf_dir):
    """Every path of two hops from regions to suppliers."""
    return G.all_paths(_small(spark, sf_dir), _regions(spark, sf_dir), 2).withColumn("depth", F.col("depth").cast("long"))


@query(f"with recursive {_SMALL}, p as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 0 as depth, 'r' || r_regionkey as path from region union all select p.root, e.dst, p.depth + 1, p.path || chr(1) || e.dst from p join edges e on e.src = p.node where p.depth < 2) select root, string_agg(repeat('  ', depth) || node, chr(10) order by path) as tree from p group by root")
def graph_tree_text(spark, sf_dir):
    """Indented listings."""
    return G.tree_text(_small(spark, sf_dir), _regions(spark, sf_dir), 2)


@query(f"with recursive {_SMALL}, b as (select src as x, dst as y from edges union select dst, src from edges), r as (select 'r0' as node union select b.y from r join b on b.x = r.node) select node from r")
def graph_undirected_reach(spark, sf_dir):
    """All that hangs together with region 0."""
    return G.undirected_reach(_small(spark, sf_dir), spark.createDataFrame([("r0",)], "id string"))


@query(
    f"""with {_SMALL}, o as (select *, row_number() over (order by src, dst) as pos from edges), b as (select src as id, dst as other, pos from o union all select dst, src, pos from o),
k as (select * from (select *, row_number() over (partition by id order by pos, other) as n from b where starts_with(id, 'n')) where n <= 3),
s as (select id, string_agg(x, ',' order by x) as signature from (select distinct id, other as x from k union select id, id from k) group by id)
select signature, min(id) as root from s group by signature"""
)
def graph_stars(spark, sf_dir):
    """Distinct stars of three edges around the nations."""
    from pyspark.sql import Window

    e = _small(spark, sf_dir).withColumn("pos", F.row_number().over(Window.orderBy("src", "dst")))
    return G.stars(e, table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))


def _customer_graphs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_custkey", F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("src"), F.concat(F.lit("s"), F.col("l_partkey") % 20).alias("dst"), F.col("l_quantity").alias("weight")).where("src <> dst")


@query()
def graph_topo_order(spark, sf_dir):
    """An order of every customer's supplier graph."""
    return G.topological_order(_customer_graphs(spark, sf_dir).distinct(), "o_custkey")


@query()
def graph_best_first(spark, sf_dir):
    """Best-first expansion of every customer's supplier graph from its least node."""
    from pyspark.sql import Window

    e = _customer_graphs(spark, sf_dir)
    return G.best_first(e.withColumn("root", F.min("src").over(Window.partitionBy("o_custkey"))), "o_custkey", "root")


_SPANS = "spans as (select o_custkey as g, o_orderkey as id, o_orderkey as pos, epoch(o_orderdate)::bigint // 86400 as start, epoch(o_orderdate)::bigint // 86400 + 10 + o_orderkey % 120 as fin from orders)"
_POINTS = "points as (select o_custkey as g, l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate)::bigint // 86400 as day from lineitem join orders on o_orderkey = l_orderkey)"


def _spans(spark, sf_dir):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), day.alias("start"), (day + 10 + F.col("o_orderkey") % 120).alias("end"))


def _points(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.select(F.col("o_custkey").alias("g"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.unix_timestamp("l_shipdate") / 86400).alias("at"))


@query(f"with {_SPANS}, {_POINTS} select g, day, id, count(*) as n from points join spans using (g) where day between start and fin group by g, day, id")
def interval_overlap(spark, sf_dir):
    """Shipping days within the customer's order spans."""
    found = I.containing(_points(spark, sf_dir), _spans(spark, sf_dir), "g")
    return found.groupBy("g", F.col("at").alias("day"), "id").agg(F.count("*").alias("n"))


@query(f"with {_SPANS}, {_POINTS}, d as (select distinct g, day from points), r as (select d.g, day, id, row_number() over (partition by d.g, day order by fin - start, start, pos) as n from d join spans s on s.g = d.g where day between start and fin) select g, day, id from r where n = 1")
def interval_innermost(spark, sf_dir):
    """The narrowest span around each of a customer's shipping days."""
    days = _points(spark, sf_dir).select("g", "at").distinct()
    return I.innermost(days, _spans(spark, sf_dir), "g", ["g", "at"]).select("g", F.col("at").alias("day"), "id")


@query(f"with {_SPANS}, r as (select i.id, o.id as parent, row_number() over (partition by i.id order by o.fin - o.start, -o.start, o.id) as n from spans i join spans o on i.g = o.g and o.start <= i.start and i.fin <= o.fin and o.fin - o.start > i.fin - i.start) select s.id, parent from spans s left join (select * from r where n = 1) using (id)")
def interval_parent(spark, sf_dir):
    """The narrowest span that strictly contains each span of a customer."""
    return I.parents(_spans(spark, sf_dir), "g").select("id", "parent")


@query(
    f"""with {_SPANS}, f as (select *, case when max(fin) over (partition by g order by start, fin, id rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as fresh from spans),
i as (select *, sum(fresh) over (partition by g order by start, fin, id rows unbounded preceding) as island from f)
select g, min(start) as start, max(fin) as "end", count(*) as n from i group by g, island"""
)
def merge_intervals(spark, sf_dir):
    """A customer's spans, merged."""
    return I.merge(_spans(spark, sf_dir), "g")


@query(
    """with l as (select l_orderkey as g, greatest(1, l_partkey % 500 - 20) as start, least(480, l_partkey % 500 + 20) as fin from lineitem),
f as (select *, case when max(fin) over (partition by g order by start, fin rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as fresh from l),
i as (select *, sum(fresh) over (partition by g order by start, fin rows unbounded preceding) as island from f)
select g, min(start) as start, max(fin) as "end", count(*) as n from i group by g, island"""
)
def context_windows(spark, sf_dir):
    """Windows of twenty lines around marked lines of files of 480 lines."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 500).alias("line"), F.lit(480).cast("long").alias("last"))
    return I.context_windows(l, "g")
