"""Typed property graphs as two DataFrames: nodes (id, type, ...) and edges (src, dst, type, ...).

Traversal is breadth first, level by level: the frontier joins the edges, and nodes already reached by the root are
removed by an anti-join. Deep traversals cut their lineage every CUT levels.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.rank import ranked
from weftline.session import cut

CUT = 4
UNBOUNDED = 20
UNREACHED = 999_999


def adjacency(edges: DataFrame) -> DataFrame:
    """G05. node, other, type, direction: each edge from both of its ends; blank ends are dropped."""
    clean = edges.where((F.trim("src") != "") & (F.trim("dst") != ""))
    return clean.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction")).unionByName(clean.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit("in").alias("direction")))


def neighbors(edges: DataFrame, nodes: DataFrame, edge_types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
    """J12. node, other, type, direction, other_type: one row for each edge, of some types."""
    a = adjacency(edges)
    if edge_types is not None:
        a = a.where(F.col("type").isin(*edge_types))
    n = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"))
    if node_types is not None:
        n = n.where(F.col("other_type").isin(*node_types))
    return a.join(n, "other").select("node", "other", "type", "direction", "other_type")


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    src, dst = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()


def reach(edges: DataFrame, roots: DataFrame, hops: int | None = -1, direction: str = "down", types: list[str] | None = None) -> DataFrame:
    """G01. root, node, depth: least depth of every node within so many hops (-1: UNBOUNDED; None: as
    many as there are) of roots (root).

    "both" is what is below together with what is above, not an undirected walk.
    """
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    if direction == "both":
        down, up = reach(edges, roots, hops, "down"), reach(edges, roots, hops, "up")
        return down.unionByName(up).groupBy("root", "node").agg(F.min("depth").alias("depth"))
    step = _oriented(edges, direction)
    frontier = roots.select("root", F.col("root").alias("node")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in count(1) if hops is None else range(1, (UNBOUNDED if hops == -1 else hops) + 1):
        found = frontier.join(step, frontier["node"] == step["a"]).select("root", F.col("b").alias("node")).distinct()
        frontier = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        if depth % CUT == 0:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
            seen = cut(seen)
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen


def shortest_hops(edges: DataFrame, pairs: DataFrame, hops: int | None = -1) -> DataFrame:
    """G06. a, b, hops: the lesser of a to b and b to a, or UNREACHED.

    The search starts from the side with fewer distinct nodes, in both directions.
    """
    few, many = ("a", "b") if pairs.select("a").distinct().count() <= pairs.select("b").distinct().count() else ("b", "a")
    found = reach(edges, pairs.select(F.col(few).alias("root")), hops, "both")
    joined = pairs.join(found, (pairs[few] == found["root"]) & (pairs[many] == found["node"]), "left")
    return joined.select("a", "b", F.coalesce("depth", F.lit(UNREACHED)).cast("long").alias("hops"))


def get_nodes(nodes: DataFrame, holds) -> DataFrame:
    """F10, X03. Nodes for which a predicate, given a function from a column's name to its Column, holds."""
    return nodes.where(holds(_Fields()))


def get_edges(edges: DataFrame, holds) -> DataFrame:
    """F10, X03. Edges for which a predicate holds."""
    return edges.where(holds(_Fields()))


class _Fields:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G07, G17. Edges with both ends among the nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def pattern(edges: DataFrame, nodes: DataFrame, source: Column, relation: Column, target: Column, most: int | None = None) -> DataFrame:
    """J13. Edges whose ends (columns s_* and t_*) and relation meet conditions, by source and target, the first ones."""
    s, t = (nodes.select(*(F.col(c).alias(f"{x}_{c}") for c in nodes.columns)) for x in ("s", "t"))
    found = edges.where(relation).join(s.where(source), F.col("src") == F.col("s_id")).join(t.where(target), F.col("dst") == F.col("t_id"))
    return found if most is None else found.orderBy("src", "dst", "type").limit(most)


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """G09. node and the sorted distinct sources of its edges."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("sources"))


def membership_parent(edges: DataFrame, relation: str = "contains") -> DataFrame:
    """G08. The least parent of every contained node."""
    return edges.where(F.col("type") == relation).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))


def path_chain(paths: DataFrame, column: str = "path") -> DataFrame:
    """G14. Containment edges of all folders and files of slash-separated paths."""
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    prefix = lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n))
    links = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.struct(prefix(n).alias("src"), prefix(n + 1).alias("dst"), F.lit("contains").alias("type")))
    return paths.select(F.inline(links)).distinct()


def all_paths(edges: DataFrame, roots: DataFrame, hops: int, separator: str = "/") -> DataFrame:
    """G03. root, node, depth, path of every path within so many hops: nodes may repeat, only the hops bound it."""
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.col("root").alias("path"))
    out = frontier
    for depth in range(1, hops + 1):
        frontier = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat_ws(separator, "path", "dst").alias("path"))
        if depth % CUT == 0:
            frontier = cut(frontier)
        out = out.unionByName(frontier)
    return out


def tree_text(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """G02, G13. root and an indented listing below it, children in order of name."""
    lines = all_paths(edges, roots, hops, "\u0001")
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), "node")
    return lines.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", text.alias("line")))), lambda x: x["line"]), "\n").alias("tree"))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node and label, the least node that edges in whatever direction join it to.

    Each round, a node and the node that is its label take the least label around it, and labels follow their own labels,
    so that the rounds grow with the logarithm of the longest path. rounds, if given, gets the number of each.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for n in count(1):
        told = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        around = labels.join(told, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("near"))
        hooked = around.select("node", "near").unionByName(around.where("near < label").select(F.col("label").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("new"))
        own = hooked.select(F.col("node").alias("m"), F.col("new").alias("far"))
        jumped = hooked.join(own, F.col("new") == F.col("m"), "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"))
        after = cut(jumped.join(labels, "node").select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if rounds is not None:
            rounds.append(n)
        if after.where("moved").isEmpty():
            return labels


def undirected_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """G25. Nodes joined to any root (id) by edges in whatever direction, by components: no step is made for each hop."""
    labels = components(edges)
    asked = roots.select(F.col("id").alias("node")).distinct()
    chosen = asked.join(labels, "node").select("label").distinct()
    return labels.join(chosen, "label", "left_semi").select("node").unionByName(asked).distinct()


def stars(edges: DataFrame, roots: DataFrame, most: int = 3) -> DataFrame:
    """G20. Distinct node sets (sorted, comma-joined) of roots (id) with their first incident edges by (pos)."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "pos").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "pos"))
    w = Window.partitionBy("id").orderBy("pos", "other")
    kept = both.join(roots, "id", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    sets = kept.groupBy("id").agg(F.array_sort(F.array_union(F.collect_set("other"), F.array(F.first("id")))).alias("nodes"))
    return sets.groupBy(F.array_join("nodes", ",").alias("signature")).agg(F.min("id").alias("root"))


def normalize_scene(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G19. Nodes (pos, id, type, text, role) and edges (pos, src, dst, relation) of a scene, cleaned.

    A missing id becomes node_<n>, a repeated one <id>_<n>; nodes of equal type and lower-case text merge into the first,
    a root's role wins; relations become lower snake case, related_to by default; edges to ids that are gone are dropped.
    """
    named = ranked(nodes, F.col("pos")).withColumnRenamed("rank", "n").withColumn("base", F.when(F.trim(F.coalesce("id", F.lit(""))) == "", F.concat(F.lit("node_"), F.col("n").cast("string"))).otherwise(F.trim("id")))
    again = F.row_number().over(Window.partitionBy("base").orderBy("pos"))
    fixed = named.withColumn("again", again).withColumn("id", F.when(F.col("again") > 1, F.concat_ws("_", "base", F.col("again").cast("string"))).otherwise(F.col("base")))
    own = Window.partitionBy("type", F.lower(F.trim("text")))
    merged = fixed.withColumn("first", F.row_number().over(own.orderBy("pos"))).withColumn("is_root", F.max((F.col("role") == "root").cast("int")).over(own))
    kept = merged.where("first = 1").select("pos", "id", "type", "text", F.when(F.col("is_root") == 1, "root").otherwise(F.col("role")).alias("role"))
    relation = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("relation", F.lit("")))), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    clean = edges.withColumn("relation", F.when(relation == "", "related_to").otherwise(relation))
    ids = kept.select("id")
    live = clean.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, live.groupBy("src", "dst", "relation").agg(F.min("pos").alias("pos"))


def _graph_by_graph(edges: DataFrame, key: str, order: Callable[[list[tuple]], list[str]]) -> DataFrame:
    """key, node, rank by order(rows) of each graph's rows (without the key); graphs stream through tasks one behind the
    other, so that small ones cost no table of their own, and a task holds one."""
    spark = edges.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be merged into fewer
    kind = dict(edges.dtypes)[key]
    rows = edges.select(key, *(c for c in edges.columns if c != key)).repartition(tasks, key).sortWithinPartitions(key)

    def run(batches):
        import pyarrow as pa

        kinds, none = [], object()

        def groups():
            at, own = none, []
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at is none or not (k == at or (k != k and at != at)):
                        if own:
                            yield at, own
                        at, own = k, []
                    own.append(tuple(row))
            if own:
                yield at, own

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kinds[0]), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=[key, "node", "rank"])

        out = []
        for k, own in groups():
            out += [(k, n, i + 1) for i, n in enumerate(order(own))]
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return rows.mapInArrow(run, f"`{key}` {kind}, node string, rank long")


def topological_order(edges: DataFrame, key: str) -> DataFrame:
    """W25. key, node, rank for each graph: least node first among those without open predecessors; where a cycle leaves
    none, the node with fewest open predecessors (then the least) goes. One graph is one group."""
    import heapq

    def order(rows: list[tuple]) -> list[str]:
        after: dict[str, set[str]] = {}
        for a, b in rows:
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
        degree = dict.fromkeys(after, 0)
        for own in after.values():
            for b in own:
                degree[b] += 1
        heap, out = [(d, n) for n, d in degree.items()], []
        heapq.heapify(heap)
        done: set[str] = set()
        while heap:
            d, n = heapq.heappop(heap)
            if n in done or d != degree[n]:
                continue
            done.add(n)
            out.append(n)
            for b in after[n] - done:
                degree[b] -= 1
                heapq.heappush(heap, (degree[b], b))
        return out

    return _graph_by_graph(edges.select(key, "src", "dst"), key, order)


def best_first(edges: DataFrame, key: str, root: str, most: int = 20) -> DataFrame:
    """G18. key, node, rank: expansion of each graph from its root column; of open nodes the one with the largest
    out-edge weight goes next, earlier found ones first on ties."""
    import heapq

    def expand(rows: list[tuple]) -> list[str]:
        out_edges: dict[str, list[tuple[float, str]]] = {}
        for a, b, w in sorted((a, b, float("nan") if w is None else w) for a, b, w, _ in rows):
            out_edges.setdefault(a, []).append((w, b))
        worth = {n: max(w for w, _ in own) for n, own in out_edges.items()}
        start = rows[0][3]
        heap, found, order = [(-worth.get(start, 0.0), 0, start)], {start}, []
        while heap and len(order) < most:
            _, _, n = heapq.heappop(heap)
            order.append(n)
            for _, b in out_edges.get(n, []):
                if b not in found:
                    found.add(b)
                    heapq.heappush(heap, (-worth.get(b, 0.0), len(found), b))
        return order

    return _graph_by_graph(edges.select(key, "src", "dst", "weight", root), key, expand)
