"""Merkle manifest of a dataset, with an authentication path for every row.

A row's leaf is the SHA-256 of its fields. The leaves of each group (such as a language), by id, are joined two by two,
level by level, into the group's subroot, and the subroots, by the groups' names, likewise into the root; the last node of
a level of odd size is hashed by itself. All digests are lower-case hexadecimal text.

Leaves are cut into aligned blocks of 2**BLOCK. A block's paths come from a fractal traversal: its levels are bands of
BAND levels, and of each band the traversal holds the one subtree that the present leaf lies in (existing) and the next
one (desired), which a treehash of two steps a leaf has ready when it is needed. So a task holds a block's leaves and
some subtrees of 2**BAND nodes, whatever the dataset's size. Block roots are the leaves of the next level up, in blocks
again, until a group has one node; then the same goes for subroots. On the way back each block's own path, found one
level up, is appended to those of its leaves. Texts are hashed where they are read: what moves is a row of digests.

Defined results: null fields are "-", all others their length in UTF-8 bytes, a colon and themselves; rows of equal ids
follow each other by leaf; null ids come first; null is a group of its own, before the others (by UTF-8 bytes); a group
of one row has its leaf for subroot; equal rows have equal leaves, each with a path of its own; an empty table gives an
empty result; a very long text is one row's concern; columns other than the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordering import numbered
from weftline.llm.scratch import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block (so it has 1024 leaves) and of a band.
BLOCK, BAND = 10, 5
#: What stands before a sibling in a path: it is left or right of the node, or there is none.
LEFT, RIGHT, ALONE = "<", ">", "."
_NODE = "w_group string, place long, node string, total long"


def leaf(*fields: Column | str) -> Column:
    """Digest of a row's fields."""
    fields = [F.col(f"`{x}`") if isinstance(x, str) else x for x in fields]
    spelled = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*spelled), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    sibling = lambda s: F.substring(s, 2, 64)
    up = lambda node, s: F.sha2(F.when(F.startswith(s, F.lit(LEFT)), F.concat(sibling(s), node)).when(F.startswith(s, F.lit(RIGHT)), F.concat(node, sibling(s))).otherwise(node), 256)
    return F.aggregate(path, leaf, up)


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, in one string."""
    return F.concat_ws("", F.transform(path, lambda s: F.substring(s, 2, 64)))


def _joined(left: str | None, right: str | None) -> str | None:
    return None if left is None else hashlib.sha256((left + (right or "")).encode()).hexdigest()


def _levels(total: int) -> int:
    return max(total - 1, 0).bit_length()


def treehash(leaves: list[str], first: int, height: int, held: list[tuple[int, int, dict]]) -> Iterator[str | None]:
    """The node over 2**height leaves from first on, one unit of work (a leaf or a joint) at a time; the last one yielded is
    the node itself. What lies beyond the last leaf is None. held: (from level, to level, nodes) are filled on the way."""
    stack: list[tuple[int, str | None]] = []
    for j in range(first, first + (1 << height)):
        level, node = 0, leaves[j] if j < len(leaves) else None
        while True:
            for bottom, top, nodes in held:
                if bottom <= level < top:
                    nodes[level, j >> level] = node
            yield node
            if not stack or stack[-1][0] != level:
                break
            node, level = _joined(stack.pop()[1], node), level + 1
        stack.append((level, node))


def root(leaves: list[str], height: int) -> str:
    for node in treehash(leaves, 0, height, []):
        pass
    return node


def traversal(leaves: list[str], height: int, band: int = BAND) -> Iterator[list[str]]:
    """The paths of successive leaves of a tree of 2**height leaves at most, from the leaf up."""
    tops = [*range(band, height, band), height]
    bands = list(zip([0, *tops[:-1]], tops, strict=True))
    existing: list[dict] = [{} for _ in bands]
    setup = treehash(leaves, 0, height, [(bottom, top, nodes) for (bottom, top), nodes in zip(bands, existing, strict=True)])
    for _ in setup:  # of the first pass each band keeps what lies under its first subtree
        for (_, top), nodes in zip(bands, existing, strict=True):
            if nodes and (last := next(reversed(nodes)))[1] >> (top - last[0]):
                del nodes[last]
    desired: list[dict] = [{} for _ in bands]
    work = [treehash(leaves, 1 << top, top, [(bottom, top, nodes)]) for (bottom, top), nodes in zip(bands, desired, strict=True)]
    where = [i for i, (bottom, top) in enumerate(bands) for _ in range(bottom, top)]
    for j in range(len(leaves)):
        path = []
        for level in range(height):
            beside = (j >> level) ^ 1
            node = existing[where[level]].get((level, beside))
            path.append(ALONE if node is None else (LEFT if beside < j >> level else RIGHT) + node)
        yield path
        for i, (bottom, top) in enumerate(bands[:-1]):
            next(work[i], None), next(work[i], None)
            if not (j + 1) % (1 << top):
                existing[i], desired[i] = desired[i], {}
                work[i] = treehash(leaves, j + 1 + (1 << top), top, [(bottom, top, desired[i])])


def _block() -> Column:
    return F.shiftright("place", BLOCK).alias("block")


def _in_order(table: pa.Table) -> tuple[pa.Table, list[str], int]:
    table = table.sort_by("place")
    total = table.column("total")[0].as_py()
    return table, table.column("node").to_pylist(), min(BLOCK, _levels(total))


def _roots(nodes: DataFrame) -> DataFrame:
    """The nodes BLOCK levels up (fewer, where a group has only one left)."""

    def up(table: pa.Table) -> pa.Table:
        table, leaves, height = _in_order(table)
        total = table.column("total")[0].as_py()
        return pa.table({"w_group": table.column("w_group").slice(0, 1), "place": [table.column("block")[0].as_py()], "node": [root(leaves, height)], "total": [-(-total >> height) if height else total]})

    return nodes.withColumn("block", _block()).groupBy("w_group", "block").applyInArrow(lambda t: up(t), _NODE)


def _steps(nodes: DataFrame) -> list[DataFrame]:
    """nodes and their block roots of all levels; the last has one node a group."""
    steps = [nodes]
    while (steps[-1].agg(F.max("total")).first()[0] or 0) > 1:
        steps.append(cut(_roots(steps[-1])))
    return steps


def _paths(nodes: DataFrame, above: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """Paths of nodes: their own within the block, then that of the block; with columns of nodes (own) and those that above
    has besides w_group, place (of the block) and path."""
    told = [c for c in above.columns if c not in ("w_group", "place", "path")]
    kinds = dict(nodes.dtypes) | dict(above.dtypes)

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, leaves, height = _in_order(table)
        rest = upper.column("path")[0].as_py()
        found = pa.array([path + rest for path in traversal(leaves, height)], pa.list_(pa.string()))
        columns = {"w_group": table.column("w_group"), "place": table.column("place"), "path": found} | {c: table.column(c) for c in own}
        return pa.table(columns | {c: pa.repeat(upper.column(c)[0], table.num_rows) for c in told})

    left = nodes.withColumn("block", _block()).groupBy("w_group", "block")
    right = above.select(F.col("w_group").alias("g"), F.col("place").alias("b"), "path", *told).groupBy("g", "b")
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("w_group", "place", "path", *own, *told))
    return left.cogroup(right).applyInArrow(lambda a, b: down(a, b), schema)


def _way_down(steps: list[DataFrame], above: DataFrame, own: tuple[str, ...]) -> DataFrame:
    for nodes in reversed(steps[1:]):
        above = _paths(nodes, above)
    return _paths(steps[0], above, own)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", carried: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, leaf, subroot, root and path (siblings from the leaf to the root, each after the side it stands on), and
    what is carried along (columns of strings, by name)."""
    carried = carried or {}
    name = F.col(f"`{group_col}`").cast("string")
    group = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), group.alias("w_own"), leaf(*fields).alias("node"), *(v.cast("string").alias(k) for k, v in carried.items()))
    placed = numbered(rows, F.col("w_own"), F.col("id"), F.col("node")).drop("w_own")
    counts = placed.groupBy("w_group").agg(F.count("*").alias("total"))
    leaves = cut(placed.join(counts, "w_group"))
    steps = _steps(leaves)
    groups = steps[-1].select(F.col("w_group").alias("name"), "node")
    several = groups.count()
    ordered = numbered(groups, F.lit("="), F.col("name"))
    tops = _steps(cut(ordered.select("w_group", "place", "node", F.lit(several).cast("long").alias("total"), "name")))
    above = tops[-1].select("w_group", "place", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    subroots = cut(_way_down(tops, above, ("name", "node")))
    known = subroots.select(F.col("name").alias("w_group"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"), "root")
    found = _way_down(steps, known, ("id", "node", *carried))
    return found.select("id", F.col("node").alias("leaf"), "subroot", "root", "path", *carried)
