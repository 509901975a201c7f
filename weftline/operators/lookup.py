"""Predicates, point lookups and graph-and-text joins over code entities; registries of interchangeable parts."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import diffs as D
from weftline.operators import events as E
from weftline.operators import retrieval as R
from weftline.operators.rank import ranked


class Retriever(Protocol):
    """X01. What retrieval strategies share: documents once, then ranked hits for queries."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class LexicalRetriever:
    def __init__(self, docs: DataFrame, **options: float):
        self.docs, self.options = docs, options

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return R.bm25(self.docs, queries, k, **self.options)


class DenseRetriever:
    """X02, R05. embed maps a DataFrame with text to one with a vector, by whatever model it holds.

    Models that tell queries from documents by a prefix get it in front of every text.
    """

    def __init__(self, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], query_prefix: str = "", document_prefix: str = ""):
        self.embed, self.query_prefix = embed, query_prefix
        self.docs = embed(prefixed(docs, document_prefix))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return R.dense(self.docs, self.embed(prefixed(queries, self.query_prefix)), k)

#: Pairs of files that a task looks at, in the mean.
PAIRS = 4_000_000


def prefixed(texts: DataFrame, prefix: str) -> DataFrame:
    """Texts (null: empty) behind a prefix; without one they stay as they are."""
    return texts.withColumn("text", F.concat(F.lit(prefix), F.coalesce("text", F.lit("")))) if prefix else texts


def pooled(states: Column, mask: Column, how: str = "mean") -> Column:
    """R05. One vector of a text's token vectors: the first one (cls) or the mean of those whose mask is not 0.

    No token vectors give null; a mask of zeros only gives zeros for the mean.
    """
    if how == "cls":
        return F.get(states, F.lit(0))
    if how != "mean":
        raise ValueError(f"no pooling named {how}")
    chosen = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(chosen, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(chosen), F.lit(1)))


class Tools:
    """X09. Table functions called by name with arguments as JSON; a tool states its arguments and which it needs."""

    def __init__(self):
        self.known: dict[str, tuple[Callable[..., DataFrame], dict[str, type], tuple[str, ...]]] = {}

    def add(self, name: str, run: Callable[..., DataFrame], arguments: dict[str, type], needed: tuple[str, ...] = ()) -> None:
        self.known[name] = (run, arguments, needed)

    def call(self, name: str, arguments: str = "{}") -> DataFrame:
        """The tool's rows. ValueError names an unknown tool or argument, a missing one or one of another type."""
        if name not in self.known:
            raise ValueError(f"unknown tool {name}")
        run, kinds, needed = self.known[name]
        given = json.loads(arguments or "{}")
        if not isinstance(given, dict):
            raise ValueError("arguments must be an object")
        for key, value in given.items():
            if key not in kinds or not isinstance(value, kinds[key]) or (isinstance(value, bool) and kinds[key] is not bool):
                raise ValueError(f"argument {key} of {name} is not known or of another type")
        if missing := [x for x in needed if x not in given]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return run(**given)


#: X05. Retention by name: log, order and parameters to the rows that stay.
CONDENSERS: dict[str, Callable[..., DataFrame]] = {"none": lambda df, **_: df, "recent": E.head_tail, "amortized": E.amortized, "attention": E.attention_fill, "mask_old": E.mask_old, "mask_type": E.mask_type_tail}

# Which grammar a repository's test log follows, by a part of its name.
PARSERS = {"jest": "jest", "prettier": "jest", "babel": "jest", "tailwind": "jest", "dayjs": "dayjs", "assertj": "maven", "netty": "maven", "sympy": "sympy", "dateutil": "unittest", "django": "unittest", "matplotlib": "matplotlib"}


def parser_of(repository: Column) -> Column:
    """X06. Grammar of a repository's logs, pytest by default."""
    out = F.lit("pytest")
    for part, grammar in PARSERS.items():
        out = F.when(F.contains(F.lower(repository), F.lit(part)), grammar).otherwise(out)
    return out


def statuses_by_repository(logs: DataFrame) -> DataFrame:
    """X06, T22. instance_id, test, status of (instance_id, repository, log), each by its own grammar."""
    marked = logs.withColumn("grammar", parser_of(F.col("repository")))
    out = None
    for grammar in sorted({"pytest", *PARSERS.values()}):
        own = D.test_statuses(marked.where(F.col("grammar") == grammar), grammar=grammar)
        out = own if out is None else out.unionByName(own)
    return out


def first_present(row: Column, keys: list[str]) -> Column:
    """F02. Of a map of arrays, the value of the first key that is there, even if it is empty."""
    out = F.lit(None).cast("array<string>")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(row, F.lit(key)), F.element_at(row, key)).otherwise(out)
    return out


def flatten_mixed(value: Column, keys: tuple[str, ...] = ("path", "file", "file_path", "name")) -> Column:
    """F03. Strings in a JSON value of strings, lists (two deep) and objects, of which the first path-like key counts."""
    text = F.trim(F.coalesce(value, F.lit("")))

    def leaf(x: Column) -> Column:
        found = F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in keys))
        return F.when(x.startswith("{"), found).otherwise(F.regexp_replace(x, '^"|"$', ""))

    as_items = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array(x))
    items = F.when(text.startswith("["), F.flatten(F.transform(F.from_json(text, "array<string>"), lambda x: F.when(x.startswith("["), as_items(x)).otherwise(F.array(x))))).otherwise(F.array(text))
    return F.filter(F.transform(items, leaf), lambda x: x.isNotNull() & (x != ""))


def is_filled(*columns: str) -> Column:
    """F16. All columns are there and not blank."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & (F.trim(c) != "")
    return out


def patch_shape(patch: Column) -> dict[str, Column]:
    """F18. Files, hunks, added and removed lines of a patch."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    return {"files": n("^diff --git "), "hunks": n("^@@ "), "added": n(r"^\+(?!\+\+ )"), "removed": n("^-(?!-- )"), "new_files": n("^new file mode"), "gone_files": n("^deleted file mode")}


# Beginnings and parts of paths that belong to tools and environments.
TOOL_PATH = r"^(/usr/|/opt/|/home/[^/]+/\.|~/)|node_modules/|site-packages/|\.venv/|__pycache__/|\.cache/|/bin/"


def is_tool_path(path: Column) -> Column:
    """F24."""
    return path.rlike(TOOL_PATH)


def sensitive_calls(calls: DataFrame, watched: DataFrame) -> DataFrame:
    """F22. Calls (name, file) that are watched (name, files): anywhere if it names no file, else in its files."""
    joined = calls.join(watched, "name")
    return joined.where((F.size("files") <= 0) | F.array_contains("files", F.col("file"))).drop("files")


def resume(tasks: DataFrame, done: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """F20, J05. Tasks not done yet, of some ids if named."""
    left = tasks.join(done.select(key).distinct(), key, "left_anti")
    return left if only is None else left.where(F.col(key).isin(*only))


def select_start(nodes: DataFrame, node_id: str | None = None, label: str | None = None, file: str | None = None) -> DataFrame:
    """F09. Start nodes by exactly one of id, label and file; a file's nodes by type (file, class, function), then label."""
    if sum(x is not None for x in (node_id, label, file)) != 1:
        raise ValueError("name exactly one of id, label and file")
    if node_id is not None:
        return nodes.where(F.col("id") == node_id)
    if label is not None:
        return nodes.where(F.col("label") == label)
    place = F.when(F.col("type") == "file", 0).when(F.col("type") == "class", 1).when(F.col("type").isin("function", "method"), 2).otherwise(99)
    return nodes.where(F.col("file") == file).orderBy(place, "label")


def with_methods(entities: DataFrame) -> DataFrame:
    """F11. Classes with an array of their methods (name, start_line, end_line)."""
    classes = entities.where("kind = 'class'").select("file", "qualified_name", "start_line", "end_line")
    methods = entities.where("kind = 'method'").select("file", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("qualified_name"), F.struct("name", "start_line", "end_line").alias("m"))
    own = methods.groupBy("file", "qualified_name").agg(F.array_sort(F.collect_list("m"), lambda a, b: (a["start_line"] - b["start_line"]).cast("int")).alias("methods"))
    return classes.join(own, ["file", "qualified_name"], "left")


def name_index(entities: DataFrame) -> DataFrame:
    """A24. name, ids: ids by name and by lower-case name; files count by base name and stem."""
    base = F.regexp_extract("file", "[^/]*$", 0)
    names = F.when(F.col("kind") == "file", F.array(base, F.regexp_replace(base, r"\.[^.]*$", ""))).otherwise(F.array("name"))
    each = entities.select(F.explode(F.array_distinct(F.concat(names, F.transform(names, F.lower)))).alias("name"), X.entity_id(F.col("file"), F.col("qualified_name")).alias("id"))
    return each.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def code_of(files: DataFrame, entities: DataFrame) -> DataFrame:
    """X10. Every entity with its lines of code."""
    lines = files.select("file", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return entities.join(lines, "file").withColumn("code", F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)), "\n")).drop("lines")


def cross_file(edges: DataFrame, nodes: DataFrame, before_line: bool = False) -> DataFrame:
    """J14. Edges whose ends stand in different files, with both places; before_line: used before its source begins."""
    s, t = (nodes.select(*(F.col(c).alias(f"{x}_{c}") for c in ("id", "file", "start_line"))) for x in ("s", "t"))
    found = edges.join(s, F.col("src") == F.col("s_id")).join(t, F.col("dst") == F.col("t_id")).where("s_file <> t_file")
    return found.where(F.col("line") < F.col("s_start_line")) if before_line else found


def related_files(files: DataFrame, least_share: float | None = None, block: int = 1024) -> DataFrame:
    """J17. a, b: files that share a token of over two signs in their stems, by an equi-join on the tokens.

    With least_share, tokens that at least such a share of the files has tell nothing and are left out: they alone would
    make all pairs. Files count once, however often they are given. A pair is made at the first token that both have, so
    pairs are never gathered to tell them apart; a token's files meet in tiles of block files by all others, which are
    dealt to as many tasks as there are PAIRS to look at.
    """
    each = files.select("file").where("file is not null").distinct()
    tokens = each.select("file", F.explode(X.stem_tokens(F.col("file"))).alias("token"))
    sizes = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    if least_share is not None:
        sizes = sizes.where(F.col("n") < least_share * each.count())
    parts = int((sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) // PAIRS) + 1
    known = tokens.join(sizes, "token").select("file", "token", F.ceil(F.col("n") / block).cast("int").alias("tiles"))
    own = known.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("token", "tiles"))).alias("own"))
    placed = own.select("file", F.transform("own", lambda t: t["token"]).alias("all"), F.posexplode("own").alias("at", "t"))
    placed = placed.select("file", F.col("t.token").alias("token"), F.col("t.tiles").alias("tiles"), F.when(F.col("at") > 0, F.slice("all", F.lit(1), F.col("at"))).alias("before"))
    left = placed.select(F.col("file").alias("a"), "token", F.pmod(F.xxhash64("file"), F.col("tiles")).cast("int").alias("tile"), F.col("before").alias("before_a"))
    right = placed.select(F.col("file").alias("b"), "token", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("before").alias("before_b"))
    first = F.col("before_a").isNull() | F.col("before_b").isNull() | ~F.arrays_overlap("before_a", "before_b")
    dealt = left.repartition(parts, "token", "tile").join(right.repartition(parts, "token", "tile"), ["token", "tile"])
    return dealt.where((F.col("a") != F.col("b")) & first).select("a", "b")


def sibling_files(files: DataFrame) -> DataFrame:
    """J18. a, b: files of one folder and stem."""
    keyed = files.select("file", F.regexp_extract("file", "^(.*/)?", 0).alias("folder"), F.regexp_replace(F.regexp_extract("file", "[^/]*$", 0), r"\..*$", "").alias("stem"))
    other = keyed.select(F.col("file").alias("b"), "folder", "stem")
    return keyed.join(other, ["folder", "stem"]).where(F.col("file") != F.col("b")).select(F.col("file").alias("a"), "b")


def anchor_matches(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """J19. anchor, id, score: of each anchor (anchor, text) the node (id, name, file, pos) that shares most signal tokens,
    with 2 more for a shared stem token; the first node wins ties. Anchors and nodes meet by their tokens."""
    a = anchors.select("anchor", F.explode(X.signal_tokens(F.col("text"))).alias("token"))
    named = nodes.select("id", "pos", F.explode(X.signal_tokens(F.concat_ws(" ", "name", F.array_join(X.aliases(F.col("name")), " ")))).alias("token"), F.lit(1).alias("w"))
    stems = nodes.select("id", "pos", F.explode(X.stem_tokens(F.col("file"))).alias("token"), F.lit(2).alias("w"))
    scored = a.join(named.unionByName(stems), "token").groupBy("anchor", "id", "pos").agg((F.sum(F.when(F.col("w") == 1, 1).otherwise(0)) + F.max(F.when(F.col("w") == 2, 2).otherwise(0))).alias("score"))
    return scored.groupBy("anchor").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("pos"))).alias("m")).select("anchor", "m.id", "m.score", X.confidence(F.col("m.score")).alias("confidence"))


def aligned_relations(scene_edges: DataFrame, matches: DataFrame, code_edges: DataFrame, preferred: DataFrame) -> DataFrame:
    """J20. Scene edges (src, dst, relation) whose ends' matches have a code edge, of a preferred type (relation, type, rank)."""
    m = matches.select("anchor", "id")
    ends = scene_edges.join(m.select(F.col("anchor").alias("src"), F.col("id").alias("c_src")), "src").join(m.select(F.col("anchor").alias("dst"), F.col("id").alias("c_dst")), "dst")
    found = ends.join(code_edges.select(F.col("src").alias("c_src"), F.col("dst").alias("c_dst"), "type"), ["c_src", "c_dst"]).join(preferred, ["relation", "type"], "left")
    return found.groupBy("src", "dst", "relation", "c_src", "c_dst").agg(F.min_by("type", F.struct(F.coalesce("rank", F.lit(99)), "type")).alias("type"))


def dependencies(edges: DataFrame) -> DataFrame:
    """G10. node, other: what a node references, and what contains it."""
    return edges.where("type = 'references'").select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.where("type = 'contains'").select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def first_in_preorder(nodes: DataFrame, condition: Column) -> DataFrame:
    """G11. The first node that meets a condition, in the order of (preorder): a path of sibling places from the root."""
    return nodes.where(condition).orderBy("preorder").limit(1)


def children(edges: DataFrame, nodes: DataFrame, parent: str, short_class: int = 100) -> DataFrame:
    """G12. Methods and functions right below a node, and classes no longer than short_class lines."""
    below = edges.where((F.col("src") == parent) & (F.col("type") == "contains")).select(F.col("dst").alias("id"))
    kept = F.col("type").isin("function", "method") | ((F.col("type") == "class") & (F.col("end_line") - F.col("start_line") <= short_class))
    return nodes.join(below, "id", "left_semi").where(kept)


# Order of edge and node types in listings.
EDGE_ORDER = ("calls", "uses", "imports", "reverse_import", "extends", "semantic", "component", "config", "style", "contains")
NODE_ORDER = ("file", "class", "function")


def ordered_neighbors(reached: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """G04, W04. Reached nodes (node, depth, via) by depth, edge type, node type and label, the first ones."""
    edge = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in EDGE_ORDER)), F.col("via")), F.lit(0))
    kind = F.when(F.col("type") == "method", "function").otherwise(F.col("type"))
    node = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in NODE_ORDER)), kind), F.lit(0))
    last = lambda c: F.when(c == 0, 99).otherwise(c)
    joined = reached.join(nodes, F.col("node") == F.col("id"))
    return joined.orderBy("depth", last(edge), last(node), "label", "id").limit(most).select("id", "type", "label", "depth", "via")


def trace_scores(calls: DataFrame) -> DataFrame:
    """W09. Calls (id, relevance 0 to 100, other_file, layers) with a relevance over 50, nearest first."""
    score = (100 - F.col("relevance")) + 40 * F.col("other_file").cast("int") + 20 * F.col("layers")
    return ranked(calls.where("relevance > 50").withColumn("score", score), F.col("score"), F.col("id"))


def symbols_in_file(entities: DataFrame, problem: Column, k: int = 10) -> DataFrame:
    """W07. Of each file, entities by terms shared with the problem, then kind (methods and functions first), then line."""
    shared = F.size(F.array_intersect(X.terms(problem), X.aliases(F.col("qualified_name"))))
    kind = F.when(F.col("kind").isin("function", "method"), 1).otherwise(0)
    w = Window.partitionBy("file").orderBy(F.desc("overlap"), F.desc(kind), "start_line")
    return entities.withColumn("overlap", shared).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def located_spans(outputs: DataFrame, key: str = "instance_id", text: str = "output") -> DataFrame:
    """T27, T32. key, file, kind, name, line of answers in a line grammar: a path, then function:, class: or line: lines."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = outputs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    path = F.when(F.col("raw").rlike(r"^[\w./\-]+\.\w+$"), X.normalize_path(F.col("raw")))
    found = lines.select(key, "pos", "raw", F.last(path, ignorenulls=True).over(w).alias("file"), path.isNotNull().alias("head"))
    kind = F.regexp_extract("raw", r"^(function|method|class|line):\s*(\S+)", 1)
    name = F.regexp_extract("raw", r"^(function|method|class|line):\s*(\S+)", 2)
    kept = found.where(F.col("file").isNotNull() & (F.col("head") | (kind != "")))
    return kept.select(key, "pos", "file", F.when(F.col("head"), "file").otherwise(kind).alias("kind"), F.when(~F.col("head") & (kind != "line"), name).alias("name"), F.when(kind == "line", name.try_cast("int")).alias("line"))


def snippet_search(docs: DataFrame, queries: DataFrame, pattern: str | None = None, k: int = 8) -> DataFrame:
    """R15. BM25 over chunks (doc_id, file, text), of files that match a glob or substring if any do."""
    hits = R.bm25(docs, queries, 4 * k)
    if pattern is None:
        return R.top_k(hits.drop("rank"), k, [F.desc("score"), F.col("doc_id")])
    return R.filtered_or_all(hits, docs.where(X.matches_path(F.col("file"), pattern)), k)


def file_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """R06, W02. query_id, file, rank: the files of ranked chunks in order of their best chunk."""
    best = hits.join(chunks.select("doc_id", "file"), "doc_id").groupBy("query_id", "file").agg(F.min("rank").alias("best"))
    return best.select("query_id", "file", F.row_number().over(Window.partitionBy("query_id").orderBy("best")).alias("rank"))
