"""Calls of Python code resolved by scope, imports, aliases and packages that hand names on.

Nodes are (file, name, kind) with dotted names; a node's container is the function or file around it, classes in between
aside. From a node one can name what its own and all enclosing containers hold, except itself and what encloses it; what
its file imports, by name or alias, with the members of imported files and classes; and what the __init__ files that the
file imports, directly or through other __init__ files, hold and import. Packages' chains are closed by doubling, names are
met by equi-joins on (container, name), so only names that some node uses are ever looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

_ROW = "file string, what string, owner string, kind string, name string, alias string"


def _module(node, file: str) -> str:
    if not node.level:
        return node.module or ""
    above = file.split("/")[: -node.level] if len(file.split("/")) >= node.level else []
    return ".".join([*above, node.module] if node.module else above)


def _read(file: str, text: str) -> Iterator[tuple]:
    import ast

    tree = ast.parse(text)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((file, "import", "", a.name, "", a.asname) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            star = any(a.name == "*" for a in node.names)
            yield from ((file, "import", "", _module(node, file), a.name, a.asname) for a in node.names if not star)
            if star:
                yield (file, "import", "", _module(node, file), "", None)

    def calls(nodes) -> Iterator[str]:
        for node in nodes:
            if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
                yield node.func.id if isinstance(node.func, ast.Name) else node.func.attr

    def outside(node) -> Iterator:
        """What a function runs itself: its inner definitions aside."""
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield child
                yield from outside(child)

    def marked(decorator) -> Iterator[str]:
        if isinstance(decorator, ast.Name):
            yield decorator.id
            return
        for x in ast.walk(decorator):
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                yield x.func.id
            elif isinstance(x, ast.Attribute):
                yield x.attr

    def visit(node, prefix: str, in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield from visit(child, prefix, in_class)
                continue
            is_class = isinstance(child, ast.ClassDef)
            if in_class and child.name == "__init__" and isinstance(child, ast.FunctionDef):
                continue  # a class's own: its calls are the class's
            name = f"{prefix}.{child.name}" if prefix else child.name
            yield (file, "node", name, "class" if is_class else "function", child.name, None)
            if is_class:
                yield from ((file, "name", name, "inherits", b.id if isinstance(b, ast.Name) else b.attr, None) for b in child.bases if isinstance(b, (ast.Name, ast.Attribute)))
                first = next((x for x in child.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"), None)
                used = [*(m for d in first.decorator_list for m in marked(d)), *calls(ast.walk(first))] if first else []
            else:
                used = calls(x for part in (child.args, child.returns, *child.body) if part is not None for x in _with(part, outside))
            yield from ((file, "name", name, "invokes", c, None) for c in used)
            yield from visit(child, name, is_class)

    def _with(node, below) -> Iterator:
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield node
            yield from below(node)

    yield from visit(tree, "", False)


def python_names(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of Python files (file, text): nodes (file, name, kind), names used (file, owner, kind: invokes or inherits, name) and
    imports (file, module, name, alias); a whole module and a star have no name. Files that do not parse have none."""
    import pandas as pd

    def parse(parts):
        for pdf in parts:
            rows: list[tuple] = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    rows += list(_read(file, text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ROW.split(", ")])

    found = cut(files.where(F.endswith("file", F.lit(".py"))).select("file", "text").mapInPandas(parse, _ROW))
    nodes = found.where("what = 'node'").select("file", F.col("owner").alias("name"), "kind").distinct()
    used = found.where("what = 'name'").select("file", "owner", "kind", "name").distinct()
    return nodes, used, found.where("what = 'import'").select("file", F.col("kind").alias("module"), "name", "alias").distinct()


def _id(file: str = "file", name: str = "name"):
    return F.concat(F.col(file), F.lit(":"), F.col(name))


def import_targets(imports: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """J15, G15. file, dst, alias: what imports mean: a module's file or package, or else a node of it, or else the file it
    should be in. Modules that are no files here mean nothing."""
    known = files.select(F.col("file").alias("path")).distinct()
    inner = F.when(F.col("name") == "", F.col("module")).otherwise(F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "name"))
    asked = imports.withColumn("whole", F.replace(inner, F.lit("."), F.lit("/"))).withColumn("base", F.replace("module", F.lit("."), F.lit("/")))

    def found(df: DataFrame, column: str, name: str) -> DataFrame:
        one = known.select(F.regexp_replace("path", r"\.py$", "").alias(column), F.col("path").alias(f"{name}_a"))
        two = known.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias(column), F.col("path").alias(f"{name}_b"))
        return df.join(one, column, "left").join(two, column, "left").withColumn(name, F.coalesce(f"{name}_a", f"{name}_b")).drop(f"{name}_a", f"{name}_b")

    placed = found(found(asked, "whole", "sub"), "base", "own")
    named = nodes.select(F.col("file").alias("own"), F.col("name"), _id().alias("node"))
    told = placed.join(named, ["own", "name"], "left")
    dst = F.coalesce("sub", F.when(F.col("name") != "", F.coalesce("node", "own")))
    return told.select("file", dst.alias("dst"), "alias").where("dst is not null").distinct()


def _closed(edges: DataFrame) -> DataFrame:
    """All (a, b) that a path of edges (a, b) joins: steps double every round."""
    reach = cut(edges.distinct())
    n = reach.count()
    while True:
        more = reach.select("a", F.col("b").alias("m")).join(reach.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        reach = cut(reach.unionByName(more).distinct())
        if (now := reach.count()) == n:
            return reach
        n = now


def callees(nodes: DataFrame, used: DataFrame, targets: DataFrame, nearest: bool = False, everywhere: bool = False) -> DataFrame:
    """J16, G15. src, dst, type: names used (file, owner, kind, name) resolved to nodes, by the rules above.

    All nodes of a name count, or with nearest only the best: an alias, then the innermost container's, then those of
    packages, then what the file itself imports, the least by name among equals. With everywhere, names that mean nothing
    so mean all nodes of that name.
    """
    last = F.substring_index("name", ".", -1)
    above = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    kinds = nodes.where("kind = 'class'").select("file", F.col("name").alias("up"))
    # containers of a node: the classes around it up to the first that is none, and that one
    levels = nodes.select("file", "name", F.posexplode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda i: F.array_join(F.slice(F.split(F.col("name"), r"\."), F.lit(1), i - 1), ".")), lambda x: x.isNotNull())).alias("depth", "up"))
    marked = levels.join(kinds.withColumn("is_class", F.lit(True)), ["file", "up"], "left")
    top = marked.where("is_class is null").groupBy("file", "name").agg(F.max("depth").alias("top"), F.max_by("up", "depth").alias("container"))
    held = cut(top.select("file", "container", last.alias("short"), "name", "top"))
    members = marked.join(top.select("file", "name", "top"), ["file", "name"]).where("depth > top or (depth = top and up = '')").select("file", "up", last.alias("short"), "name")

    asked = used.select("file", "owner", "kind", F.col("name").alias("short"))
    scopes = asked.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("owner", r"\."))), lambda i: F.array_join(F.slice(F.split(F.col("owner"), r"\."), F.lit(1), i), "."))).alias("container"))
    inside = scopes.join(held, ["file", "container", "short"]).where((F.col("name") != F.col("owner")) & ~F.startswith("owner", F.concat("name", F.lit("."))))
    near = inside.select("file", "owner", "kind", "short", _id().alias("dst"), (1 + F.lit(1) / (2 + F.size(F.split("container", r"\.")) * (F.col("container") != "").cast("int"))).alias("tier"))

    init = targets.where(F.col("dst").rlike(r"(^|/)__init__\.py$")).select(F.col("file").alias("a"), F.col("dst").alias("b")).where("a <> b")
    chain = _closed(init).where("a <> b")
    own = targets.select("file", "dst", "alias", F.lit(3.0).alias("tier"))
    through = chain.join(targets, F.col("b") == F.col("file")).select(F.col("a").alias("file"), "dst", "alias", F.lit(2.0).alias("tier"))
    whole = chain.select(F.col("a").alias("file"), F.col("b").alias("dst"), F.lit(None).cast("string").alias("alias"), F.lit(2.0).alias("tier"))
    seen = own.unionByName(through).unionByName(whole).distinct()
    wanted = asked.select("file", "short").distinct().join(seen, "file")
    by_alias = wanted.where("short = alias").select("file", "short", "dst", F.lit(0.0).alias("tier"))
    itself = wanted.where(F.contains("dst", F.lit(":")) & (F.regexp_extract("dst", r"[^.:]*$", 0) == F.col("short"))).select("file", "short", "dst", "tier")
    of = members.select(F.when(F.col("up") == "", F.col("file")).otherwise(F.concat("file", F.lit(":"), "up")).alias("dst"), "short", _id().alias("node"))
    held_there = wanted.join(of, ["dst", "short"]).select("file", "short", F.col("node").alias("dst"), "tier")
    far = cut(by_alias.unionByName(itself).unionByName(held_there).groupBy("file", "short", "dst").agg(F.min("tier").alias("tier")))
    met = near.unionByName(asked.join(far, ["file", "short"]).select("file", "owner", "kind", "short", "dst", "tier"))
    best = met.groupBy("file", "owner", "kind", "short").agg(F.min_by("dst", F.struct("tier", "dst")).alias("dst")) if nearest else met.select("file", "owner", "kind", "short", "dst").distinct()
    if everywhere:
        left = asked.join(best.select("file", "owner", "kind", "short").distinct(), ["file", "owner", "kind", "short"], "left_anti")
        best = best.unionByName(left.join(nodes.select(last.alias("short"), _id().alias("dst")), "short").select("file", "owner", "kind", "short", "dst"))
    return best.select(_id("file", "owner").alias("src"), "dst", F.col("kind").alias("type")).distinct()
