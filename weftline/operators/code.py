"""Entities and relations of source files, document building for retrieval, and ranking of code candidates.

Files are rows (file, text); entities are (file, kind, name, qualified_name, start_line, end_line), relations
(src, dst, type). Line patterns are native; only Python syntax trees need a Python table function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.intervals import containing, innermost
from weftline.session import cut

# Patterns of definitions by kind, for each family of languages, in the order in which they are tried.
DEFINITIONS = {
    "javascript": (
        ("class", r"\bclass\s+([A-Za-z_$][\w$]*)"),
        ("function", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("),
        ("function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
        ("function", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\b"),
        ("method", r"^\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{"),
        ("method", r"\.prototype\.([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?function\b"),
    ),
    "java": (
        ("class", r"\bclass\s+([A-Za-z_]\w*)\b"),
        ("function", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?[A-Za-z_<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?\{"),
    ),
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
# Patterns of definitions in all other code files (go, rust, c and the like), and in Python files.
DEFINITIONS["other"] = (
    ("class", r"\b(?:class|struct|interface)\s+([A-Za-z_]\w*)\b"),
    ("function", r"^\s*(?:func|fn)\s+([A-Za-z_]\w*)\s*\("),
    ("function", r"^\s*[A-Za-z_][\w:<>\s*&]*\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{"),
)
PYTHON_DEFINITIONS = (("class", r"^\s*class\s+([A-Za-z_]\w*)\b"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("))
# Words that no definition has for a name, and what comment lines begin with.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function")
_COMMENT = r"^\s*(//|\*|#)"


def _next_at_most(lines: DataFrame) -> DataFrame:
    """Lines that have a base, with close: the first later line (file, n) whose level is at most base.

    That is the next line, or one that falls from above base to it. Lines are noted at the levels that they fall through,
    so that heads meet their ends in one window, in time that grows with the falls and not with heads times lines.
    """
    w = Window.partitionBy("file").orderBy("n")
    seen = lines.select("*", F.lead(F.struct("level", "n")).over(w).alias("next"), F.lag("level").over(w).alias("above"))
    falls = seen.where("level < above").select("file", "n", F.explode(F.sequence("level", F.col("above") - 1)).alias("base"), F.lit(False).alias("head"))
    both = seen.where("base is not null").withColumn("head", F.lit(True)).unionByName(falls, allowMissingColumns=True)
    back = Window.partitionBy("file", "base").orderBy(F.desc("n"), F.desc("head")).rowsBetween(Window.unboundedPreceding, -1)
    late = both.withColumn("fall", F.last(F.when(~F.col("head"), F.col("n")), ignorenulls=True).over(back)).where("head")
    return late.withColumn("close", F.when(F.col("next.level") <= F.col("base"), F.col("next.n")).otherwise(F.col("fall"))).drop("next", "above", "head", "fall")


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("file", X.language_of(F.col("file")).alias("lang"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def _led(pattern: str) -> str:
    """The same pattern, with a word that it begins with before the test of that word's boundary, or a choice's first letter.

    Java tests boundaries and choices slowly, and would do so at every sign.
    """
    pattern = re.sub(r"^\(\?:import\|export\)", "[ei](?:(?<=i)mport|(?<=e)xport)", pattern)
    led = re.match(r"\\b([A-Za-z]+)(?=\\[sb(]|[ (])", pattern)
    return f"{led[1]}(?<=\\b{led[1]}){pattern[led.end() :]}" if led else pattern


def _first_pattern(patterns: tuple[tuple[str, str], ...]) -> Column:
    """Kind and name, with a blank between them, by the first pattern that fits with a name that is no keyword."""
    one = lambda p: F.get(F.filter(F.array(F.regexp_extract("line", _led(p), 1)), lambda x: ~x.isin("", *KEYWORDS)), 0)
    return F.coalesce(*(F.concat(F.lit(f"{k} "), one(p)) for k, p in patterns))


def pattern_entities(files: DataFrame) -> DataFrame:
    """T11, T12, J09. Definitions by the first line pattern that fits; a block ends on the first line on which, since the
    definition's, a brace has been opened and all are closed, comments aside (without one, on its own line).

    A method's class is the narrowest one around it; what is found is kept in the shared folder, so that lines are not read
    again for it. Code files of no named language go by the patterns of "other";
    Python files are read by python_entities.
    """
    lang = X.language_of(F.col("file"))
    family = F.when(lang.isin("javascript", "typescript"), "javascript").when(lang == "java", "java").when((lang == "") & X.is_code_path(F.col("file")), "other")
    # the family once a file, not a line; files of none define nothing here
    known = files.select("file", family.alias("family"), F.coalesce("text", F.lit("")).alias("text")).where("family is not null")
    lines = known.select("file", "family", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    hit = F.coalesce(*(F.when(F.col("family") == name, _first_pattern(DEFINITIONS[name])) for name in ("javascript", "java", "other")))
    code = F.when(F.contains("line", F.lit("//")), F.regexp_replace("line", "//.*$", "")).otherwise(F.col("line"))
    count = lambda c: F.octet_length("code") - F.octet_length(F.replace("code", F.lit(c), F.lit("")))
    # from the last line back: a frame that shrinks from the front would be read anew for each line; levels, which are
    # compared within a file only, count from its end
    later = Window.partitionBy("file").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = lines.select("file", (F.col("n") + 1).alias("n"), F.when(~F.col("line").rlike(_COMMENT), hit).alias("hit"), code.alias("code"))
    depth = read.select("file", "n", "hit", count("{").alias("opened"), (count("{") - count("}")).alias("step"))
    seen = depth.withColumn("base", -F.sum("step").over(later)).withColumn("level", F.col("base") + F.col("step"))
    seen = seen.withColumn("open", F.last(F.when(F.col("opened") > 0, F.struct("n", "level")), ignorenulls=True).over(later))
    # a block that its opening line does not close ends on the first line after it that falls to the level before it
    waits = F.col("open").isNotNull() & (F.col("open.level") > F.col("base"))
    head = F.struct("base", F.when(waits, F.col("open.n")).otherwise(F.col("n")).alias("at"), "hit", F.col("n").alias("start_line"), F.when(~waits, F.coalesce("open.n", "n")).alias("end_line"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("hit", "string"), ("start_line", "int"), ("end_line", "int"))]
    falls = F.transform(F.sequence("level", F.col("base") - 1), lambda x: F.struct(x.alias("base"), F.col("n").alias("at"), *none))
    # heads and falls of a line at once, so that lines are read and ordered once
    marks = seen.select("file", F.explode(F.array_compact(F.flatten(F.array_compact(F.array(F.when(F.col("hit").isNotNull(), F.array(head)), F.when(F.col("level") < F.col("base"), falls)))))).alias("m")).select("file", "m.*")
    back = Window.partitionBy("file", "base").orderBy(F.desc("at"), F.col("hit").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    ended = marks.withColumn("fall", F.last(F.when(F.col("hit").isNull(), F.col("at")), ignorenulls=True).over(back)).where("hit is not null")
    kind, name = (F.substring_index("hit", " ", i) for i in (1, -1))
    closed = cut(ended.select("file", kind.alias("kind"), name.alias("name"), "start_line", F.coalesce("end_line", "fall", "start_line").alias("end_line")))
    classes = closed.where("kind = 'class' and end_line > start_line").select("file", F.col("name").alias("class"), (F.col("start_line") + 1).alias("start"), F.col("end_line").alias("end"), (-F.col("start_line")).alias("pos"))
    owner = innermost(closed.where("kind = 'method'").select("file", F.col("start_line").alias("at")), classes, "file", ["file", "at"]).select("file", F.col("at").alias("start_line"), "class")
    named = closed.join(owner, ["file", "start_line"], "left")
    return named.select("file", "kind", "name", F.concat_ws(".", "class", "name").alias("qualified_name"), "start_line", "end_line")


def python_pattern_entities(files: DataFrame) -> DataFrame:
    """T11, T12. Classes and functions of Python files by line patterns, with their blocks by indentation.

    A block ends before the next line of text that is indented no deeper, comments and decorators aside.
    """
    lines = _numbered(files).where("lang = 'python'")
    fits = [(k, F.regexp_extract("line", p, 1)) for k, p in PYTHON_DEFINITIONS]
    kind, name = F.coalesce(*(F.when(x != "", k) for k, x in fits)), F.coalesce(*(F.when(x != "", x) for _, x in fits))
    indent = F.length(F.regexp_extract("line", r"^\s*", 0))
    last = F.max("n").over(Window.partitionBy("file"))
    text = lines.select("file", "n", kind.alias("kind"), name.alias("name"), indent.alias("level"), last.alias("last"), F.regexp_extract("line", r"\S", 0).alias("sign")).where("sign not in ('', '#', '@')")
    found = _next_at_most(text.withColumn("base", F.when(F.col("kind").isNotNull(), F.col("level"))))
    return found.select("file", "kind", "name", F.col("name").alias("qualified_name"), F.col("n").alias("start_line"), F.coalesce(F.col("close") - 1, F.col("last")).alias("end_line"))


def python_entities(files: DataFrame) -> DataFrame:
    """T11. Entities of Python files by their syntax trees, of files that do not parse by line patterns."""
    broken = files.join(_parsed(files).where("what = 'broken'").select("file").distinct(), "file", "left_semi")
    return python_graph(files)[0].unionByName(python_pattern_entities(broken))


def defines(entities: DataFrame) -> DataFrame:
    """G16 (defines). Edges from files to their classes and functions, and from classes to their methods."""
    whole = F.concat("file", F.lit("::"), "qualified_name")
    owner = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)
    above = F.when((F.col("kind") == "method") & (owner != ""), F.concat("file", F.lit("::"), owner)).otherwise(F.col("file"))
    return entities.select(above.alias("src"), whole.alias("dst"), F.lit("defines").alias("type"))


def _parsed(files: DataFrame) -> DataFrame:
    """Entities and references of Python files; a row of what = broken for a file that does not parse."""
    import ast

    import pandas as pd

    def last(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        return node.attr if isinstance(node, ast.Attribute) else None

    def calls(nodes) -> list[str]:
        out, stack = [], list(nodes)
        while stack:
            node = stack.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(node, ast.Call) and (name := last(node.func)):
                out.append(name)
            stack += ast.iter_child_nodes(node)
        return out

    def visit(file, body, prefix, rows):
        for node in body:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                base = getattr(node, "module", None)
                rows += [(file, prefix, "reference", "imports", ".".join(filter(None, (base, a.name))), 0, 0) for a in node.names]
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{node.name}" if prefix else node.name
                is_class = isinstance(node, ast.ClassDef)
                rows.append((file, name, "entity", "class" if is_class else "method" if prefix else "function", node.name, node.lineno, node.end_lineno))
                inits = [x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"] if is_class else []
                own = calls(node.decorator_list) + (calls(s for x in inits for s in x.body) if is_class else calls(node.body))
                rows += [(file, name, "reference", "invokes", c, 0, 0) for c in own]
                rows += [(file, name, "reference", "inherits", b, 0, 0) for b in map(last, getattr(node, "bases", [])) if b]
                visit(file, node.body, name, rows)

    def parse(parts):
        for pdf in parts:
            rows: list[tuple] = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    rows.append((file, "", "broken", "", "", 0, 0))
                    continue
                visit(file, tree.body, "", rows)
            yield pd.DataFrame(rows, columns=["file", "owner", "what", "kind", "name", "start_line", "end_line"])

    return files.where(F.endswith("file", F.lit(".py"))).select("file", "text").mapInPandas(parse, "file string, owner string, what string, kind string, name string, start_line int, end_line int")


def python_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G15. Entities of Python files and their name-level references (file, owner, kind, target).

    Kinds: inherits (bases), imports, and invokes: a class's calls are those of its decorators and __init__, a function's
    those of its decorators and body without nested definitions. Names are cut to their last part; files that do not
    parse have nothing.
    """
    found = _parsed(files)
    entities = found.where("what = 'entity'").select("file", "kind", "name", F.col("owner").alias("qualified_name"), "start_line", "end_line")
    return entities, found.where("what = 'reference'").select("file", "owner", "kind", F.col("name").alias("target"))


# JavaScript relations and their patterns, each with one group.
_FROM = r"""\b.*?\bfrom[ \t]+['"]([^'"]+)['"]"""
RELATIONS = {
    "imports": (r"(?:import|export)" + _FROM, r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""),
    "type_imports": (r"(?m)^[ \t]*import(?=[ \t]+type\b|.*\{[ \t]*type[ \t]+[A-Za-z_$])" + _FROM,),
    "re_exports": (r"(?m)^[ \t]*export" + _FROM,),
    "exports": (r"(?m)^[ \t]*export[ \t]+(?:default[ \t]+)?class[ \t]+([A-Za-z_$][\w$]*)", r"(?m)^[ \t]*export[ \t]+(?:default[ \t]+)?function[ \t]+([A-Za-z_$][\w$]*)", r"(?m)^[ \t]*export[ \t]+(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)"),
    "extends": (r"class\s+[\w$]+\s+extends\s+([A-Za-z_$][\w$]*)",),
    "calls": (r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\(",),
    "instantiates": (r"\bnew\s+([A-Za-z_$][\w$]*)\s*\(",),
    "renders": (r"<([A-Z][A-Za-z0-9_$]*)\b",),
    "uses_hook": (r"\b(use[A-Z][A-Za-z0-9_$]*)\s*\(",),
    "type_uses": (r":\s*([A-Z][A-Za-z0-9_$]*)\b", r"\bas\s+([A-Z][A-Za-z0-9_$]*)\b", r"<([A-Z][A-Za-z0-9_$]*)>", r"\bimplements\s+([A-Z][A-Za-z0-9_$]*)\b"),
    "reads_state": (r"\b(useSelector|getState|mapStateToProps|select[A-Z][A-Za-z0-9_$]*)\s*\(", r"\b([A-Za-z_$][\w$]*)\.getState\s*\(", r"\b([A-Za-z_$][\w$]*)\.state\b"),
    "writes_state": (r"\b(this\.setState|setState|set[A-Z][A-Za-z0-9_$]*)\s*\(", r"\b([A-Za-z_$][\w$]*)\.setState\s*\("),
    "subscribes_to": (r"\b([A-Za-z_$][\w$]*)\.(?:subscribe|addEventListener|on|listen)\s*\(", r"\b(useSyncExternalStore)\s*\("),
    "dispatches": (r"\b(dispatch|emit|publish)\s*\(", r"\b([A-Za-z_$][\w$]*)\.(?:dispatch|emit|publish)\s*\("),
    "provides_context": (r"<([A-Z][A-Za-z0-9_$]*)\.Provider\b",),
    "consumes_context": (r"\buseContext\s*\(\s*([A-Z][A-Za-z0-9_$]*)\s*\)", r"<([A-Z][A-Za-z0-9_$]*)\.Consumer\b"),
    "routes_to": (r"\bcomponent\s*=\s*\{([A-Z][A-Za-z0-9_$]*)\}", r"\belement\s*=\s*\{<([A-Z][A-Za-z0-9_$]*)\b", r"\brender\s*=\s*\{[^}]*\b([A-Z][A-Za-z0-9_$]*)\b"),
    "uses_style": (r"import" + _FROM, r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""),
}
# Relations whose group is a list with commas; of a renamed export the first name counts.
LISTS = {"exports": r"(?m)^[ \t]*export[ \t]*\{([^}\n]+)\}", "implements": r"class\s+[\w$]+(?:\s+extends\s+[\w$]+)?\s+implements\s+([A-Za-z_$][\w$]*(?:\s*,\s*[A-Za-z_$][\w$]*)*)"}
# Components with a property in braces, and words of inline styles.
PROPS = r"<([A-Z][A-Za-z0-9_$]*)\b(?=[^>]*\b[A-Za-z_$][\w$]*\s*=\s*\{)[^>]*>"
STYLED = r"\b(className|style|styled|css|sx)\b|\b(position|margin|padding|width|height|top|left|right|bottom|flex|grid)\b"
# Heads of calls that are language constructs.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "typeof", "instanceof", "super", "require", "import")
#: Without a target, these relations point at their own file.
OWN_FILE = ("implements", "uses_hook", "type_uses", "reads_state", "writes_state", "subscribes_to", "dispatches", "provides_context", "consumes_context", "routes_to")


#: Patterns of calls of a name or of a property (X.name), which are looked for in the file's calls.
_PROPERTY = r"\b([A-Za-z_$][\w$]*)\."
_CALLS = r"\b([A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)?+)\s*+\("
#: Patterns that stay on a line that begins with export.
_EXPORTS = r"(?m)^[ \t]*export[ \t]"
# What a text has in it if a pattern fits that few texts have.
_NEEDED = {_PROPERTY + "state": ".state", r"\bimport\(": "import(", r"require\(": "require(", r"\buseContext": "useContext", r"\bcomponent": "component", r"\belement": "element", r"\brender": "render"}


def mentions(files: DataFrame) -> DataFrame:
    """T18. file, type, target: distinct targets of every relation in every file.

    What ends in a call is found in the file's calls (name or owner.name), which are read from the text once.
    """
    read = files.select("file", F.coalesce("text", F.lit("")).alias("text"))
    read = read.withColumn("calls", F.array_distinct(F.regexp_extract_all("text", F.lit(_CALLS), F.lit(1))))
    read = read.withColumn("exported", F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*export[^\n]*"), F.lit(0)), "\n"))
    read = read.withColumn("called", F.concat(F.array_join("calls", "(\n"), F.lit("(")))
    found = {k: [_mentioned(p) for p in RELATIONS.get(k, ())] + [_names(F.col("exported" if p.startswith(_EXPORTS) else "text"), p) for p in [LISTS.get(k)] if p] for k in {**RELATIONS, **LISTS}}
    rows = read.select("file", F.inline(_distinct(found)))
    call = (F.col("type") == "calls") & F.substring_index("target", ".", 1).isin(*NOT_CALLS)
    return rows.where((F.col("target") != "") & ~call & ((F.col("type") != "uses_style") | F.col("target").rlike(r"\.s?css$")))


def _mentioned(pattern: str) -> Column:
    """What a pattern of RELATIONS finds in text, of which calls, called (each with its bracket, one a line) and exported (its
    lines that begin with export) are known.

    A call is the longest name, with its owner if it has one, before a bracket. So a pattern of one that ends in the bracket
    fits an end of a call, and one that begins with the owner fits whole calls.
    """
    if pattern in RELATIONS["calls"]:
        return F.col("calls")
    if pattern.startswith((_PROPERTY, r"\b(")) and pattern.endswith(r"\s*\("):
        return F.regexp_extract_all("called", F.lit(f"(?m)^{pattern[2:]}" if pattern.startswith(_PROPERTY) else pattern), F.lit(1))
    if pattern.startswith(_EXPORTS):
        return F.regexp_extract_all("exported", F.lit(pattern), F.lit(1))
    needed = next((x for start, x in _NEEDED.items() if pattern.startswith(start)), None)
    found = F.regexp_extract_all("text", F.lit(_led(pattern)), F.lit(1))
    return F.when(F.contains("text", F.lit(needed)), found).otherwise(F.array().cast("array<string>")) if needed else found


def _found(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]


def _distinct(targets: dict[str, list[Column]]) -> Column:
    """Structs type, target without repeats. Repeats go from lists of strings, in one pass: among structs each would be
    compared with all, in time that grows with the square of a file's mentions."""
    typed = lambda kind, names: F.transform(F.array_distinct(F.concat(*names)), lambda t: F.struct(F.lit(kind).alias("type"), t.alias("target")))
    return F.concat(*(typed(k, names) for k, names in targets.items()))


def _names(text: Column, pattern: str) -> Column:
    """Names of the lists that a pattern finds."""
    items = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.split(x, ",")))
    return F.filter(F.transform(items, lambda x: F.trim(F.substring_index(F.trim(x), " as ", 1))), lambda x: x.rlike(r"^[A-Za-z_$][\w$]*$"))


def symbol_edges(references: DataFrame, entities: DataFrame) -> DataFrame:
    """J16, G16. src, dst, type: references (file, type, target) resolved to entities (file::qualified_name).

    In order: the own file by full name, by short name; the only one anywhere by short name; then the first anywhere by
    id; an export is of the own file. Relations in OWN_FILE that find nothing point at the file itself, others are dropped.
    """
    short = F.col("name").alias("short")
    # one row a name anywhere: no name meets all files that have it
    anywhere = entities.groupBy(short).agg(F.min(X.entity_id(F.col("file"), F.col("qualified_name"))).alias("far"))
    asked = references.select("file", "type", "target", F.substring_index("target", ".", -1).alias("short")).join(anywhere, "short", "left")
    known = entities.select("file", F.lit(None).cast("string").alias("type"), F.col("qualified_name").alias("target"), short, F.lit(None).cast("string").alias("far"))
    # what is asked and what is known of a file meet in one exchange and one order, which serve the last distinct, too
    both = asked.select(*known.columns).unionByName(known).repartition("file").withColumn("w_key", F.xxhash64("file", "short"))
    own, name = F.when(F.col("type").isNull(), F.col("target")), ("w_key", "file", "short")  # numbers are ordered faster than the like names of files
    told = both.withColumn("exact", F.min(own).over(Window.partitionBy(*name, "target"))).withColumn("near", F.min(own).over(Window.partitionBy(*name)))
    best = F.coalesce(X.entity_id(F.col("file"), F.coalesce("exact", "near")), F.when(F.col("type") != "exports", F.col("far")), F.when(F.col("type").isin(*OWN_FILE), F.col("file")))
    return told.where("type is not null").select(F.col("file").alias("src"), best.alias("dst"), "type").where("dst is not null").distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """J15. src, dst, type of relative imports, exports and styles, resolved to the first candidate file that there is."""
    m = mentions(files).where("type in ('imports', 're_exports', 'type_imports', 'uses_style') and target like '.%'")
    folder = F.regexp_replace("file", "[^/]*$", "")
    joined = F.concat(folder, "target")
    for _ in range(8):  # a/../ and ./ go
        joined = F.regexp_replace(F.regexp_replace(joined, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    tails = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".json", ".css", ".scss", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    tried = m.select("file", "type", joined.alias("base")).select("file", "type", "base", F.posexplode(F.array(*(F.concat("base", F.lit(t)) for t in tails))).alias("pos", "candidate"))
    hit = tried.join(files.select(F.col("file").alias("candidate")), "candidate")
    return hit.groupBy("file", "type", "base").agg(F.min_by("candidate", "pos").alias("dst")).select(F.col("file").alias("src"), "dst", "type").distinct()


def ui_edges(bodies: DataFrame) -> DataFrame:
    """G24. src, dst, type among functions (id, name, qualified_name, body): renders, calls, state, props and styles.

    A name means all functions with that full name, else all with that short one; self-loops are dropped.
    """
    text = F.coalesce(F.col("body"), F.lit(""))
    kinds = {k: RELATIONS[k] for k in ("renders", "calls", "reads_state", "writes_state")} | {"passes_props": (PROPS,), "applies_style": (*RELATIONS["renders"], PROPS)}
    found = _distinct({k: _found(text, some) for k, some in kinds.items()})
    call = (F.col("type") == "calls") & F.substring_index("target", ".", 1).isin(*NOT_CALLS)
    styled = F.col("styled") | (F.col("type") != "applies_style")
    used = bodies.select(F.col("id").alias("src"), text.rlike(STYLED).alias("styled"), F.inline(found)).where((F.col("target") != "") & ~call & styled).drop("styled")
    named = bodies.select(F.col("id").alias("dst"), "name", "qualified_name")
    full = used.join(named, F.col("target") == F.col("qualified_name")).select("src", "type", "target", "dst", F.lit(0).alias("tier"))
    short = used.join(named, F.substring_index("target", ".", -1) == F.col("name")).select("src", "type", "target", "dst", F.lit(1).alias("tier"))
    least = F.min("tier").over(Window.partitionBy("src", "type", "target"))
    return full.unionByName(short).withColumn("least", least).where("tier = least and src <> dst").select("src", "dst", "type").distinct()


def documents(files: DataFrame, entities: DataFrame, most: tuple[int | None, int | None, int | None] = (12_000, 6_000, 4_000)) -> DataFrame:
    """R18. Documents of three levels: files, modules (classes) and functions, each of so many signs at most (None: all)."""
    cut_to = lambda c, n: F.col(c) if n is None else F.substring(c, 1, n)
    lines = files.select("file", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), "text")
    whole = lines.select(F.col("file").alias("doc_id"), F.lit("file").alias("level"), "file", F.concat_ws("\n", "file", cut_to("text", most[0])).alias("text"))
    joined = entities.join(lines, "file").withColumn("body", F.concat_ws("\n", F.slice("lines", F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1))))
    of = lambda level, n: joined.select(X.entity_id(F.col("file"), F.col("qualified_name")).alias("doc_id"), F.lit(level).alias("level"), "file", F.concat_ws("\n", "file", "qualified_name", cut_to("body", n)).alias("text"), "kind")
    modules = of("module", most[1]).where("kind = 'class'").drop("kind")
    functions = of("function", most[2]).where("kind <> 'class'").drop("kind")
    return whole.unionByName(modules).unionByName(functions)


def gold_entities(patches: DataFrame, entities: DataFrame) -> DataFrame:
    """M13, J07. instance_id, level, item: files, modules and functions that a patch's old lines touch."""
    from weftline.operators.diffs import changed_old_lines

    lines = changed_old_lines(patches).select("instance_id", X.normalize_path(F.col("file")).alias("file"), F.col("old_line").alias("at"))
    spans = entities.select("file", "kind", "qualified_name", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"))
    hit = containing(lines, spans, "file")
    files = lines.select("instance_id", F.lit("file").alias("level"), F.col("file").alias("item"))
    modules = hit.select("instance_id", F.lit("module").alias("level"), F.when(F.col("kind") == "class", X.entity_id(F.col("file"), F.col("qualified_name"))).otherwise(X.module_id(F.col("file"), F.col("qualified_name"))).alias("item"))
    functions = hit.where("kind <> 'class'").select("instance_id", F.lit("function").alias("level"), X.entity_id(F.col("file"), F.col("qualified_name")).alias("item"))
    return files.unionByName(modules).unionByName(functions).distinct()


def rank_entities(entities: DataFrame, context: Column, k: int = 15) -> DataFrame:
    """W06. Entities by shared terms, +3 for the name and +5 for the full name in the context; shorter, then later first."""
    both = F.size(F.array_intersect(X.terms(context), X.terms(F.concat_ws(" ", "name", "qualified_name"))))
    said = lambda c, n: F.when(F.contains(context, F.col(c)) & (F.col(c) != ""), n).otherwise(0)
    scored = entities.withColumn("score", both + said("name", 3) + said("qualified_name", 5))
    order = [F.desc("score"), F.col("end_line") - F.col("start_line"), F.desc("start_line"), F.col("qualified_name")]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def rank_files(candidates: DataFrame, problem: Column) -> DataFrame:
    """A27. Candidate paths (path) by how often they are named, terms shared with the problem, depth and name."""
    n = candidates.groupBy("path").agg(F.count("*").alias("n"), F.first(problem).alias("problem"))
    shared = F.size(F.array_intersect(X.stem_tokens(F.col("path")), X.terms(F.col("problem"))))
    return n.select("path", "n", shared.alias("overlap"), F.size(F.split("path", "/")).alias("depth")).orderBy(F.desc("n"), F.desc("overlap"), F.desc("depth"), F.desc("path"))


def node_score(keywords: Column, kind_prior: Column, name: Column, path: Column, content: Column, anchored: Column, most: int | None = 4000) -> Column:
    """W08. Prior of the type, 3 for each keyword in the name, 2 in the path, 1 in the content (its first signs, if most is given), 25 for an anchor."""
    inside = lambda c: F.size(F.filter(keywords, lambda k: F.contains(F.lower(c), F.lower(k))))
    return kind_prior + 3 * inside(name) + 2 * inside(path) + inside(content if most is None else F.substring(content, 1, most)) + F.when(anchored, 25).otherwise(0)


def call_tree(events: DataFrame) -> DataFrame:
    """J10, G21. Trace events (id, pid, tid, ts, dur, name) with their nearest enclosing call and depth.

    Depth is the number of enclosing calls of the same thread. Bounds are whole microseconds. Events without a time, or
    of a negative duration, have no parent and depth 0.
    """
    from weftline.operators.intervals import enclosing

    spans = events.select("id", F.concat_ws("/", "pid", "tid").alias("thread"), F.floor("ts").alias("start"), F.floor(F.col("ts") + F.col("dur")).alias("end"))
    return events.select("id", "name").join(enclosing(spans, "thread"), "id", "left").select("id", "name", "parent", F.coalesce("depth", F.lit(0)).alias("depth"))
