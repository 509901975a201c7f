"""Edits that answers propose for files, and skeletons of Python files."""

from __future__ import annotations

import ast
import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The marks of a search-and-replace block.
SEARCH, MIDDLE, REPLACE = "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE"


def edit_blocks(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """T31. key, file, pos, search, replace: the distinct blocks of every answer in order of their first place.

    A block's file stands before it, after number signs; a block without one belongs to the file of the block before.
    What is not one block (two openings, no middle line) is left out, and so are blocks before any file.
    """
    pieces = answers.select(key, F.posexplode(F.split(F.col(text), f"\\Q{REPLACE}\\E")).alias("at", "piece"), F.size(F.split(F.col(text), f"\\Q{REPLACE}\\E")).alias("n")).where("at < n - 1")
    parts = pieces.select(key, "at", F.split(F.trim(F.col("piece")), f"\\Q{SEARCH}\\E").alias("p"))
    named = F.regexp_extract(F.col("p")[0], r"^[\s#]*(\S(?:.*\S)?)\s*$", 1)
    here = F.when((F.size("p") > 1) & (named != ""), named)
    before = Window.partitionBy(key).orderBy("at")
    filed = parts.withColumn("file", F.last(here, True).over(before)).where("size(p) = 2 and file is not null")
    halves = filed.select(key, "at", "file", F.split(F.regexp_replace(F.concat(F.get("p", F.lit(1)), F.lit("\n")), r"\A[^\n]*\n|\s*\z", ""), f"(?:\\A|\n){MIDDLE}(?:\n|\\z)").alias("h")).where("size(h) = 2")
    first = halves.groupBy(key, "file", F.get("h", F.lit(0)).alias("search"), F.get("h", F.lit(1)).alias("replace")).agg(F.min("at").alias("at"))
    return first.select(key, "file", (F.row_number().over(Window.partitionBy(key, "file").orderBy("at")) - 1).alias("pos"), "search", "replace")


def apply_blocks(content: Column, blocks: Column) -> Column:
    """T31. content after blocks (array of struct<pos, search, replace>), the last one first; each is of whole lines.

    A first line of three dots on either side does not count; what is not in the file, or empty, changes nothing.
    """
    undotted = lambda c: F.regexp_replace(c, r"\A\.\.\.\n(?=.)", "")
    lined = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    some = F.filter(F.reverse(F.array_sort(blocks)), lambda b: b["search"] != "")
    done = F.aggregate(some, lined(content), lambda text, b: F.replace(text, lined(undotted(b["search"])), lined(undotted(b["replace"]))))
    return F.substring(done, F.lit(2), F.length(done) - 2)


def edit_calls(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """T31. key, file, pos, start, end, text: the distinct calls `edit_file(file, start, end, content)` in the Python blocks
    of every answer, by file in order of their first place.

    The first three arguments go up to the next comma, with or without their names, the file without its quotes; the
    content up to the last bracket before the next call or the block's end. A string of Python stands for its value; what
    is none (a named argument, line breaks in single quotes) stays as it is written, without name and outer quotes. Calls
    whose lines are no numbers, or that have fewer arguments, are left out; so are answers of null.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit("(?s)```python\n(.*?)\n```"), F.lit(1))
    calls = F.flatten(F.transform(blocks, lambda b: F.slice(F.split(b, r"edit_file\("), F.lit(2), F.length(b) + 1)))
    said = answers.select(key, F.posexplode(calls).alias("at", "call")).select(key, "at", F.split("call", ",", 4).alias("a")).where("size(a) = 4")
    bare = lambda i, named: F.trim(F.regexp_replace(F.get("a", F.lit(i)), rf"^\s*{named}\s*=", ""))
    number = lambda i, named: F.regexp_extract(bare(i, named), "^[+-]?[0-9]{1,9}$", 0).try_cast("int")
    file = F.regexp_replace(bare(0, "[A-Za-z_]+"), "^[\"']|[\"']$", "")
    raw = F.regexp_extract(F.get("a", F.lit(3)), r"(?s)\A(.*)\)", 1)
    rows = said.select(key, "at", file.alias("file"), number(1, "start").alias("start"), number(2, "end").alias("end"), raw.alias("raw")).where("start is not null and end is not null")
    first = rows.groupBy(key, "file", "start", "end", "raw").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key, "file").orderBy("at")) - 1
    return first.select(key, "file", place.alias("pos"), "start", "end", _value("raw").alias("text"))


@F.pandas_udf(StringType())
def _value(written: pd.Series) -> pd.Series:
    return written.map(string_value)


def string_value(written: str) -> str:
    """The value of a string of Python; what is none stays, without the name `content` and outer quotes."""
    try:
        value = ast.literal_eval(written)
        if isinstance(value, str):
            return value
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        pass
    value = written.strip().removeprefix("content=")
    if value.startswith(('"""', "'''")):
        value = value[3:-3]
    return value[1:-1] if value.startswith(('"', "'")) else value


def apply_lines(content: Column, edits: Column) -> Column:
    """T31. content after edits (array of struct<start, end, text>: lines start to end, from 1, become the text's lines),
    the last lines first, those of one start in their order, equal ones once. An empty text takes the lines away, an end
    before the start puts the text before it. One line for one line takes over its indentation if it has none. Edits that
    start or end outside of the content change nothing.
    """
    lines = F.split(content, "\n")
    inside = F.filter(F.array_distinct(edits), lambda e: e["start"].between(1, F.size(lines)) & e["end"].between(0, F.size(lines)))
    order = F.array_sort(F.transform(inside, lambda e, i: F.struct((-e["start"]).alias("down"), i.alias("at"), e.alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        e = x["e"]
        new = F.when(e["text"] == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(e["text"], r"\n\z", ""), "\n"))
        single = (e["start"] == e["end"]) & (F.size(new) == 1) & ~e["text"].rlike(r"\A\s")
        put = F.when(single, F.transform(new, lambda one: F.concat(F.regexp_extract(F.get(acc, e["start"] - 1), r"\A\s*", 0), one))).otherwise(new)
        rest = F.greatest(e["end"], e["start"] - 1)
        return F.concat(F.slice(acc, F.lit(1), e["start"] - 1), put, F.slice(acc, rest + 1, F.greatest(F.size(acc) - rest, F.lit(0))))

    return F.array_join(F.aggregate(order, lines, step), "\n")


def skeleton(code: str, constants: bool = True) -> str:
    """Classes, functions and, if wanted, assignments of a Python module: bodies of functions are three dots, strings that
    document classes go. What does not parse stays as it is."""
    try:
        tree = ast.parse(code)
        colons = [t.start for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type == tokenize.OP and t.string == ":"]
    except (SyntaxError, ValueError, tokenize.TokenError):
        return code
    lines = code.split("\n")
    cuts: list[tuple] = []  # (line, column) from, to, and what comes instead; lines from 0

    def first_line(node) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1

    def column(line: int, in_bytes: int) -> int:
        return len(lines[line].encode()[:in_bytes].decode())

    def header_end(node) -> tuple[int, int]:
        at = node.body[0]
        line = first_line(at)
        start = (line + 1, column(line, at.col_offset) if line == at.lineno - 1 else 0)
        row, col = max(c for c in colons if c < start)
        return row - 1, col + 1

    def drop(body: list, gone, after: int) -> list:
        """Cuts lines of statements; what stands on one line goes or stays with its first statement."""
        stay = []
        for k, node in enumerate(body):
            start = first_line(node)
            if k and start == body[k - 1].end_lineno - 1:  # on the line of the one before
                if stay and stay[-1] is body[k - 1]:
                    stay.append(node)
                else:
                    cuts.append(((start, 0), (node.end_lineno, 0), ""))
            elif gone(node):
                cuts.append(((after, 0), (node.end_lineno, 0), ""))
            else:
                stay.append(node)
            after = node.end_lineno
        return stay

    def visit(node) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            end = node.end_lineno - 1
            cuts.append((header_end(node), (end, len(lines[end])), "\n..."))
            return
        if isinstance(node, ast.ClassDef):
            row, col = header_end(node)
            if row < first_line(node.body[0]):
                text = lambda s: isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)
                if not drop(node.body, text, row + 1):
                    cuts.append(((row, len(lines[row])), (row, len(lines[row])), "\n" + " " * node.body[0].col_offset + "pass"))
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                visit(child)

    kept = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef) + ((ast.Assign,) if constants else ())
    for node in drop(tree.body, lambda s: not isinstance(s, kept), first_line(tree.body[0]) if tree.body else 0):
        visit(node)
    out, at = [], (0, 0)
    ends = [0]
    for x in lines:
        ends.append(ends[-1] + len(x) + 1)
    place = lambda p: min(ends[p[0]] + p[1], len(code))
    for start, end, instead in sorted(cuts):
        if start >= at:
            out += [code[place(at) : place(start)], instead]
            at = max(at, end)
    return "".join(out) + code[place(at) :]


def skeletons(files: DataFrame, constants: bool = True) -> DataFrame:
    """T33. file and text of every file's skeleton; null texts stay null."""
    def compress(parts):
        for pdf in parts:
            yield pd.DataFrame({"file": pdf["file"], "text": [t if t is None else skeleton(t, constants) for t in pdf["text"]]})

    return files.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text")).mapInPandas(compress, "file string, text string")
