"""Stored index of the lines of files, searched by several terms at once: texts that a line holds, or regular expressions.

Files are cut into numbered blocks of whole lines, and every block is posted under each three letters in a row that it has. A term
meets, in an equi-join, the blocks under its own rarest letters; only their lines are then compared with it. Terms without
three letters that a line must have are compared with all lines, so what is found does not depend on the index.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weftline.functions import text as X
from weftline.operators.intervals import context_windows
from weftline.session import cut, spread

#: Lines of a block.
LINES = 64
#: Folders over which the letters are spread.
BUCKETS = 64
#: The rarest letters of a term that a block must have before its lines are read.
RAREST = 6
#: Entries that a task combines before it sends them.
HELD = 1_000_000
#: Terms without such letters that go to all lines in one scan.
BARE = 200

_SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def triples(text: str | None) -> list[str]:
    """Distinct three letters in a row within a line, A-Z as a-z."""
    small = (text or "").translate(_SMALL)
    return [g for g in {small[i : i + 3] for i in range(len(small) - 2)} if "\n" not in g]


def literals(pattern: str) -> list[str]:
    """Texts that every match of a regular expression has: runs of plain signs outside of groups, classes and choices.

    Nothing is said of patterns with a choice, a quotation, a code of a sign, nested classes or an extension other than
    (?i) at the start.
    """
    rest = pattern.removeprefix("(?i)")
    if "|" in rest or "(?" in rest or r"\Q" in rest:
        return []
    found, depth = [""], 0
    # an escaped sign, a class, a counted repeat, or a single sign
    for part in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", rest, re.DOTALL):
        if part[0] == "[" and "[" in part[1:] or part[0] == "\\" and part[1:].isalnum() and part[1:] not in "dDsSwWbBtn":
            return []
        if part[0] in "*?{":
            found[-1] = found[-1][:-1]  # what is repeated need not be there
        if part == "(":
            depth += 1
        elif part == ")":
            depth -= 1
        plain = part[1:] if part[0] == "\\" and not part[1:].isalnum() else part if len(part) == 1 and part not in r"\.^$*+?()[]{}" else ""
        if plain and depth == 0:
            found[-1] += plain
        else:
            found.append("")
    return [x for x in found if len(x) > 2]


def _posted(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """letters and the blocks that have them, combined over some blocks of a task, as rows get fewer by this."""
    held: dict[str, list[int]] = {}
    n = 0
    for pdf in parts:
        for block, text in zip(pdf["id"].tolist(), pdf["text"]):
            for g in triples(text):
                held.setdefault(g, []).append(block)
                n += 1
            if n >= HELD:
                yield pd.DataFrame({"letters": list(held), "ids": list(held.values())})
                held, n = {}, 0
    if held:
        yield pd.DataFrame({"letters": list(held), "ids": list(held.values())})


@F.pandas_udf(ArrayType(StringType()))
def _asked(kind: pd.Series, term: pd.Series) -> pd.Series:
    """The letters that lines of a term must have."""
    needed = lambda k, t: sorted({g for x in (literals(t) if k == "regex" else [t]) for g in triples(x)})
    return pd.Series([needed(k, t or "") for k, t in zip(kind, term)], dtype=object)


class LineIndex:
    """R15. An index in a folder: `blocks` (id, file, block, first line, lines) and `letters` (letters, ids of blocks)."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    @classmethod
    def build(cls, files: DataFrame, path: str, lines: int = LINES, buckets: int = BUCKETS) -> LineIndex:
        """Of files (file, text); null texts have no line, files of null names are left out.

        The letters are written in ranges of (letters, first block), so frequent ones have several tasks and files.
        """
        made = cls(files.sparkSession, path)
        first = F.explode(F.sequence(F.lit(0), F.floor((F.size("w_lines") - 1) / lines)))
        blocks = files.where("file is not null and text is not null").select(F.col("file").cast("string").alias("file"), F.split("text", "\n").alias("w_lines")).select("file", "w_lines", first.alias("block"))
        numbered = blocks.select(F.monotonically_increasing_id().alias("id"), "file", "block", (F.col("block") * lines + 1).alias("first_line"), F.slice("w_lines", F.col("block") * lines + 1, F.lit(lines)).alias("lines"))
        numbered.write.parquet(f"{made._path}/blocks")  # the numbers are those written, whatever is computed again
        letters = cut(spread(made.blocks().select("id", F.array_join("lines", "\n").alias("text"))).mapInPandas(_posted, "letters string, ids array<bigint>"))
        bucket = F.pmod(F.xxhash64("letters"), F.lit(buckets)).cast("int")
        order = ["bucket", "letters", F.col("ids")[0]]
        placed = letters.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order)
        placed.write.partitionBy("bucket").parquet(f"{made._path}/letters")
        made.letters().groupBy("letters").agg(F.sum(F.size("ids")).alias("n"), F.first("bucket").alias("bucket")).write.parquet(f"{made._path}/counts")
        files.sparkSession.range(1).select(F.lit(lines).alias("lines")).write.parquet(f"{made._path}/whole")  # the last to be written
        return made

    def blocks(self) -> DataFrame:
        """id, file, block, first_line, lines: whole lines of files."""
        return self._spark.read.parquet(f"{self._path}/blocks")

    def letters(self) -> DataFrame:
        return self._spark.read.schema("letters string, ids array<bigint>, bucket int").parquet(f"{self._path}/letters")

    def candidates(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(term_id, id of a block) that have the rarest letters of terms (term_id, kind, term), and the terms without any."""
        asked = terms.select("term_id", "kind", "term", _asked("kind", "term").alias("letters"))
        some = asked.select("term_id", F.explode("letters").alias("letters"))
        counts = self._spark.read.parquet(f"{self._path}/counts")
        rank = F.row_number().over(Window.partitionBy("term_id").orderBy(F.coalesce("n", F.lit(0)), "letters"))
        rare = some.join(counts, "letters", "left").withColumn("w_rank", rank).where(F.col("w_rank") <= RAREST)
        needed = rare.select("term_id", "letters", "bucket", F.count("*").over(Window.partitionBy("term_id")).alias("needed"))
        read = [r.bucket for r in needed.select("bucket").where("bucket is not null").distinct().collect()]  # BUCKETS at most
        posted = self.letters().where(F.col("bucket").isin(read)).join(needed.drop("bucket"), "letters").select("term_id", "needed", F.explode("ids").alias("id"))
        hits = posted.groupBy("term_id", "needed", "id").agg(F.count("*").alias("n"))  # a block is posted once under its letters
        return hits.where("n = needed").select("term_id", "id"), asked.where(F.size("letters") == 0).select("term_id", "kind", "term")

    def search(self, terms: DataFrame, pattern: str | None = None) -> DataFrame:
        """term_id, file, line_no, line: all lines that hold a term (term_id, kind, term), each once a term and row of files.

        Kinds: `text` (as it stands), `small` (A-Z as a-z) and `regex` (found anywhere in the line). A glob or substring
        narrows the files, unless no file matches it. Null terms find nothing, empty ones every line.
        """
        stated = terms.select("term_id", "kind", "term").where("term is not null")
        near, bare = self.candidates(stated)
        blocks = self.blocks()
        if pattern is not None:
            inside = X.matches_path(F.col("file"), pattern)
            if not blocks.select("file").where(inside).isEmpty():
                blocks = blocks.where(inside)
        met = near.join(stated, "term_id").join(blocks, "id")
        met = met.select("term_id", "kind", "term", "file", "first_line", "lines")
        for some in _in_blocks(bare.collect(), BARE):  # stated terms
            each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in r.asDict().items())) for r in some))).alias("w_term")
            met = met.unionByName(blocks.select("file", "first_line", "lines", each).select("w_term.*", "file", "first_line", "lines"))
        rows = met.select("term_id", "kind", "term", "file", "first_line", F.posexplode("lines").alias("w_pos", "line"))
        return rows.where(_holds(F.col("kind"), F.col("line"), F.col("term"))).select("term_id", "file", (F.col("first_line") + F.col("w_pos")).alias("line_no"), "line")

    def at(self, places: DataFrame) -> DataFrame:
        """file, line_no, line of stated places (file, line_no); those outside of a file are left out."""
        n = self._spark.read.parquet(f"{self._path}/whole").first()["lines"]
        asked = places.where("line_no >= 1").select("file", "line_no", F.floor((F.col("line_no") - 1) / n).alias("block")).distinct()
        line = F.get("lines", (F.col("line_no") - F.col("first_line")).cast("int"))
        return asked.join(self.blocks(), ["file", "block"]).select("file", "line_no", line.alias("line")).where("line is not null")


def _in_blocks(rows: list, size: int) -> Iterable[list]:
    return (rows[i : i + size] for i in range(0, len(rows), size))


def _holds(kind: Column, line: Column, term: Column) -> Column:
    small = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(kind == "regex", F.regexp_like(line, term)).when(kind == "small", F.contains(small(line), small(term))).otherwise(F.contains(line, term))


def snippets(hits: DataFrame, sizes: DataFrame, around: int = 3) -> DataFrame:
    """R15, W12, W14. file, start, end, terms, n: lines around hits (term_id, file, line_no), within files of so many
    lines (file, last), merged where they overlap, with the distinct terms found inside in order and the number of hits."""
    lines = hits.select("file", F.col("line_no").alias("line")).distinct().join(sizes, "file")
    windows = context_windows(lines, "file", around).select("file", "start", "end")
    inside = hits.join(windows, "file").where("start <= line_no and line_no <= end")
    return inside.groupBy("file", "start", "end").agg(F.array_sort(F.collect_set("term_id")).alias("terms"), F.count("*").alias("n"))


def stored(files: DataFrame, folder: str, **how) -> LineIndex:
    """A new index below a folder."""
    return LineIndex.build(files, f"{folder}/lines-{uuid.uuid4().hex}", **how)


def terms_of(spark: SparkSession, kind: str, terms: Iterable[str]) -> DataFrame:
    """Stated terms as rows, numbered from 0."""
    return spark.createDataFrame([(i, kind, t) for i, t in enumerate(terms)], "term_id long, kind string, term string")
