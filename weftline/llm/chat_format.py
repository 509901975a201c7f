"""Chat formatting of reply trees.

Iterative self-joins (each doubles the reach of the known steps to ancestors) enumerate the root-to-leaf paths of every
conversation; branches are ranked by the mean score of their messages, and each chosen path becomes one conversation in
a template whose control strings cannot occur inside texts: a backslash is doubled, and a backslash breaks up every
control string, of this template and of common others, after its first character. unescape() undoes both.

Defined results: a null text or role is empty, a null score counts 0; a message whose parent is null or missing is a
root; messages on or below a cycle, and those without an id, belong to no path; of rows that repeat a message id the least (parent, role, text, score)
counts; score ties go to the least path; a very long conversation's chosen paths are each one row; an empty table gives no conversation; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import cut

# The template's parts, and the control strings that texts must not contain: <| |> <s> </s> <<SYS>> <</SYS>> [INST] [/INST].
OPEN, NAMED, CLOSE = "<|turn:", "|>\n", "<|end|>\n"
_BREAK_ANGLE = r"<(\||/?s>|</?SYS>>)"
_BREAK_SQUARE = r"\[(/?INST\])"
_BREAK_BAR = r"\|(>)"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern, first in ((_BREAK_ANGLE, "<"), (_BREAK_SQUARE, "["), (_BREAK_BAR, "|")):
        out = F.regexp_replace(out, pattern, rf"{first}\\$1")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """conv, leaf, path (message ids from the root) and score of every root-to-leaf path of (conv, id, parent, score).

    Self-joins double a step from message to ancestor until no message has one that far; then the leaves' paths grow by
    these steps, the longest first. Only leaves ever have paths, so a chain of n messages takes n log n rows, not n * n.
    """
    nodes = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = nodes.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    same = F.col("conv").eqNullSafe(F.col("c"))
    steps = [cut(nodes.join(ids, same & (F.col("parent") == F.col("i"))).select("conv", "id", F.col("parent").alias("anc")))]
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while (1 << len(steps)) <= 2 * most and not steps[-1].isEmpty():
        on = steps[-1].select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("anc").alias("a"))
        steps.append(cut(steps[-1].join(on, same & (F.col("anc") == F.col("i"))).select("conv", "id", F.col("a").alias("anc"))))
    replied = nodes.select(F.col("conv").alias("c"), F.col("parent").alias("i")).where("i is not null").distinct()
    endless = steps[-1].select(F.col("conv").alias("c"), F.col("id").alias("i"))  # after as many steps as there are messages: below a cycle
    leaves = nodes.join(replied, same & (F.col("id") == F.col("i")), "left_anti").join(endless, same & (F.col("id") == F.col("i")), "left_anti")
    known = leaves.select("conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(steps) - 1)):
        on = steps[k].select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("anc").alias("a"))
        above = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("id"), (F.col("up") + (1 << k)).alias("up")))
        both = F.array_compact(F.array(F.struct("id", "up"), above))
        known = known.join(on, same & (F.col("id") == F.col("i")), "left").select("conv", "leaf", F.inline(both))
    at = known.join(nodes.select(F.col("conv").alias("c"), F.col("id").alias("i"), "score"), same & (F.col("id") == F.col("i")))
    paths = at.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), "id", "score"))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["score"])
    return paths.select("conv", "leaf", F.col("p.id").alias("path"), (total / F.size("p")).alias("score"))


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """conv, branch (rank of the path), n_turns, formatted and loss_spans of (conv, id, parent, role, text, score).

    loss_spans are [start, end) in code points of the assistant texts as they stand in formatted.
    """
    fields = ["parent", "role", "text", "score"]
    once = messages.groupBy("conv", "id").agg(F.min(F.struct(*fields)).alias("m")).select("conv", "id", *(f"m.{f}" for f in fields))
    # Spark keeps the best few of each conversation before it shuffles: the filter on the rank goes into the window.
    order = Window.partitionBy("conv").orderBy(F.desc("score"), "path")
    chosen = leaf_paths(once).withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)
    steps = chosen.select(F.col("conv").alias("c"), "branch", F.posexplode("path").alias("depth", "i"))
    texts = once.join(steps, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("id") == F.col("i")))
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = texts.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(NAMED))
    parts = turns.select("conv", "branch", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return parts.select(
        "conv",
        "branch",
        F.size("parts").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))).alias("formatted"),
        F.aggregate("parts", start, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> tuple[Column, Column]:
    """Arrays of the roles and texts of a formatted conversation."""
    pattern = F.lit(r"(?s)<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n")
    return tuple(F.transform(F.regexp_extract_all(formatted, pattern, F.lit(k)), unescape) for k in (1, 2))


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: every row, by (turn, role, text), replies to the one before it."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "role", "text").withColumn("id", F.row_number().over(order))
    return numbered.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
