"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a Column expression: there is no user function, join or exchange, so a document costs one pass over its
text wherever it lies. Words are [^\\x20\\x09-\\x0D]+, unchanged.

Defined results: a null text is empty, an empty text has no words and fails the base rule; every row is judged by
itself, so ties and repeated rows do not matter; three-word windows are compared by 64-bit hashes; an empty table gives an empty result; passing() keeps all columns of its
input, and its helper column is named so that it cannot clash with them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import set_apart

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that for on was with as it are be by this at from or an not".split(),
    "fr": "le la les de des du et en un une est que qui dans pour pas sur avec au".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine".split(),
    "es": "el la los las de que y en un una es por con no para su se del al".split(),
}


class Rule(NamedTuple):
    """A measure must lie in [low, high]; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


#: The threshold table.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_share", None, 0.3),
    Rule("shout_share", None, 0.3),
    Rule("stop_word_share", 0.05, None),
    Rule("dup_line_share", None, 0.5),
)


def _stop_pattern() -> str:
    """Stop words between white space or the text's ends, alternatives grouped by their first letter."""
    first: dict[str, set[str]] = {}
    for word in {x for own in STOP_WORDS.values() for x in own}:
        first.setdefault(word[0], set()).add(word[1:])
    words = "|".join(f"{c}(?:{'|'.join(sorted(rest, key=lambda r: (-len(r), r)))})" for c, rest in sorted(first.items()))
    return rf"(?<![^ \t\n\x0B\f\r])(?:{words})(?![^ \t\n\x0B\f\r])"


#: The columns that measure() adds.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_share", "shout_share", "stop_word_share", "dup_line_share", "base_failed", "kept")


def measure(docs: DataFrame, id_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id columns, the counts and shares of every text, base_failed and kept (with further underscores where an id has the
    name). A very long text takes time and memory in proportion to it, in its own task."""
    apart = set_apart(docs, id_cols, text_col, MEASURED, lambda d, ids, text: measure(d, ids, text, rules))
    if apart is not None:
        return apart
    words = r"array_remove(split(w_text, '[ \\t\\n\\x0B\\f\\r]+'), '')"
    # Lines with a word, each from its start: blank ones never match, and no match is tried within a line.
    lines = F.regexp_extract_all("w_text", F.lit(r"(?dm)^[ \t\x0B\f\r]*+[^ \t\n\x0B\f\r][^\n]*+"), F.lit(0))
    a = docs.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("w_text"))
    b = a.select(*id_cols, "w_text", F.expr(words).alias("w_words"), lines.alias("w_lines"))
    hashes = "case when size(w_words) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(w_words) - 3), i -> xxhash64(w_words[i], w_words[i + 1], w_words[i + 2])) end"
    c = b.select(
        *id_cols,
        F.size("w_words").cast("long").alias("n_words"),
        F.length(F.translate("w_text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("w_text") - F.length(F.translate("w_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("w_text") - F.length(F.replace("w_text", F.lit("!!"), F.lit("")))).cast("long").alias("w_shout"),
        F.regexp_count(F.lower("w_text"), F.lit(_stop_pattern())).alias("w_stop"),
        F.size("w_lines").alias("w_n_lines"),
        (F.size("w_lines") - F.size(F.array_distinct("w_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(hashes).alias("w_hashes"),
    )
    # Only a text that has a three-word window twice sorts its windows (with their places); equal neighbours are repeats.
    kept = [x for x in c.columns if x != "w_hashes"]
    places = "sequence(0, size(w_hashes) - 1)"
    d = c.select(*kept, F.expr(f"case when size(array_distinct(w_hashes)) < size(w_hashes) then sort_array(cast(arrays_zip(w_hashes, {places}) as array<struct<h: bigint, i: int>>)) end").alias("w_sorted"))
    again = "filter(w_sorted, (x, j) -> (j > 0 and x.h = w_sorted[j - 1].h) or (j + 1 < size(w_sorted) and x.h = w_sorted[j + 1].h))"
    e = d.select(*kept, F.expr(f"flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2)))").alias("w_covered"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    f = e.select(*kept, F.coalesce(F.size(F.array_distinct("w_covered")), F.lit(0)).cast("long").alias("n_repeat_words"))
    n = F.greatest("n_words", F.lit(1))
    shares = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "shout_share": F.col("w_shout") / 2 / n,
        "stop_word_share": F.col("w_stop") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("w_n_lines", F.lit(1)),
    }
    g = f.select(*id_cols, *counts, F.greatest("n_repeat_words", F.lit(0)).cast("long").alias("n_repeat_words"), *(v.alias(k) for k, v in shares.items()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.lit(True)
    for rule in rules:
        for ok in ([F.col(rule.measure) >= rule.low] if rule.low is not None else []) + ([F.col(rule.measure) <= rule.high] if rule.high is not None else []):
            fine = fine & ok
    return g.select("*", failed.alias("base_failed"), (~failed & fine).alias("kept"))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns and nothing else."""
    row = "w_row"
    while row in docs.columns:
        row += "_"
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))
    # As a generator's output the verdict is not copied into the filter, which would repeat its expressions.
    judged = measure(whole.select(row, F.col(f"{row}.`{text_col}`").alias("w_own")), [row], "w_own", rules)
    kept = judged.select(row, F.explode(F.array("kept")).alias("w_kept")).where("w_kept")
    return kept.select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
