"""Language identification with hyperdimensional profiles.

Every letter has a random vector of D signs; an n-gram is bound from its letters' vectors, each permuted (rolled) by its
place; bundling (adding) a text's n-grams gives its profile, and adding the profiles of a language's texts its
prototype. A text gets the language whose prototype is nearest by cosine. Letters are Unicode letters in lower case; a
run of anything else is one word border, which counts as a letter.

Training sends one vector a language and partition, whatever the number of documents, and adds them in two steps. The
prototypes, 8 KB for each language, are held by the driver and go to the tasks in blocks of BLOCK languages, which a text
meets one after another; any number of languages gives the same results as one block would.

Defined results: a null text, or one without a letter, is "und" with score 0, as is every text if nothing was learned;
texts of a null language are not learned from; ties go to the first language by name; rows that repeat a document are
learned from and judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.scratch import set_apart

D = 1024
GRAM = 3
CHUNK_BYTES = 1_000_000
#: Languages that a text is compared with at once.
BLOCK = 1024
_BORDER = 0x20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, else 0."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


@lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    seed = np.arange(D, dtype=np.uint64) + np.uint64(code * D + 1)
    return (W._mix(seed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points."""
    codes, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    base = np.array([letter_vector(int(c)) for c in codes]).reshape(-1, D)
    out = np.ones((len(grams), D), np.int8)
    for k in range(GRAM):
        out *= np.roll(base, GRAM - 1 - k, axis=1)[at[:, k]]
    return out.astype(np.float32)


def profiles(texts: list[str], groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Profile of every group of texts, and which texts have a letter. All sums are of whole numbers, thus exact."""
    joined = "".join(f" {t} " for t in texts)
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    lengths = np.array([len(t) + 2 for t in texts])
    ends = np.cumsum(lengths)
    letter = code > 0
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[ends - 1] = True
    has = np.add.reduceat(letter, ends - lengths) > 0
    text = np.repeat(np.arange(len(texts)), lengths)[keep]
    code = np.where(code, code, _BORDER)[keep]
    inside = text[GRAM - 1 :] == text[: len(text) - GRAM + 1]
    present = np.zeros(0x110000, bool)
    present[code] = True
    codes = np.flatnonzero(present)
    small = np.zeros(0x110000, np.int32)
    small[codes] = np.arange(len(codes))
    own, n = small[code].astype(np.int64), len(codes)
    if len(own) < GRAM:  # one text without a letter
        return np.zeros((n_groups, D), np.float32), has
    key = np.zeros(len(own) - GRAM + 1, np.int64)
    for k in range(GRAM):
        key = key * n + own[k : len(own) - GRAM + 1 + k]
    key, of = key[inside], groups[text[: len(text) - GRAM + 1][inside]]
    if n**GRAM <= 4_000_000:
        seen = np.zeros(n**GRAM, bool)
        seen[key] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(n**GRAM, np.int32)
        place[distinct] = np.arange(len(distinct))
        at = place[key].astype(np.int64)
    else:
        distinct, at = np.unique(key, return_inverse=True)
    grams = np.stack([codes[distinct // n ** (GRAM - 1 - k) % n] for k in range(GRAM)], axis=1)
    out = np.zeros((n_groups, D), np.float32)
    step = max(1, 8_000_000 // max(n_groups, D))
    for a in range(0, len(distinct), step):
        b = min(len(distinct), a + step)
        some = (at >= a) & (at < b) if b - a < len(distinct) else slice(None)
        counts = np.bincount(of[some] * (b - a) + at[some] - a, minlength=n_groups * (b - a)).reshape(n_groups, b - a)
        out += counts.astype(np.float32) @ gram_vectors(grams[a:b])
    return out, has


def _texts(batch: pa.RecordBatch):
    """(rows, texts) of a batch in chunks; null is None."""
    for a, b in W.batches(batch.column("text"), CHUNK_BYTES):
        rows = batch.slice(a, b - a)
        yield rows, rows.column("text").to_pylist()


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Prototype of every language, from all texts that have one."""
    source = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def bundle(parts):
        total: dict[str, np.ndarray] = {}
        for batch in parts:
            for rows, texts in _texts(batch):
                langs = rows.column("lang").to_pylist()
                names = sorted(set(langs))
                found, _ = profiles(texts, np.array([names.index(x) for x in langs]), len(names))
                for name, vector in zip(names, found.astype(np.float64), strict=True):
                    total[name] = total.get(name, 0) + vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "vector"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        vector = sum(np.frombuffer(x, np.float64) for x in table.column("vector").to_pylist())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "vector": pa.array([vector.tobytes()], pa.binary())})

    once = source.mapInArrow(bundle, "lang string, vector binary").withColumn("salt", F.spark_partition_id() % 64)
    some = once.groupBy("lang", "salt").applyInArrow(lambda key, table: add(key, table), "lang string, vector binary")
    rows = some.groupBy("lang").applyInArrow(lambda key, table: add(key, table), "lang string, vector binary").collect()
    return {r.lang: np.frombuffer(r.vector, np.float64) for r in rows}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The id columns, lang_pred and score (cosine with the nearest prototype, 0 at least) of every text; the new ones get
    further underscores where an id has the name. A very long text is one row's concern."""
    apart = set_apart(docs, id_cols, text_col, ("lang_pred", "score", "text"), lambda d, ids, text: predict(d, prototypes, ids, text))
    if apart is not None:
        return apart
    names = sorted(prototypes)
    blocks = [(names[a : a + BLOCK], np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names[a : a + BLOCK]], np.float32)) for a in range(0, len(names), BLOCK)]
    source = docs.select(*id_cols, F.col(text_col).alias("text"))

    def nearest(parts):
        for batch in parts:
            for rows, texts in _texts(batch):
                found, has = profiles([t or "" for t in texts], np.arange(len(texts)), len(texts))
                length = np.maximum(np.linalg.norm(found, axis=1), 1e-12)
                score, lang = np.full(len(texts), -np.inf), np.full(len(texts), "und", object)
                for some, table in blocks:
                    cosine = (found @ table.T) / length[:, None]
                    best = cosine.argmax(1)
                    most = cosine[np.arange(len(texts)), best]
                    better = has & (most > score)
                    score[better], lang[better] = most[better], np.array(some, object)[best[better]]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in id_cols), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[*id_cols, "lang_pred", "score"])

    fields = source.select(*id_cols).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(nearest, fields)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text is 2 modulo 4."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2
