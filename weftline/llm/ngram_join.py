"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its five-word shingles (words as lower-cased [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; of one to four
words, all of them are one shingle). Documents with equal sets form one class and go on as one row. MinHash values of
the classes meet in bands; in a bucket, pairs are compared some values at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior, falls
below the tolerance. What is left is verified exactly.

Pairs never become rows. Buckets beyond BLOCK classes are cut into blocks, and every two blocks are one task's group, so
a bucket that holds a third of all rows is spread over many tasks. A pair counts in the first band it shares only.
Groups report their classes' link counts and a tree of links, and connected components give the class ids.

Defined results: rows of null ids, and of texts without words, are no one's copies and have no links; rows that repeat
an id and text are copies of each other; of ties the smallest id stands for its class; rows that share an id but not a
text are judged by their texts, so classes that are not linked stay apart even if their least ids are equal; an empty
table gives an empty result; a very long text is one row's set, held by one task; other columns are not read. Sets are compared by 64-bit shingle hashes. With 32 bands of four values a pair of
similarity 0.8 is missed as a candidate with probability 5e-8.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.scratch import cut, files_for, free, plain

SHINGLE = 5
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
STEP = 16
BLOCK = 256
#: Pairs of a group from which on it is cheaper to look for earlier meetings first; results are the same.
MANY = 4096
PIECE = 1_000_000
_MULTIPLIERS = W._mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row, concatenated, and the rows' borders in them."""
    w = W.words_of(column, "letters")
    n = len(w.first) - 1
    counts = np.diff(w.first)
    value = W.windows(w.hashes, SHINGLE)
    at = np.flatnonzero(W.whole(w.rows, SHINGLE))
    value, rows = value[at], w.rows[at]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = np.array([int.from_bytes(hashlib.blake2b(w.hashes[w.first[r] : w.first[r + 1]].tobytes(), digest_size=8).digest(), "little") for r in short], np.uint64)
        value, rows = np.concatenate([value, own]), np.concatenate([rows, short])
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[fresh], rows[fresh]
    return value, np.searchsorted(rows, np.arange(n + 1))


def minhashes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of every non-empty set; rows of empty sets are zeros."""
    out = np.zeros((len(first) - 1, VALUES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    for k in range(VALUES if len(full) else 0):
        out[full, k] = np.minimum.reduceat(((value * _MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32), first[full])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of every row."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            key = W._mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        out[:, b] = key
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the least matches with which P(similarity >= threshold) is not below the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out[n] = m
                break
    return out


def _pairs(sig: np.ndarray, block: np.ndarray, first: int, second: int, band: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that meet in no earlier band and survive the incremental comparison."""
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    if first == second:
        i, j = np.triu_indices(len(a), 1)
        i, j = a[i], a[j]
    else:
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    many = len(i) > MANY
    for e in range(band if many else 0):  # in a large group of near copies nearly all pairs met before
        stay = (sig[i, e * ROWS : (e + 1) * ROWS] != sig[j, e * ROWS : (e + 1) * ROWS]).any(1)
        i, j = i[stay], j[stay]
    matches = np.zeros(len(i), np.int32)
    for n, m in least.items():
        matches += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1, dtype=np.int32)
        stay = matches >= m
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            return i, j
    if band and not many:
        met = (sig[i, : band * ROWS] == sig[j, : band * ROWS]).reshape(-1, band, ROWS).all(2).any(1)
        i, j = i[~met], j[~met]
    return i, j


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, exactly: |x & y| >= t |x | y|."""
    size = np.array([len(s) for s in sets])
    if len(i) < 8 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        used = np.unique(np.concatenate([i, j]))
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        value, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size[used])
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, len(value), 4096):
            s = slice(*np.searchsorted(column, [at, at + 4096]))
            there = np.zeros((len(used), min(4096, len(value) - at)), np.float32)
            there[row[s], column[s] - at] = 1
            common += there @ there.T
        both = common[place[i], place[j]].astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node and its component's least node, of edges (a, b): least labels spread, and labels follow their own labels.

    Sums and joins are by node; a round is written to the shared folder. Chains of labels halve every round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), files)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), files)
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        spread = labels.join(told, labels["node"] == told["n"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("n"), F.col("label").alias("far"))
        after = cut(spread.join(jump, spread["new"] == jump["n"], "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) < F.col("label")).alias("moved")), files)
        if after.where("moved").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _digest(text_col: str) -> Column:
    """Tells texts apart, null from empty, too."""
    return F.coalesce(F.md5(F.col(text_col)), F.lit(""))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per document: id, digest (of its text), key (of its shingles, null if it has none or no id), rep (least id of equal
    sets), size (their number), links (to other sets) and label (least id and key of those linked by any path, if any)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    files = files_for(source)

    def sketch(parts):
        for batch in parts:
            for at, to in W.batches(batch.column("text"), PIECE):
                rows = batch.slice(at, to - at)
                value, first = shingles(rows.column("text"))
                sig = minhashes(value, first)
                keys = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                keys = [None if i is None else k for i, k in zip(rows.column("id").to_pylist(), keys, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("digest"), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "digest", "key", "sig"])
            W.release()

    sketches = cut(source.mapInArrow(sketch, "id long, digest string, key binary, sig binary"), files)
    full = sketches.where("key is not null")
    classes = full.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    kept = cut(classes.join(full.select("key", F.col("id").alias("rep"), "sig"), ["key", "rep"]).dropDuplicates(["key"]), files)

    def banded(parts):
        for batch in parts:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
            keys = band_keys(sig)
            for at in range(0, len(sig), 512):
                n = len(sig[at : at + 512])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, n).take(pa.array(np.repeat(np.arange(n), BANDS))), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys[at : at + n].reshape(-1).view(np.int64))], names=["key", "band", "bucket"])

    entries = kept.select("key", "sig").mapInArrow(banded, "key binary, band int, bucket long")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = entries.join(buckets, "bucket").select("key", "band", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("key", "bucket"), blocks).cast("int").alias("block"))
    dealt = met.select("key", "band", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = dealt.select("key", "band", "bucket", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    least = least_matches(threshold, tolerance)
    names = ["bucket", "one", "two"]

    def survivors(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        one, two, band = (table.column(c)[0].as_py() for c in ("one", "two", "band"))
        i, j = _pairs(sig, table.column("block").to_numpy(), one, two, band, least)
        return table.select(["key", "band", "bucket", "block", "one", "two", "sig"]).take(pa.array(np.unique(np.concatenate([i, j]))))

    group = "key binary, band int, bucket long, block int, one int, two int, sig binary"
    left = cut(grouped.join(kept.select("key", "sig"), "key").groupBy(*names).applyInArrow(lambda t: survivors(t), group), files)
    wanted = left.select("key").distinct().join(kept.select("key", "rep", "size"), "key").select(F.col("key").alias("k"), "rep", "size")

    def sets(parts):
        for batch in parts:
            for at, to in W.batches(batch.column("text"), PIECE):
                value, first = shingles(batch.column("text").slice(at, to - at))
                own = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary()), pa.array(own, pa.binary())], names=["key", "shingles"])
            W.release()

    reps = wanted.select(F.col("rep").alias("id")).distinct()
    texts = source.join(reps, "id", "left_semi").select("text").mapInArrow(sets, "key binary, shingles binary")
    told = texts.join(wanted, texts["key"] == wanted["k"]).dropDuplicates(["key"]).select("key", "rep", "size", "shingles")

    def verify(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES)
        one, two, band = (table.column(c)[0].as_py() for c in ("one", "two", "band"))
        i, j = _pairs(sig, table.column("block").to_numpy(), one, two, band, least)
        own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        ok = _similar(own, i, j, threshold) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, i, size[j])
        np.add.at(n, j, size[i])
        keys = table.column("key").to_pylist()
        order = np.array(sorted(range(len(rep)), key=lambda x: (rep[x], keys[x])), np.int64)
        near = np.argsort(order)  # a link of every class to a smaller one by (rep, key), or to itself where it is least
        while True:
            before = near.copy()
            np.minimum.at(near, i, before[j])
            np.minimum.at(near, j, before[i])
            if (near == before).all():
                break
        hit = np.flatnonzero(n)
        near = order[near[hit]]
        return pa.table({"key": table.column("key").take(pa.array(hit)), "rep": pa.array(rep[hit]), "near_key": table.column("key").take(pa.array(near)), "near": pa.array(rep[near]), "n": pa.array(n[hit])})

    found = cut(left.join(told, "key").groupBy(*names).applyInArrow(lambda t: verify(t), "key binary, rep long, near_key binary, near long, n long"), files)
    links = found.groupBy("key").agg(F.sum("n").alias("links"))
    pair = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("key"))
    labels = components(found.select(pair("rep", "key").alias("a"), pair("near", "near_key").alias("b")), files).select(F.col("node.key").alias("key"), "label")
    named = classes.join(links, "key", "left").join(labels, "key", "left").select("key", "rep", "size", "links", "label")
    return sketches.select("id", "digest", "key").join(named, "key", "left").select("id", "digest", "key", "rep", "size", "links", "label")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per document: id, copy_id (least id of equal sets), class_id (least id of those linked by any path) and n_links.

    n_links counts the other documents whose similarity is at least the threshold, copies included. Where an id repeats
    with other texts, unlinked classes can have the same least id and thus class_id; linked() tells them apart.
    """
    return linked(docs, id_col, text_col, threshold, tolerance).select(
        "id",
        F.coalesce("rep", "id").alias("copy_id"),
        F.coalesce("label.id", "rep", "id").alias("class_id"),
        F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of every class of linked ones: that of the least id; if several texts of the class have this id, the
    text of the least MD5; if rows repeat an id and text, the least by their columns from left to right (maps by their JSON).

    Rows of null ids all stay, and so do texts without words, but for repeats of an id and text. All columns are kept.
    """
    found = cut(linked(docs, id_col, text_col, threshold).where("id is not null").select("id", "digest", F.coalesce("label.key", "key").alias("class"), F.coalesce("label.id", "rep", "id").alias("least")), files_for(docs))
    first = found.where("class is not null and id = least").select("class", "id", "digest").distinct()
    best = first.groupBy("class").agg(F.min("digest").alias("best"), F.count("*").alias("n")).where("n > 1").select("class", "best")
    other = first.join(best, "class").where("digest <> best").select("id", "digest")
    gone = found.where("id <> least").select("id", "digest").unionByName(other).distinct().select(F.col("id").alias("w_gone"), F.col("digest").alias("w_text"))
    own, row = free("w_digest", docs.columns), free("w_row", docs.columns)
    marked = docs.withColumn(own, _digest(text_col))
    stay = marked.join(gone, (marked[id_col].cast("long") == gone["w_gone"]) & (marked[own] == gone["w_text"]), "left_anti")
    if found.groupBy("id", "digest").count().where("count > 1").isEmpty():
        return stay.drop(own)
    whole, order = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), [plain(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    mixed = any("map<" in t or "variant" in t for _, t in docs.dtypes)
    known = stay.where(F.col(id_col).isNotNull()).groupBy(id_col, own).agg(F.min_by(whole, F.struct(*order)).alias(row) if mixed else F.min(whole).alias(row))
    return known.select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns)).unionByName(stay.where(F.col(id_col).isNull()).drop(own))
