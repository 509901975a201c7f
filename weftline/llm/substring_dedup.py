"""Substring deduplication with fixed-block anchors.

Every document's non-overlapping blocks of `block` words are indexed and probed with every rolling window of `block`
words; with block = size / 2 every window of `size` words holds a whole block of its own document, so both occurrences
of a repeated window are hit. Hits are then extended: the windows around them are compared by their full hashes over all
documents, and consecutive repeated windows join to maximal exact repeats, of which the first occurrence stays.

Documents are dealt into chunks of about CHUNK_BYTES by a hash of their id (those without one, by their text). A chunk sends each distinct hash once, in
sorted byte planes (three to four bytes each after Spark's compression), so a passage that a third of the documents
share costs one entry a chunk, and gets back one bit for each. No pair is ever made and no text is moved twice: the
three passes over the text reuse one exchange.

Defined results: ids are integers; rows of null ids come after all others, and each is a document of its own that is
not compared with the others of them; null and empty texts have no words; rows that repeat an id are
occurrences at the same place, and a window is removed only for an earlier place, so exact repeats of a row keep the
same words; an empty table gives an empty result; other columns are not read. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.exchange import packed, planes, slices, table_of, unbits, unplaned

CHUNK_BYTES = 4_000_000
PART_BYTES = 8_000_000
_LAST = np.iinfo(np.int64).max
_ENTRY = "p int, chunk int, n int, hashes binary, more binary, hits binary"
_BITS = "chunk int, p int, n int, bits binary, hits binary"


class _Chunk:
    """Words of a chunk and its distinct rolling blocks."""

    def __init__(self, table: pa.Table, block: int):
        self.ids = table.column("id").combine_chunks().fill_null(_LAST).to_numpy()
        self.words = w = W.words_of(table.column("text"), "spaced")
        self.place = np.arange(len(w.hashes)) - w.first[w.rows] if len(w.rows) else np.zeros(0, np.int64)
        rolling = W.windows(w.hashes, block)
        self.starts = np.flatnonzero(W.whole(w.rows, block))
        self.blocks, self.inverse, self.counts = np.unique(rolling[self.starts], return_inverse=True, return_counts=True)

    def candidates(self, hit: np.ndarray, block: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold a hit block, and their hashes."""
        w, n = self.words, len(self.words.hashes)
        near = np.zeros(n, bool)
        at = self.starts[hit[self.inverse]]
        if len(at) and n >= size:
            near = W.covered(np.maximum(at - (size - block), w.first[w.rows[at]]), at + 1, n)  # not beyond the row: chunks may be dealt in another order
            fits = np.zeros(n, bool)
            fits[: n - size + 1] = W.whole(w.rows, size)
            near &= fits
        starts = np.flatnonzero(near)
        return starts, W.windows(w.hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """Per document: id, n_words, n_removed, kept (its kept words joined by one space) and removed (runs of words)."""
    if size % 2:
        raise ValueError("size must be even: it is two blocks")
    block = size // 2
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // PART_BYTES))
    dealt = source.select(F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(chunks)).cast("int").alias("chunk"), "id", "text").repartition(chunks, "chunk")

    def lean(f):
        """f, whose memory is given back after each group."""

        def call(*tables: pa.Table) -> pa.Table:
            try:
                return f(*tables)
            finally:
                W.release()

        return (lambda a: call(a)) if f in (probe, meet, own) else (lambda a, b: call(a, b))

    def probe(table: pa.Table) -> pa.Table:
        c = _Chunk(table, block)
        indexed = np.zeros(len(c.blocks), bool)
        indexed[c.inverse[c.place[c.starts] % block == 0]] = True
        chunk, at, rows = table.column("chunk")[0].as_py(), slices(c.blocks, parts), []
        for p in np.flatnonzero(np.diff(at)).tolist():
            own = slice(at[p], at[p + 1])
            rows.append((p, chunk, int(at[p + 1] - at[p]), planes(c.blocks[own] >> np.uint64(16), 6), packed(indexed[own]) + packed(c.counts[own] > 1), None))
        return table_of(rows, _ENTRY)

    def meet(table: pa.Table) -> pa.Table:
        """Blocks that are indexed and occur twice: a bit for every distinct block of every chunk."""
        rows = table.select(["chunk", "p", "n", "hashes", "more"]).to_pylist()
        value = np.concatenate([unplaned(r["hashes"], 6) for r in rows])
        flags = [unbits(r["more"], 8 * len(r["more"])).reshape(2, -1)[:, : r["n"]] for r in rows]
        indexed, several = (np.concatenate([f[k] for f in flags]) for k in (0, 1))
        order = np.argsort(value, kind="stable")
        group = np.cumsum(np.concatenate([[False], value[order][1:] != value[order][:-1]]))
        hit = (np.bincount(group, 1 + several[order]) > 1) & (np.bincount(group, indexed[order]) > 0)
        bits = np.empty(len(value), bool)
        bits[order] = hit[group]
        ends = np.cumsum([r["n"] for r in rows])
        return table_of([(r["chunk"], r["p"], r["n"], packed(bits[e - r["n"] : e]), None) for r, e in zip(rows, ends.tolist(), strict=True)], _BITS)

    def answers(table: pa.Table, column: str, n: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        for r in table.select(["p", "n", column]).to_pylist():
            if r["n"]:
                out[at[r["p"]] : at[r["p"] + 1]] = unbits(r[column], r["n"])
        return out

    def extend(texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(texts):
            return table_of([], _ENTRY)
        c = _Chunk(texts, block)
        hit = answers(hits, "bits", len(c.blocks), slices(c.blocks, parts))
        starts, hashes = c.candidates(hit, block, size)
        chunk, known = texts.column("chunk")[0].as_py(), packed(hit)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        first = np.full(len(distinct), _LAST, np.int64)
        np.minimum.at(first, inverse, c.ids[c.words.rows[starts]])
        at, rows = slices(distinct, parts), [(chunk % parts, chunk, 0, b"", b"", known)]
        for p in np.flatnonzero(np.diff(at)).tolist():
            own = slice(at[p], at[p + 1])
            rows.append((p, chunk, int(at[p + 1] - at[p]), planes(distinct[own], 8), planes(first[own].view(np.uint64), 8), None))
        return table_of(rows, _ENTRY)

    def own(table: pa.Table) -> pa.Table:
        """A bit for every distinct window of every chunk: whether a smaller id in another chunk has it."""
        rows = table.to_pylist()
        value = np.concatenate([unplaned(r["hashes"], 8) for r in rows])
        ids = np.concatenate([unplaned(r["more"], 8) for r in rows]).view(np.int64)
        bits = np.zeros(len(value), bool)
        if len(value):
            order = np.argsort(value, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
            least = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(value))))
            bits[order] = ids[order] > least
        ends = np.cumsum([r["n"] for r in rows])
        return table_of([(r["chunk"], r["p"], r["n"], packed(bits[e - r["n"] : e]), r["hits"]) for r, e in zip(rows, ends.tolist(), strict=True)], _BITS)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"id": [], "n_words": [], "n_removed": [], "kept": [], "removed": []}, schema=out)
        c = _Chunk(texts, block)
        known = next(h for h in found.column("hits").to_pylist() if h is not None)
        starts, hashes = c.candidates(unbits(known, len(c.blocks)), block, size)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        elsewhere = answers(found, "bits", len(distinct), slices(distinct, parts))
        w, n = c.words, len(c.words.hashes)
        nameless = np.where(c.ids == _LAST, np.arange(len(c.ids)), -1)[w.rows[starts]]  # rows of null ids are documents of their own
        order = np.lexsort((c.place[starts], nameless, c.ids[w.rows[starts]], inverse))
        ids, places, group, nameless = c.ids[w.rows[starts]][order], c.place[starts][order], inverse[order], nameless[order]
        begins = lambda new: np.repeat(h := np.flatnonzero(new), np.diff(np.append(h, len(new))))
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        run = begins(new)
        new[1:] |= nameless[1:] != nameless[:-1]
        own_run = np.where(ids[run] == _LAST, begins(new), run)
        later = (ids != ids[run]) | (places != places[own_run]) | elsewhere[group]
        gone = W.covered(starts[order[later]], starts[order[later]] + size, n)
        return _cut(texts, c, gone)

    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))])
    entries = dealt.groupBy("chunk").applyInArrow(lean(probe), _ENTRY)
    hits = entries.groupBy("p").applyInArrow(lean(meet), _BITS)
    windows = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lean(extend), _ENTRY)
    found = windows.groupBy("p").applyInArrow(lean(own), _BITS)
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lean(finish), "id long, n_words long, n_removed long, kept string, removed array<array<bigint>>")


def _cut(texts: pa.Table, c: _Chunk, gone: np.ndarray) -> pa.Table:
    """The kept words of every row, cut out of the bytes at once."""
    w = c.words
    docs = len(texts)
    stay = np.flatnonzero(~gone)
    body = np.append(w.data, np.uint8(0x20))
    edge = np.zeros(len(body) + 1, np.int8)
    edge[w.starts[stay]] = 1
    edge[w.ends[stay]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    between = stay[:-1][w.rows[stay[:-1]] == w.rows[stay[1:]]]
    keep[w.ends[between]] = True
    body[w.ends[between]] = 0x20
    _, offsets = W.raw(texts.column("text"))
    lengths = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[offsets]
    kept = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(body[keep].tobytes())).cast(pa.string())
    words = np.diff(w.first)
    removed = np.bincount(w.rows, gone, docs).astype(np.int64) if len(w.rows) else np.zeros(docs, np.int64)
    runs: list[list] = [[] for _ in range(docs)]
    on = np.flatnonzero(gone)
    if len(on):
        cuts = np.flatnonzero((np.diff(on) > 1) | (np.diff(w.rows[on]) != 0))
        begins, ends = on[np.append(0, cuts + 1)], on[np.append(cuts, len(on) - 1)]
        for row, a, b in zip(w.rows[begins].tolist(), c.place[begins].tolist(), c.place[ends].tolist(), strict=True):
            runs[row].append([a, b + 1])
    return pa.table([texts.column("id").combine_chunks(), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), kept, pa.array(runs, pa.list_(pa.list_(pa.int64())))], names=["id", "n_words", "n_removed", "kept", "removed"])
