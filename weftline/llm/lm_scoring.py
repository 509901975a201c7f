"""Cross-entropy difference with matched bigram models.

A target model (of chosen documents) and a background model (of all others) have the same order, smoothing and
vocabulary, every word of either. A word's loss is -ln((c(v, w) + k) / (c(v) + k V)) after the word v before it (or the
start of the document), V being the size of the vocabulary. A document's score is the mean over its words of target loss
less background loss: the lower, the more it is like the target. A document's own counts are left out of its own model,
so that documents which a model was trained on are scored as if they were new.

Documents are dealt into chunks by a hash of their id (those without one, by their text). Each chunk sends each distinct word and bigram once, with its
counts in both corpora, in sorted byte planes to a range of hashes; the range adds up and answers with the totals in the
chunk's own order. So a word that every document has costs one entry a chunk, no document's n-grams are shuffled, and
the text moves once (the second pass reuses the exchange).

Words are lower-cased [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, compared by 64-bit hashes. Defined results: ids are integers;
rows of null ids are scored like others and are never targets; a null or empty text has no words, n_tokens 0 and null losses; rows that repeat an id are documents of their own (each
leaves out its own counts only); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import words as W
from weftline.llm.exchange import planes, slices, table_of, unplaned

CHUNK_BYTES = 4_000_000
PART_BYTES = 8_000_000
_START = np.uint64(0x5851F42D4C957F2D)
_ENTRY = "p int, chunk int, kind int, n int, hashes binary, target binary, other binary"
_TOTALS = "chunk int, kind int, p int, n int, target binary, other binary"


def _pairs(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before each word (or of the start) and of the bigram."""
    before = np.empty(len(hashes), np.uint64)
    before[:1] = _START
    before[1:] = np.where(rows[1:] == rows[:-1], hashes[:-1], _START)
    return before, W._mix(before * np.uint64(0x9E3779B97F4A7C15) ^ hashes)


class _Chunk:
    """Distinct contexts (kind 0) and bigrams (kind 1) of a chunk's documents; rows without a text name targets."""

    def __init__(self, table: pa.Table):
        chosen = table.column("target").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").combine_chunks()
        targets = set(ids.filter(pa.array(chosen)).to_pylist())
        keep = pa.array(~chosen)
        self.ids = ids.filter(keep)
        self.is_target = np.array([i in targets for i in self.ids.to_pylist()], bool)
        self.words = w = W.words_of(table.column("text").combine_chunks().filter(keep), "letters")
        self.kinds = []
        own = self.is_target[w.rows]
        for hashes in _pairs(w.hashes, w.rows):
            distinct, at = np.unique(hashes, return_inverse=True)
            self.kinds.append((distinct, at, np.bincount(at[own], minlength=len(distinct)), np.bincount(at[~own], minlength=len(distinct))))

    def in_document(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each word's context or bigram occurs in its own document."""
        key = self.words.rows * np.int64(max(n, 1)) + at
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[place]


def vocabulary_size(source: DataFrame, parts: int) -> int:
    """Distinct words of all texts."""

    def distinct(batches):
        for batch in batches:
            for a, b in W.batches(batch.column("text"), CHUNK_BYTES):
                found = np.unique(W.words_of(batch.column("text").slice(a, b - a), "letters").hashes)
                at = slices(found, parts)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([planes(found[at[p] : at[p + 1]], 8) for p in full], pa.binary())], names=["p", "hashes"])

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([len(np.unique(np.concatenate([unplaned(x, 8) for x in table.column("hashes").to_pylist()])))], pa.int64())})

    return source.select("text").mapInArrow(distinct, "p int, hashes binary").groupBy("p").applyInArrow(lambda t: count(t), "n long").agg(F.sum("n")).first()[0] or 0


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: float = 0.1) -> DataFrame:
    """Per document: id, is_target, n_tokens, target_loss, background_loss (means in nats) and score, their difference.

    targets has the target documents' ids in its first column.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("target"))
    named = targets.select(F.col(targets.columns[0]).cast("long").alias("id")).where("id is not null").distinct().select("id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("target"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // PART_BYTES))
    size = max(1, vocabulary_size(source, parts))
    dealt = source.unionByName(named).select(F.pmod(F.coalesce(F.when(F.col("id").isNull(), F.xxhash64("text")), F.xxhash64("id")), F.lit(chunks)).cast("int").alias("chunk"), "id", "text", "target").repartition(chunks, "chunk")

    def tell(table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        chunk, rows = table.column("chunk")[0].as_py(), []
        for kind, (distinct, _, target, other) in enumerate(c.kinds):
            at = slices(distinct, parts)
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[p], at[p + 1])
                rows.append((p, chunk, kind, int(at[p + 1] - at[p]), planes(distinct[own], 8), planes(target[own], 4), planes(other[own], 4)))
        W.release()
        return table_of(rows, _ENTRY)

    def add(table: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            rows = [r for r in table.to_pylist() if r["kind"] == kind]
            if not rows:
                continue
            value = np.concatenate([unplaned(r["hashes"], 8) for r in rows])
            _, at = np.unique(value, return_inverse=True)
            both = []
            for column in ("target", "other"):
                n = np.concatenate([unplaned(r[column], 4) for r in rows]).astype(np.int64)
                both.append(np.bincount(at, n)[at].astype(np.uint64))
            ends = np.cumsum([r["n"] for r in rows]).tolist()
            out += [(r["chunk"], kind, r["p"], r["n"], *(planes(b[e - r["n"] : e], 6) for b in both)) for r, e in zip(rows, ends, strict=True)]
        W.release()
        return table_of(out, _TOTALS)

    def judge(table: pa.Table, totals: pa.Table) -> pa.Table:
        c = _Chunk(table)
        answers = totals.to_pylist()
        w, docs_here = c.words, len(c.ids)
        own = c.is_target[w.rows]
        logs = {"target": np.zeros(len(w.hashes)), "other": np.zeros(len(w.hashes))}
        for kind, (distinct, at, _, _) in enumerate(c.kinds):
            border = slices(distinct, parts)
            inside = c.in_document(at, len(distinct))
            for column, mine in (("target", own), ("other", ~own)):
                n = np.zeros(len(distinct))
                for r in answers:
                    if r["kind"] == kind:
                        n[border[r["p"]] : border[r["p"] + 1]] = unplaned(r[column], 6)
                seen = n[at] - np.where(mine, inside, 0)
                logs[column] += np.log(seen + k * size) if kind == 0 else -np.log(seen + k)
        counts = np.diff(w.first)
        loss = {name: np.bincount(w.rows, x, docs_here) / np.maximum(counts, 1) for name, x in logs.items()}
        blank = counts == 0
        W.release()
        return pa.table(
            {
                "id": c.ids,
                "is_target": pa.array(c.is_target),
                "n_tokens": pa.array(counts, pa.int64()),
                "target_loss": pa.array(loss["target"], mask=blank),
                "background_loss": pa.array(loss["other"], mask=blank),
                "score": pa.array(loss["target"] - loss["other"], mask=blank),
            }
        )

    sums = dealt.groupBy("chunk").applyInArrow(lambda t: tell(t), _ENTRY).groupBy("p").applyInArrow(lambda t: add(t), _TOTALS)
    return dealt.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(lambda a, b: judge(a, b), "id long, is_target boolean, n_tokens long, target_loss double, background_loss double, score double")
