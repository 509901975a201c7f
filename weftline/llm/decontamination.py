"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard (about SHARD_BYTES of text) stores its sorted terms and, for each, the
sorted positions of its postings, so that building it moves no posting over the network and no term, however common,
meets in one task. A search sends the test set to the shards in blocks of a fixed size; a shard takes each test window
from its rarest term (by the shard's own posting counts) and intersects the offset-adjusted posting lists of the others
in order of rarity.

Defined results: null and empty texts have no words and no matches; a test item with fewer words than a window is one
window; repeated documents are judged row by row, repeated item ids count once; items of null ids are searched like
others, but not listed; very long texts are shards of their own; an empty table gives an empty result; other columns of
the inputs are not read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import words as W
from weftline.llm.scratch import cut, files_for

SHARD_BYTES = 6_000_000
#: Text of a block of test items: what is sent to every shard at once never exceeds this (or one item).
BLOCK_BYTES = 4_000_000
MOST_CANDIDATES = 500_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard: its documents and their word counts, terms, and the postings of all words of all texts."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("shard", T.StringType()),
            T.StructField("ids", T.ArrayType(source.schema["id"].dataType)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("term_starts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
        ]
    )

    def index(parts):
        from pyspark import TaskContext

        shard = 0
        for batch in parts:
            for at, to in W.batches(batch.column("text"), SHARD_BYTES):
                rows = batch.slice(at, to - at)
                w = W.words_of(rows.column("text"), "letters")
                order = np.argsort(w.hashes, kind="stable")
                ordered = w.hashes[order]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                ids = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), rows.column("id"))
                binary = [x.tobytes() for x in (np.diff(w.first).astype(np.uint32), ordered[heads], heads.astype(np.uint32), order.astype(np.uint32))]
                shard += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{shard}"]), ids, *(pa.array([x], pa.binary()) for x in binary)], names=schema.names)

    return source.mapInArrow(index, schema)


class TestSet:
    """Windows of a bounded block of test items, as places in their sorted vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.ids: list[str | None] = sorted({k for k, _ in items}, key=lambda k: (k is None, k or ""))
        place = {k: i for i, k in enumerate(self.ids)}
        w = W.words_of(pa.array([t for _, t in items], pa.string()), "letters")
        self.terms, word = np.unique(w.hashes, return_inverse=True)
        rows, of, lengths = [], [], []
        for i, (key, _) in enumerate(items):
            own = word[w.first[i] : w.first[i + 1]]
            n = min(size, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                rows.append(np.pad(own[at : at + n], (0, size - n), constant_values=-1))
                of.append(place[key])
                lengths.append(n)
        self.windows = np.array(rows, np.int64).reshape(-1, size)
        self.item, self.length = np.array(of, np.int64), np.array(lengths, np.int64)
        both, keep = np.unique(np.column_stack([self.item, self.windows]), axis=0, return_index=True)
        self.windows, self.item, self.length = self.windows[keep], self.item[keep], self.length[keep]


def _intersect(tests: TestSet, terms, term_starts, positions, doc_of, slop: int):
    """Exact matches (window, start) of a shard, then proximity matches (window, document)."""
    bounds = np.append(term_starts.astype(np.int64), len(positions))
    at = np.searchsorted(terms, tests.terms)
    there = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == tests.terms)
    df = np.where(there, bounds[np.minimum(at, len(terms) - 1) + 1] - bounds[np.minimum(at, len(terms) - 1)], 0)
    pad = tests.windows < 0
    wdf = np.where(pad, np.iinfo(np.int64).max, df[tests.windows])
    alive = np.flatnonzero((wdf > 0).all(1))
    if not len(alive):
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    used = np.unique(tests.windows[alive][~pad[alive]])
    local = np.full(len(tests.terms), -1, np.int64)
    local[used] = np.arange(len(used))
    sizes = df[used]
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.arange(first[-1]) - np.repeat(first[:-1], sizes) + np.repeat(bounds[at[used]], sizes)
    places = positions[flat].astype(np.int64)
    keys = (np.repeat(np.arange(len(used)), sizes) << 32) | places  # sorted: by term, then by position
    order = np.argsort(wdf[alive], axis=1, kind="stable")
    total = np.cumsum(wdf[alive, order[:, 0]])
    exact, near = [], []
    slices = np.split(np.arange(len(alive)), np.searchsorted(total, np.arange(MOST_CANDIDATES, total[-1], MOST_CANDIDATES)))
    for part in slices:
        if not len(part):
            continue
        win, rank = alive[part], order[part]
        rare = local[tests.windows[win, rank[:, 0]]]
        n = sizes[rare]
        who = np.repeat(np.arange(len(part)), n)
        anchor = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rare], n)]
        start = anchor - rank[who, 0]
        some, begin = who, start
        for k in range(1, tests.windows.shape[1]):
            offset = rank[some, k]
            term = tests.windows[win[some], offset]
            want = (local[np.maximum(term, 0)] << 32) | np.maximum(begin + offset, 0)
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = (term < 0) | ((keys[i] == want) & (begin >= 0))
            some, begin = some[ok], begin[ok]
        last = begin + tests.length[win[some]] - 1
        ok = (begin >= 0) & (last < len(doc_of))
        some, begin, last = some[ok], begin[ok], last[ok]
        ok = doc_of[begin] == doc_of[last]
        exact.append(np.column_stack([win[some[ok]], begin[ok]]))
        # Proximity: every distinct term within length + slop words of the rarest one, in the same document.
        span = tests.length[win[who]] + slop
        for k in range(1, tests.windows.shape[1]):
            term = tests.windows[win[who], rank[who, k]]
            base = local[np.maximum(term, 0)] << 32
            left = np.searchsorted(keys, base | np.maximum(anchor - span + 1, 0))
            i = np.minimum(left, len(keys) - 1)
            ok = (term < 0) | ((keys[i] >= base) & (keys[i] <= (base | (anchor + span - 1))))
            who, anchor, span = who[ok], anchor[ok], span[ok]
        found = {(int(a), int(doc_of[b])) for a, b in exact[-1]}
        for j, p, size in zip(who.tolist(), anchor.tolist(), span.tolist(), strict=True):
            w, doc = int(win[j]), int(doc_of[p])
            if (w, doc) in found:
                continue
            seen = []
            for t in {int(x) for x in tests.windows[w] if x >= 0}:
                base = int(local[t]) << 32
                a, b = np.searchsorted(keys, [base | max(p - size + 1, 0), (base | (p + size - 1)) + 1])
                seen += [(x, t) for x in (keys[a:b] & 0xFFFFFFFF).tolist() if doc_of[x] == doc]
            seen.sort()
            if _spans(seen, len({t for _, t in seen}), len({int(x) for x in tests.windows[w] if x >= 0}), size):
                found.add((w, doc))
                near.append((w, doc))
    return np.concatenate(exact), np.array(near, np.int64).reshape(-1, 2)


def _spans(seen: list[tuple[int, int]], there: int, wanted: int, size: int) -> bool:
    """Whether wanted distinct terms occur within size consecutive places."""
    if there < wanted:
        return False
    count, kinds, left = {}, 0, 0
    for x, t in seen:
        count[t] = count.get(t, 0) + 1
        kinds += count[t] == 1
        while x - seen[left][0] >= size:
            count[seen[left][1]] -= 1
            kinds -= count[seen[left][1]] == 0
            left += 1
        if kinds == wanted:
            return True
    return False


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = 10, slop: int = 5) -> DataFrame:
    """Per document: id, n_words, runs of hit words (start, end), ids of items matched exactly and, apart from those, nearly.

    A near match has every term of a window within size + slop consecutive words of one document. Test items come to
    the driver in blocks of BLOCK_BYTES; each block is matched against all shards and the blocks' results are merged.
    """
    spark = index.sparkSession
    source = items.select(F.col(item_id).cast("string").alias("k"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = T.StructType(
        [
            T.StructField("shard", T.StringType()),
            T.StructField("row", T.IntegerType()),
            T.StructField("id", index.schema["ids"].dataType.elementType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("near_items", T.ArrayType(T.StringType())),
        ]
    )

    def block(b: int) -> DataFrame:
        rows = [(r.k, r.t) for r in source.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).toLocalIterator()]
        sent = spark.sparkContext.broadcast(TestSet(rows, size))

        def match(parts):
            tests = sent.value
            for batch in parts:
                for r in range(batch.num_rows):
                    got = {n: np.frombuffer(batch.column(n)[r].as_buffer(), kind) for n, kind in (("lengths", np.uint32), ("terms", np.uint64), ("term_starts", np.uint32), ("positions", np.uint32))}
                    lengths, ids = got["lengths"].astype(np.int64), batch.column("ids")[r].values
                    ends = np.cumsum(lengths)
                    doc_of = np.repeat(np.arange(len(lengths)), lengths)
                    if len(tests.windows) and len(doc_of):
                        exact, near = _intersect(tests, got["terms"], got["term_starts"], got["positions"], doc_of, slop)
                    else:
                        exact = near = np.zeros((0, 2), np.int64)
                    edge = np.zeros(len(doc_of) + 1, np.int64)
                    np.add.at(edge, exact[:, 1], 1)
                    np.add.at(edge, exact[:, 1] + tests.length[exact[:, 0]], -1)
                    hit = np.cumsum(edge) > 0
                    marks: list[tuple[list, set, set]] = [([], set(), set()) for _ in lengths]
                    if len(exact):
                        on = np.flatnonzero(hit)
                        cut_at = np.flatnonzero((np.diff(on) > 1) | (np.diff(doc_of[on]) != 0)) + 1
                        for run in np.split(on, cut_at):
                            d = int(doc_of[run[0]])
                            marks[d][0].append([int(run[0] - ends[d] + lengths[d]), int(run[-1] + 1 - ends[d] + lengths[d])])
                        for w, d in set(zip(tests.item[exact[:, 0]].tolist(), doc_of[exact[:, 1]].tolist(), strict=True)):
                            marks[d][1].add(tests.ids[w])
                    for w, d in near.tolist():
                        marks[d][2].add(tests.ids[int(tests.item[w])])
                    W.release()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("shard")[r].as_py()] * len(lengths), pa.string()),
                            pa.array(np.arange(len(lengths)), pa.int32()),
                            ids,
                            pa.array(lengths, pa.int64()),
                            pa.array([m[0] for m in marks], pa.list_(pa.list_(pa.int64()))),
                            pa.array([sorted(m[1] - {None}) for m in marks], pa.list_(pa.string())),
                            pa.array([sorted(m[2] - m[1] - {None}) for m in marks], pa.list_(pa.string())),
                        ],
                        names=out.names,
                    )

        return index.mapInArrow(match, out)

    found = block(0)
    if blocks > 1:
        for b in range(1, blocks):
            found = found.unionByName(block(b))
        gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("shard", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), gather("runs").alias("runs"), gather("items").alias("items"), gather("near_items").alias("near_items"))
        found = found.withColumn("near_items", F.array_except("near_items", "items"))
    # Runs of several blocks may overlap: n_hit sums what each run, in order of start, adds beyond the furthest end so far.
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], a["end"]))).alias("n"), F.greatest(a["end"], r[1]).alias("end"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return found.select("id", "n_words", F.aggregate("runs", start, step, lambda a: a["n"]).alias("n_hit"), "runs", "items", "near_items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, slop: int = 5) -> DataFrame:
    """build_index() stored in the shared folder, then search()."""
    return search(cut(build_index(docs, id_col, text_col), files_for(docs)), items, size=size, slop=slop)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns, judged row by row whatever their ids.

    What the index knows a row by is the MD5 of its text, as rows of equal texts have equal verdicts.
    """
    own = "w_digest"
    while own in docs.columns:
        own += "_"
    marked = docs.withColumn(own, F.md5(F.col(text_col)))
    hit = decontaminate(marked, items, own, text_col, size).where("n_hit > 0").select(F.col("id").alias("w_hit")).distinct()
    return marked.join(hit, marked[own] == hit["w_hit"], "left_anti").drop(own)
