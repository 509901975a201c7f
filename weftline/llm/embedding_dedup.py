"""Near copies among embeddings by product quantisation.

Two vectors are linked if their cosine, in double precision, is at least the threshold. Equal vectors are one row with a
size from the start. A coarse quantiser (about the square root of the rows' number of centroids, fit on a bounded sample,
none closer than APART to another) gives every vector its inverted list, and what is left of it after its centroid is
coded by one byte for each SUB dimensions, with the code's error beside it.

A list is visited by the codes of vectors that may have partners in it. If x lies m from the plane between its own
centroid and another, and its partner on the other side n from it, then m + n is at most their distance, so one of both
lies within half of r, the distance at the threshold. Visits of all lists so close are therefore sufficient, and with
certain=True nothing is missed. Otherwise, above 16 dimensions, planes within 2 r / sqrt(dimensions) are visited: a
partner in a random direction is farther beyond both planes in one of thirty thousand cases.

In a list, table look-ups give the distance from each exact vector to each visiting code; that distance less the code's
error is a lower bound, so what is dropped by it is no partner. What is left meets again with exact vectors and is judged
by its cosine. Vectors within an angle of their centroid whose sums stay below the threshold's are linked by the triangle
inequality alone: they are counted by bins of the angle, so a list of near copies costs no pairs. Lists of more than
BLOCK vectors are cut into blocks by bins, which code visitors reach one by one; blocks that are linked as a whole are
left out. Homes of a block are held by one task (three blocks at most), visitors stream past them.

Sizes: the sample has at most SAMPLE_ROWS rows in the mean and SAMPLE_BYTES; a model has CELLS centroids at most, so beyond
CELLS squared rows lists grow with the input. Links become counts and a tree of links in each list; connected components
join them.

Defined results: vectors that are null, zero, or hold null or non-finite components are no one's partners, nor are rows
of null ids; vectors of different lengths are never linked; rows that repeat an id count as vectors of their own, by
their vectors; of ties the least id stands for all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.ngram_join import components
from weftline.llm.scratch import cut, files_for

SUB = 8
CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 4096, 131_072, 64_000_000
APART = 0.3
BINS = 128
BLOCK = 2048
#: Rows of a matrix at a time.
CHUNK = 512
#: A cell's bins are sent to all tasks up to so many rows; more are joined.
SENT_ROWS = 1_000_000
_TILE = ["dim", "cell", "block"]


class Model(NamedTuple):
    """Centroids, their directions, and the codes' parts by subspace, for vectors of one length."""

    centroids: np.ndarray
    directions: np.ndarray
    parts: list[np.ndarray]


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from the first rows, which are in a random order."""
    centre = x[:k].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([(x[at : at + CHUNK] @ centre.T - half).argmax(1) for at in range(0, len(x), CHUNK)])


def fit(x: np.ndarray, cells: int) -> Model:
    """A model of unit vectors of one length, in a random order."""
    centre = _means(x, max(1, min(cells, len(x) // 8)))
    keep: list[int] = []
    for i in range(len(centre)):
        if not keep or ((centre[keep] - centre[i]) ** 2).sum(1).min() >= APART**2:
            keep.append(i)
    centre = centre[keep]
    rest = x - centre[_nearest(x, centre)]
    parts = [_means(np.ascontiguousarray(rest[:, at : at + SUB]), max(1, min(256, len(x) // 8))) for at in range(0, x.shape[1], SUB)]
    return Model(centre, _directions(centre), parts)


def _directions(centre: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(centre, axis=1)
    first = np.zeros_like(centre)
    first[:, :1] = 1
    return np.where(size[:, None] > 1e-6, centre / np.maximum(size, 1e-6)[:, None], first)


def _plain(dim: int) -> Model:
    """For lengths that the sample lacks: a list and a code for all."""
    centre = np.zeros((1, dim))
    return Model(centre, _directions(centre), [np.zeros((1, min(SUB, dim - at))) for at in range(0, dim, SUB)])


def usable(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length: vectors without nulls, of finite components, not all zero, each scaled by a power of two."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, []
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        x = flat[starts[rows][:, None] + np.arange(n)]
        peak = np.abs(x).max(1)
        good = np.isfinite(peak) & (peak > 0)
        if good.any():
            out.append((rows[good], np.ldexp(x[good], -np.frexp(peak[good])[1][:, None])))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


class _Codes(NamedTuple):
    cell: np.ndarray
    bins: np.ndarray
    code: np.ndarray
    error: np.ndarray
    shift: np.ndarray
    visits: list[np.ndarray]


def encode(x: np.ndarray, model: Model, threshold: float, certain: bool) -> _Codes:
    """Lists, bins, codes, their errors, what table look-ups lack (shift), and the lists visited, of unit vectors."""
    centre, n = model.centroids, len(x)
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    reach = far / 2 if certain else min(far / 2, 2 * far / math.sqrt(x.shape[1]))
    between = np.sqrt(np.maximum(((centre * centre).sum(1)[:, None] + (centre * centre).sum(1) - 2 * centre @ centre.T), 1e-30))
    cell, visits = np.zeros(n, np.int64), []
    for at in range(0, n, CHUNK):
        d = (centre * centre).sum(1) - 2 * x[at : at + CHUNK] @ centre.T
        own = cell[at : at + CHUNK] = d.argmin(1)
        margin = (d - d[np.arange(len(d)), own][:, None]) / (2 * between[own])
        margin[np.arange(len(d)), own] = np.inf
        visits += [np.flatnonzero(m <= reach + 1e-9) for m in margin]
    rest = x - centre[cell]
    code = np.stack([_nearest(rest[:, k * SUB : (k + 1) * SUB], part) for k, part in enumerate(model.parts)], 1)
    said = np.concatenate([part[code[:, k]] for k, part in enumerate(model.parts)], 1)
    error = np.linalg.norm(rest - said, axis=1)
    shift = 2 * (said * centre[cell]).sum(1) + (centre[cell] ** 2).sum(1)
    step = (math.acos(threshold) - 1e-6) / BINS
    angle = np.arccos(np.clip((x * model.directions[cell]).sum(1), -1, 1))
    bins = np.minimum(angle / step, BINS).astype(np.int64) if step > 0 else np.full(n, BINS)
    return _Codes(cell, bins, code.astype(np.uint8), error, shift, visits)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2)


class _Home:
    """A block's own rows."""

    def __init__(self, rows: pa.Table, threshold: float):
        self.rows, self.n = rows, rows.num_rows
        self.cell, self.block = rows.column("cell")[0].as_py(), rows.column("block")[0].as_py()
        self.keys = _keys(rows.column("key"))
        self.bins = rows.column("bin").to_numpy()
        raw = rows.column("vec").to_pylist()
        self.x = np.frombuffer(b"".join(raw), np.float64).reshape(self.n, -1)
        lists = rows.column("visits").to_pylist()
        self.visits = np.zeros((self.n, 1 + max((max(v, default=0) for v in lists), default=0)), bool)
        for i, v in enumerate(lists):
            self.visits[i, v] = True
        self.threshold = threshold

    def due(self, guests: pa.RecordBatch) -> np.ndarray:
        """Which pairs (own row, guest) are judged here, not elsewhere, and not by their angles."""
        cell, bins, keys = guests.column("own").to_numpy(), guests.column("bin").to_numpy(), _keys(guests.column("key"))
        same = cell == self.cell
        back = (cell < self.cell) & (cell < self.visits.shape[1])
        out = np.ones((self.n, len(cell)), bool)
        out[:, back] = ~self.visits[:, cell[back]]
        sure = self.bins[:, None] + bins + 2 <= BINS
        first, second = (self.keys[:, i][:, None] for i in (0, 1))
        less = (first < keys[:, 0]) | (first == keys[:, 0]) & (second < keys[:, 1])
        inside = same & (guests.column("from").to_numpy() == self.block)
        return out & ~(sure & same) & (less | ~inside)


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[_Home, Iterator[pa.RecordBatch]]]:
    """(homes, guests of it in chunks) of a stream in which each block's homes come before its guests."""
    homes: list[pa.RecordBatch] = []
    at, home = None, None
    for batch in batches:
        rows = batch.num_rows
        tile = [batch.column(c).to_numpy() for c in (*_TILE, "guest")]
        turn = np.flatnonzero(np.any([t[1:] != t[:-1] for t in tile], axis=0)) + 1 if rows else []
        for a, b in zip([0, *turn], [*turn, rows], strict=True) if rows else []:
            here = tuple(int(t[a]) for t in tile[:3])
            if here != at:
                if home or homes:
                    yield home or _Home(pa.Table.from_batches(homes), threshold), None
                at, home, homes = here, None, []
            if not tile[3][a]:
                homes.append(batch.slice(a, b - a))
                continue
            if home is None:
                home, homes = _Home(pa.Table.from_batches(homes), threshold), []
            for i in range(a, b, CHUNK):
                yield home, batch.slice(i, min(CHUNK, b - i))
    if home or homes:
        yield home or _Home(pa.Table.from_batches(homes), threshold), None


def _looked_up(home: _Home, model: Model, guests: pa.RecordBatch) -> np.ndarray:
    """Lower bounds of the distances from homes to guests."""
    code = np.frombuffer(b"".join(guests.column("code").to_pylist()), np.uint8).reshape(len(guests), -1)
    total = guests.column("shift").to_numpy() - 2 * home.to_centroids[:, guests.column("own").to_numpy()]
    for k, table in enumerate(home.tables):
        total += table[:, code[:, k]]
    return np.sqrt(np.maximum(total, 0)) - guests.column("error").to_numpy()


def _prepare(home: _Home, model: Model) -> None:
    x = unit(home.x)
    home.to_centroids = x @ model.centroids.T
    home.tables = [(x[:, k * SUB : (k + 1) * SUB] ** 2).sum(1)[:, None] + (part * part).sum(1) - 2 * x[:, k * SUB : (k + 1) * SUB] @ part.T for k, part in enumerate(model.parts)]


_ENTRY = "dim int, cell int, block int, guest int, key binary, own int, `from` int, bin int"


def links(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, certain: bool = False) -> DataFrame:
    """Per row: id, n_links (other vectors linked with it), component (least id reachable by links) and kept (whether it is
    the least)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    files = files_for(source)
    models = _models(source)

    def key_of(x: np.ndarray) -> list[bytes]:
        return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]

    def name(batches):
        for batch in batches:
            ids, keys = batch.column("id").to_pylist(), [None] * batch.num_rows
            for rows, x in usable(batch.column("vec")):
                for i, k in zip(rows.tolist(), key_of(x), strict=True):
                    keys[i] = k if ids[i] is not None else None
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], names=["id", "key"])

    def describe(batches):
        for batch in batches:
            for rows, x in usable(batch.column("vec")):
                dim = x.shape[1]
                c = encode(unit(x), models.get(dim) or _plain(dim), threshold, certain)
                ids = batch.column("id").take(pa.array(rows))
                columns = {
                    "id": ids, "key": pa.array(key_of(x), pa.binary()), "dim": pa.array(np.full(len(x), dim), pa.int32()), "cell": pa.array(c.cell, pa.int32()), "bin": pa.array(c.bins, pa.int32()),
                    "code": pa.array([r.tobytes() for r in c.code], pa.binary()), "error": pa.array(c.error), "shift": pa.array(c.shift), "visits": pa.array([v.tolist() for v in c.visits], pa.list_(pa.int32())), "vec": pa.array([r.tobytes() for r in x], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    told = source.where("id is not null").mapInArrow(describe, "id long, key binary, dim int, cell int, bin int, code binary, error double, shift double, visits array<int>, vec binary")
    rest = ("dim", "cell", "bin", "code", "error", "shift", "visits", "vec")
    coded = cut(told.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in rest)), files)

    # bins of every list, and the blocks that they make up
    node = F.struct(F.col("rep").alias("id"), "key")
    bins = cut(coded.groupBy("dim", "cell", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min(node).alias("least")))
    sums = Window.partitionBy("dim", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.floor(F.coalesce(F.sum("n").over(sums), F.lit(0)) / BLOCK).cast("int")
    parts = bins.select("dim", "cell", "bin", begun.alias("begun"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    lists = bins.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("bin", "w", "least"))).alias("bins"))
    if bins.count() <= SENT_ROWS:
        parts, lists = F.broadcast(parts), F.broadcast(lists)
    block = (F.col("begun") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int")
    placed = coded.join(parts, ["dim", "cell", "bin"]).withColumn("block", block)

    sure = F.filter("bins", lambda b: b["bin"] + F.col("bin") + 2 <= BINS)
    by_angle = F.aggregate(sure, F.lit(0).cast("long"), lambda a, b: a + b["w"]) - F.when(2 * F.col("bin") + 2 <= BINS, F.col("size")).otherwise(0)
    tight = coded.join(lists, ["dim", "cell"]).select("key", node.alias("a"), F.when(F.size(sure) > 0, F.col("bins")[0]["least"]).alias("b"), by_angle.alias("n")).where("n > 0")

    tiles = placed.groupBy(*_TILE).agg(F.max("bin").alias("most")).select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("block").alias("t"), "most")
    codes = ("code", "error", "shift")
    asked = placed.select("dim", F.col("cell").alias("own"), F.col("block").alias("from"), "key", "bin", *codes, F.explode(F.concat(F.array("cell"), "visits")).alias("list"))
    inside = (F.col("own") != F.col("list")) | (F.col("t") >= F.col("from")) & (F.col("bin") + F.col("most") + 2 > BINS)
    guests = asked.join(tiles, (F.col("dim") == F.col("d")) & (F.col("list") == F.col("c"))).where(inside).select("dim", F.col("list").alias("cell"), F.col("t").alias("block"), F.lit(1).alias("guest"), "key", "own", "from", "bin", *codes)
    homes = placed.select(*_TILE, F.lit(0).alias("guest"), "key", F.col("cell").alias("own"), F.col("block").alias("from"), "bin", "visits", "vec")
    far = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def narrow(batches):
        kept = ["dim", "cell", "block", "guest", "key", "own", "from", "bin"]
        now, hit = None, np.zeros(0, bool)
        for home, some in _tiles(batches, threshold):
            if home is not now:
                if hit.any():
                    yield from now.rows.select(kept).filter(pa.array(hit)).to_batches()
                dim = home.x.shape[1]
                model = models.get(dim) or _plain(dim)
                _prepare(home, model)
                now, hit = home, np.zeros(home.n, bool)
            if some is not None:
                near = (_looked_up(home, model, some) <= far) & home.due(some)
                hit |= near.any(1)
                if near.any():
                    yield some.select(kept).filter(pa.array(near.any(0)))
        if hit.any():
            yield from now.rows.select(kept).filter(pa.array(hit)).to_batches()

    def dealt(entries: DataFrame) -> DataFrame:
        return entries.repartition(*_TILE).sortWithinPartitions(*_TILE, "guest")

    left = cut(dealt(homes.unionByName(guests, allowMissingColumns=True)).mapInArrow(narrow, _ENTRY), files)

    def judge(batches):
        now, label, count = None, [], np.zeros(0, np.int64)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "rep", "near_key", "near", "n"])

        def nodes(rows) -> list[tuple[int, bytes]]:
            return list(zip(rows.column("rep").to_pylist(), rows.column("key").to_pylist(), strict=True))

        def counts(home: _Home) -> pa.RecordBatch:
            return out([(k, r, k, r, n) for (r, k), n in zip(nodes(home.rows), count.tolist(), strict=True) if n])

        for home, some in _tiles(batches, threshold):
            if home is not now:
                if now is not None:
                    yield counts(now)
                now, label, count = home, nodes(home.rows), np.zeros(home.n, np.int64)
                squares, sizes = (home.x**2).sum(1), home.rows.column("size").to_numpy()
            if some is None:
                continue
            y = np.frombuffer(b"".join(some.column("vec").to_pylist()), np.float64).reshape(len(some), -1)
            linked = (home.x @ y.T / np.sqrt(squares[:, None] * (y**2).sum(1)) >= threshold) & home.due(some)
            hits = np.flatnonzero(linked.any(0))
            if not len(hits):
                continue
            count += linked @ some.column("size").to_numpy()
            theirs, own, rows = sizes @ linked, nodes(some), []
            for j in hits.tolist():  # links become a tree: the label of a home is always reached by the edges told so far
                partners = np.flatnonzero(linked[:, j]).tolist()
                least = min(own[j], *(label[i] for i in partners))
                rows.append((own[j][1], own[j][0], least[1], least[0], int(theirs[j])))
                rows += [(old[1], old[0], least[1], least[0], 0) for old in {label[i] for i in partners} if old != least]
                for i in partners:
                    label[i] = least
            yield out(rows)
        if now is not None:
            yield counts(now)

    # exact vectors come back for what is left; visits tell who judges a pair
    exact = left.join(coded.select("key", "rep", "size", "visits", "vec"), "key")
    found = cut(dealt(exact).mapInArrow(judge, "key binary, rep long, near_key binary, near long, n long"), files)
    pair = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("key"))
    edges = found.where("key <> near_key or rep <> near").select(pair("rep", "key").alias("a"), pair("near", "near_key").alias("b")).unionByName(tight.where("a <> b").select("a", "b"))
    labels = components(edges.distinct(), files).select(F.col("node.key").alias("key"), F.col("label.id").alias("label"))
    total = found.select("key", "n").unionByName(tight.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    named = coded.select("key", "rep", "size").join(total, "key", "left").join(labels, "key", "left")
    rows = source.mapInArrow(name, "id long, key binary").join(named, "key", "left")
    component = F.coalesce("label", "rep", "id")
    n = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("size") - 1 + F.coalesce("n", F.lit(0)))
    return rows.select("id", n.cast("long").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def _models(source: DataFrame) -> dict[int, Model]:
    """Models of the lengths that a sample by the rows' hashes has, by length."""
    size = source.where("vec is not null and size(vec) > 0").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("most")).first()
    cells = max(1, min(CELLS, round(math.sqrt(size["n"]))))
    wanted = max(1, min(SAMPLE_ROWS, max(32 * cells, 8192), SAMPLE_BYTES // (8 * (size["most"] or 1))))
    share = min(1.0, wanted / max(size["n"], 1))
    chosen = source.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    sample = chosen.select("vec", F.xxhash64(F.lit(7), "id", "vec").alias("place")).toArrow().sort_by("place")
    return {x.shape[1]: fit(unit(x), max(1, round(cells * len(x) / max(1, sample.num_rows)))) for _, x in usable(sample.column("vec"))}
