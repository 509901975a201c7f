"""Links of embeddings against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from weftline.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, key string"


def plain(rows, threshold):
    """Per row (vec_id, n_links, component, kept), by all pairs."""
    good = [k for k, (i, v, *_) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    count, root = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for n in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == n]
        x = np.array([rows[k][1] for k in own], float)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        square = (x * x).sum(1)
        linked = x @ x.T / np.sqrt(square[:, None] * square) >= threshold
        np.fill_diagonal(linked, False)
        for a, b in zip(*np.nonzero(linked), strict=True):
            count[own[a]] += 1
            root[find(own[a])] = find(own[b])
    least = {}
    for k in good:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], count[k], least.get(find(k), r[0]) if k in set(good) else r[0], (least[find(k)] if k in set(good) else r[0]) == r[0]) for k, r in enumerate(rows)), key=repr)


def check(spark, rows, threshold=0.9, **more):
    found = E.links(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=threshold, **more).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows, threshold)


def near(rng, v, cosine):
    """A unit vector at this cosine from v."""
    v = v / np.linalg.norm(v)
    side = rng.normal(size=len(v))
    side -= side @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_odd_vectors(spark):
    """Nulls, no numbers, zeros, other lengths, repeated ids and rows, scaled copies, the border, great and tiny numbers."""
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, nan, 0.0, 0.0], [inf, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [9.0, 3.0, 3.0, 1.0], [2.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
    vectors += [[1e300, 1e300, 0.0, 0.0], [1e-300, 1e-300, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0], [-3.0], [5e-324], [1.0, 1.0, -0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, 0, 0, "k") for i, v in enumerate(vectors)]
    rows += [rows[6], (6, [0.0, 1.0, 0.0, 0.0], 0, 0, "k"), (None, [1.0, 0.0, 0.0, 0.0], 0, 0, "k"), (3, [0.0, 1.0, 0.0, 0.0], 0, 0, None)]
    check(spark, rows)
    check(spark, rows, threshold=1.0)
    check(spark, [])
    check(spark, rows[:6])


@pytest.mark.parametrize("dim, certain", [(12, False), (64, True), (64, False)])
def test_near_copies(spark, monkeypatch, dim, certain):
    """Groups at and around the threshold, chains, a list of hundreds of near copies that is cut into blocks, exact copies."""
    monkeypatch.setattr(E, "BLOCK", 64)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(400, dim))
    vectors = list(base)
    for k in range(60):
        at = base[k]
        for cosine in (0.999, 0.95, 0.905, 0.9001, 0.8999, 0.88):
            at = near(rng, at if k % 2 else base[k], cosine)
            vectors.append(at * rng.uniform(0.1, 10))
    vectors += [near(rng, base[100], c) for c in rng.uniform(0.9, 1, 300)] + [near(rng, base[101], 0.995) for _ in range(300)] + [base[7]] * 50
    order = rng.permutation(len(vectors)).tolist()
    check(spark, [(order[i], [float(x) for x in v], 0, 0, "k") for i, v in enumerate(vectors)], certain=certain)


def test_recall_over_a_table(spark, sf_dir):
    """Near copies of vectors of the table, in random directions, among all its vectors: at least 0.9 of links (here: all)."""
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, [float(x) for x in r.embedding], 0, 0, "") for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows += [(10_000 + i, near(rng, np.array(rows[i % 500][1]), 0.9 + 0.02 * rng.random()).tolist(), 0, 0, "") for i in range(2000)]
    found = {r.id: r.n_links for r in E.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = {r[0]: r[1] for r in plain(rows, 0.9)}
    assert all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.99 * sum(expected.values())


def test_bounds_of_codes():
    """No look-up distance less its code's error is above the true distance; all lists that can hold partners are visited."""
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(3000, 20)))
    model = E.fit(x, 50)
    near_x = np.stack([near(rng, v, 0.9) for v in x])
    both = np.concatenate([x, near_x])
    c = E.encode(both, model, 0.9, True)
    said = np.concatenate([part[c.code[:, k]] for k, part in enumerate(model.parts)], 1) + model.centroids[c.cell]
    assert np.allclose(np.linalg.norm(both - said, axis=1), c.error)
    for i in range(len(x)):
        a, b = c.cell[i], c.cell[len(x) + i]
        assert a == b or b in c.visits[i] or a in c.visits[len(x) + i]
