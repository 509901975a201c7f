"""Manifests and proofs against a tree built level by level from lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from weftline.llm import merkle
from weftline.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, place string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    own = []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        ordered = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own.append((ordered, levels([leaf(r) for r in ordered])))
    top = levels([tree[-1][0] for _, tree in own])
    out = []
    for g, (ordered, tree) in enumerate(own):
        for i, r in enumerate(ordered):
            changed = list(r)
            if r[0] is not None and r[3] is not None and not zlib.crc32(str(r[0]).encode()) % 7:
                changed[3] += 1
            node, beside = leaf(changed), []
            for nodes, k in [(x, i >> n) for n, x in enumerate(tree[:-1])] + [(x, g >> n) for n, x in enumerate(top[:-1])]:
                run = nodes[k // 2 * 2 : k // 2 * 2 + 2]
                beside += run[: k % 2] + run[k % 2 + 1 :]
                node = digest(*run[: k % 2], node, *run[k % 2 + 1 :])
            root = top[-1][0]
            out.append((r[0], leaf(r), tree[-1][0], root, digest(*beside), node, node == root))
    return sorted(out, key=repr)


def query(spark, folder):
    rows = QUERIES["op13_merkle"](spark, str(folder)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=repr)


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return query(spark, tmp_path)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert query(spark, sf_dir) == plain(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls in all fields, repeated rows and ids, groups of one to some blocks, the greatest integer, columns of clashing names."""
    rows = [(i, "s", "en", i, f"text {i}", "n", "p") for i in range(2 * 1024 + 3)] + [(i, None, "zé", 2**63 - 1, "é" * i, "n", "p") for i in range(1025)]
    rows += [(5, "s", "de", None, "", "n", "p"), *[(6, "s", "fr", 1, t, "n", "p") for t in ("b", "a", "b")], *[(i, "s", None, 1, "x" * 70000, "n", "p") for i in (9, None, None)], (None, None, None, None, None, None, None), (1, "s", "", 1, "no name", "n", "p")]
    assert written(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 1, "alone", "n", "p")]])
def test_small_tables(spark, tmp_path, rows):
    assert written(spark, tmp_path, rows) == plain(rows) if rows else written(spark, tmp_path, rows) == []


@pytest.mark.parametrize("band", [1, 2, 3, 5])
def test_traversal(band):
    for n in [*range(1, 36), 64, 100, 257]:
        tree = levels([digest(str(i)) for i in range(n)])
        height = len(tree) - 1
        assert merkle.root(tree[0], height) == tree[-1][0]
        for i, path in enumerate(merkle.traversal(tree[0], height, band)):
            beside = [(i >> k) ^ 1 for k in range(height)]
            assert path == ["." if s >= len(tree[k]) else "<>"[s > i >> k] + tree[k][s] for k, s in enumerate(beside)]
        assert i == n - 1


def test_memory_of_a_traversal_is_bounded(monkeypatch):
    """Beside the leaves, subtrees of 2**band nodes: two of every band."""
    made, seen = [], merkle.treehash

    def watched(leaves, first, height, held):
        made.extend(nodes for _, _, nodes in held)
        yield from seen(leaves, first, height, held)

    monkeypatch.setattr(merkle, "treehash", watched)
    most = 0
    for i, _ in enumerate(merkle.traversal([digest(str(i)) for i in range(1024)], 10, 2)):
        if i % 8 == 0:
            most = max(most, *(len(nodes) for nodes in made))
    assert most <= 2 * 2**2
