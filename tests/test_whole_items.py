"""Chunks are scored against whole benchmark items, by brute force."""

import pytest
from oracle import connect

from weftline.operators.fuzzy import lcs
from weftline.plans import QUERIES


def test_lcs_chunks_of_whole_items(spark, sf_dir):
    c = connect(sf_dir)
    items = dict(c.execute("select item_id, text from benchmark").fetchall())
    docs = dict(c.execute("select doc_id, text from documents").fetchall())
    got = {}
    for r in QUERIES["lcs_chunks"](spark, sf_dir).collect():
        got.setdefault((r.query_id, r.doc_id), []).append((r.rank, r.start, r.end, r.score))
    assert any("\n" in items[q] for q, _ in got)
    for (q, d), rows in got.items():
        lines = docs[d].split("\n")
        scored = []
        for a in range(0, len(lines), 5):
            chunk = "\n".join(lines[a : a + 5])
            scored.append((-round(lcs(chunk, items[q]) / len(chunk) if chunk else 0.0, 6), a + 1, min(a + 5, len(lines))))
        assert [(s, e, pytest.approx(-x, abs=2e-6)) for x, s, e in sorted(scored)[:3]] == [(s, e, x) for _, s, e, x in sorted(rows)]
