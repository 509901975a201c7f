"""Decontamination, substring deduplication, n-gram join, language models: against brute force."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_words import plain

from weftline.llm import decontamination, lm_scoring, ngram_join, substring_dedup


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def items(spark, rows):
    first = rows[3][1].split()
    long = rows[5][1].split()
    texts = [" ".join(first[20:45]), "x", "", None, " ".join(long[100:112]).upper(), "nowhere " * 12, " ".join(first[50:55][::-1] + first[55:60])]
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")], "item_id long, text string, id string")


def test_decontamination(docs, rows, items, no_docs):
    known = defaultdict(set)
    for r in items.collect():
        w = plain(r.text, "letters")
        for g in windows(w, min(10, len(w))) if w else ():
            known[g].add(str(r.item_id))
    expected = Counter()
    for i, text, *_ in rows:
        w, hit, found = plain(text, "letters"), set(), set()
        for n in {len(g) for g in known}:
            for at, g in enumerate(windows(w, n)):
                if g in known:
                    hit |= set(range(at, at + n))
                    found |= known[g]
        expected[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    got = decontamination.decontaminate(docs, items)
    assert Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == expected
    near = {(r.id, x) for r in got.collect() for x in r.near_items}
    assert (3, "6") in near  # its ten words stand within fifteen
    assert decontamination.decontaminate(no_docs, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).where("n_hit > 0 or size(near_items) > 0").count() == 0
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for (i, _, h, _), n in expected.items() for _ in range(n) if not h)


def test_decontamination_in_blocks_and_shards(docs, items, monkeypatch):
    whole = {(r.id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in decontamination.decontaminate(docs, items).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 2000)
    assert {(r.id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in decontamination.decontaminate(docs, items).collect()} == whole


@pytest.mark.parametrize("chunk", [4_000_000, 3_000])
def test_substring_dedup(docs, rows, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", chunk)
    least = {}
    for i, text, *_ in rows:
        for at, g in enumerate(windows(plain(text, "spaced"), 20)):
            least[g] = min(least.get(g, (i, at)), (i, at))
    expected = Counter()
    for i, text, *_ in rows:
        w, gone = plain(text, "spaced"), set()
        for at, g in enumerate(windows(w, 20)):
            if least[g] < (i, at):
                gone |= set(range(at, at + 20))
        runs = [[k, next(e for e in range(k, len(w) + 1) if e not in gone)] for k in sorted(gone) if k - 1 not in gone]
        expected[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), str(runs))] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept, str(r.removed)) for r in got) == expected
    assert sum(r.n_removed for r in got) > 3000
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(docs, rows, no_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = []
    for _, text, *_ in rows:
        w = plain(text, "letters")
        sets.append(set(windows(w, min(5, len(w)))) if w else set())
    n = len(rows)
    links = {(a, b) for a in range(n) for b in range(n) if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    group = list(range(n))
    for _ in range(n):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b], key=lambda x: rows[x][0])
    expected = Counter((rows[a][0], rows[group[a]][0], sum((a, b) in links for b in range(n))) for a in range(n))
    got = ngram_join.join(docs).collect()
    assert Counter((r.id, r.class_id, r.n_links) for r in got) == expected
    stay = ngram_join.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({k[0] for k in expected if k[0] == k[1]})
    assert ngram_join.join(no_docs).count() == 0


def test_ngram_join_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (4, "A b, c d e f")], "doc_id long, text string")
    assert sorted((r.id or 0, r.class_id or 0, r.n_links) for r in ngram_join.join(docs).collect()) == [(0, 0, 0), (0, 0, 0), (4, 4, 1), (5, 4, 1)]
    assert ngram_join.one_of_each(docs).count() == 3


def test_bayesian_thresholds_keep_what_may_reach_it():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == list(range(16, 129, 16))
    assert all(a <= b for a, b in zip(least.values(), list(least.values())[1:], strict=False))
    # a pair of similarity 0.8 is dropped at the last step with a chance of about the tolerance
    drop = sum(math.comb(128, m) * 0.8**m * 0.2 ** (128 - m) for m in range(least[128]))
    assert drop < 1e-4


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 50), (50, 45), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 45: 40, 50: 40}


@pytest.mark.parametrize("chunk", [4_000_000, 3_000])
def test_lm_scoring(spark, docs, rows, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", chunk)
    chosen = {2, 3, 5, 12, 77}
    words = [plain(r[1], "letters") for r in rows]
    size = len({x for w in words for x in w})
    pairs = [list(zip(["<s>", *w], w, strict=False)) for w in words]
    models = []
    for target in (True, False):
        own = [p for r, p in zip(rows, pairs, strict=True) if (r[0] in chosen) == target]
        models.append((Counter(x for p in own for x, _ in p), Counter(x for p in own for x in p)))
    expected = Counter()
    for r, p in zip(rows, pairs, strict=True):
        losses = []
        for (first, both), mine in zip(models, (r[0] in chosen, r[0] not in chosen), strict=True):
            a, b = Counter(x for x, _ in p), Counter(p)
            losses.append(sum(math.log(first[v] - mine * a[v] + 0.1 * size) - math.log(both[v, x] - mine * b[v, x] + 0.1) for v, x in p) / len(p) if p else None)
        expected[(r[0], r[0] in chosen, len(p), *(None if x is None else round(x, 6) for x in losses))] += 1
    targets = spark.createDataFrame([(i,) for i in [*chosen, 2]], "doc_id long")
    got = lm_scoring.score(docs, targets).select("id", "is_target", "n_tokens", F.round("target_loss", 6), F.round("background_loss", 6))
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert lm_scoring.score(no_docs, targets).count() == 0
