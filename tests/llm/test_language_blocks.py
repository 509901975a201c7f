"""Languages are compared with block by block; the size of a block changes nothing."""

from __future__ import annotations

import numpy as np

from weftline.llm import language_id


def test_any_block_gives_the_same(spark, monkeypatch):
    rows = [(i, f"l{i % 9:02d}", f"{chr(97 + i % 9) * 3} {chr(98 + i % 9)}{chr(97 + i % 7)} word{chr(97 + i % 5)}") for i in range(90)]
    docs = spark.createDataFrame([*rows, (90, "l00", None), (91, "l00", "12"), (92, None, "aaa ba")], "doc_id long, lang string, text string")
    prototypes = language_id.learn(docs)
    prototypes["l99"] = prototypes["l03"]  # ties go to the first by name, in other blocks too
    unlike = {k: -v for k, v in prototypes.items()}
    whole = [language_id.predict(docs, p, ["doc_id"]).orderBy("doc_id").collect() for p in (prototypes, unlike)]
    for block in (1, 2, 4):
        monkeypatch.setattr(language_id, "BLOCK", block)
        again = [language_id.predict(docs, p, ["doc_id"]).orderBy("doc_id").collect() for p in (prototypes, unlike)]
        for x, y in zip(whole, again, strict=True):
            assert [(r.doc_id, r.lang_pred) for r in x] == [(r.doc_id, r.lang_pred) for r in y]
            assert np.allclose([r.score for r in x], [r.score for r in y], atol=1e-6)
    assert "l99" not in {r.lang_pred for r in whole[0]}


def test_whole_table_against_brute_force(spark, sf_dir):
    """Prototypes by plain sums over n-grams; every document's language and score of the query."""
    from weftline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    from zlib import crc32

    cache: dict[tuple, np.ndarray] = {}

    def bound(gram):
        if gram not in cache:
            cache[gram] = np.prod([np.roll(language_id.letter_vector(c).astype(np.int64), len(gram) - 1 - k) for k, c in enumerate(gram)], axis=0)
        return cache[gram]

    def profile(text):
        codes = []
        for c in f" {text or ''} ":
            code = ord(c.lower()[0]) if c.isalpha() else 32
            if code != 32 or not codes or codes[-1] != 32:
                codes.append(code)
        grams: dict[tuple, int] = {}
        for i in range(len(codes) - 2):
            g = tuple(codes[i : i + 3])
            grams[g] = grams.get(g, 0) + 1
        return sum((n * bound(g) for g, n in grams.items()), np.zeros(language_id.D, np.int64)).astype(float)

    profiles = [profile(t) for t in docs.text]
    held = [crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    prototypes: dict[str, np.ndarray] = {}
    for lang, text, p, h in zip(docs.lang, docs.text, profiles, held, strict=True):
        if not h and lang is not None and text is not None:
            prototypes[lang] = prototypes.get(lang, 0) + p
    names = sorted(prototypes)
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text, p, h in zip(docs.doc_id, docs.text, profiles, held, strict=True):
        r = got[i]
        assert r.held_out == h
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosine = np.array([p @ prototypes[n] / max(np.linalg.norm(p) * np.linalg.norm(prototypes[n]), 1e-12) for n in names])
        assert abs(r.score - np.clip(cosine.max(), 0, 1)) < 1e-4
        assert cosine[names.index(r.lang_pred)] > cosine.max() - 1e-5
