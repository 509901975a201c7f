"""Runs of a million characters take seconds, and words of regular patterns keep hashes of their own."""

import random
import time

import numpy as np
import pyarrow as pa

from weftline.llm import language_id, pii, quality_rules
from weftline.llm import words as W

LONG = [
    "a" * 1_000_000 + " x@y.zz",
    "1" * 1_000_000 + " +1 (269) 555-3296",
    "a@" + "b." * 400_000 + "com",
    "+1" + ". " * 500_000,
    "x_" * 500_000,
    "- " * 500_000,
    "10.1.2.3 " * 20_000,
]


def test_long_runs(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(len(LONG))
    pii.find(docs.limit(1), ["doc_id"], model=(0.0, {})).collect()
    model = pii.train([])
    start = time.perf_counter()
    found = {r.doc_id: r for r in pii.find(docs, ["doc_id"], model=model).collect()}
    assert time.perf_counter() - start < 60
    assert [found[i].n_email for i in range(7)] == [1, 0, 1, 0, 0, 0, 0]
    assert (found[1].n_phone, found[6].n_ip) == (1, 20_000)
    assert [tuple(s) for s in found[6].base[-1:]] == [(9 * 19_999, 1, 9 * 19_999 + 8)]
    start = time.perf_counter()
    assert quality_rules.measure(docs, ["doc_id"]).count() == len(LONG)
    assert {r.lang_pred for r in language_id.predict(docs, {"en": np.ones(language_id.D)}, ["doc_id"]).collect()} == {"en", "und"}
    assert time.perf_counter() - start < 60
    assert {r.doc_id: r.text for r in pii.redact(docs, model=model).collect()}[6] == "[IP] " * 20_000


def test_thue_morse_words():
    for n in (1024, 2048, 4096):
        bits = np.array([bin(i).count("1") & 1 for i in range(n)])
        both = ["".join("ab"[b] for b in x) for x in (bits, 1 - bits)]
        for kind in W.KINDS:
            w = W.words_of(pa.array(both), kind)
            assert len(set(w.hashes.tolist())) == 2
        hashes = np.where(bits, np.uint64(3), np.uint64(5))
        assert len(set(W.windows(np.concatenate([hashes, np.where(bits, np.uint64(5), np.uint64(3))]), n)[[0, n]].tolist())) == 2


def test_words_beyond_the_table():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(n)) for n in (60, 63, 64, 65, 200, 200)]
    hashes = W.words_of(pa.array([" ".join(words), " ".join(reversed(words))]), "spaced").hashes.tolist()
    assert hashes[:6] == hashes[6:][::-1] and len(set(hashes)) == 6
