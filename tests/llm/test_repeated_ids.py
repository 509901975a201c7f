"""Rows that share an id but not a text are judged by their texts."""

import pytest

from weftline.llm import ngram_join


@pytest.mark.parametrize("block", [512, 2])
def test_one_of_each_of_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    words = lambda c, n=60: " ".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    near = lambda c: words(c) + " end"
    rows = [
        (3, words("p"), 1), (7, near("p"), 2), (7, words("q"), 3), (7, words("r"), 4),  # one copy of 3 and two of its own
        (8, near("q"), 5), (9, near("r"), 6), (7, "", 7), (7, "!", 8), (7, None, 9),
        (5, words("s"), 10), (5, near("s"), 11), (5, words("s").upper(), 12), (6, words("s"), 13),  # a class, one id several times
        (2, words("t"), 15), (2, words("t"), 14), (7, "", 16), (None, words("p"), 17), (None, words("p"), 18),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w_digest int").repartition(3)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [r.w_digest for r in got.collect()]
    assert sorted(k for k in kept if k not in (10, 11, 12)) == [1, 3, 4, 7, 8, 9, 14, 17, 18]
    assert sum(k in (10, 11, 12) for k in kept) == 1 and kept == list(dict.fromkeys(kept))
    links = {(r.digest, r.id): (r.label and r.label["id"], r.label and r.label.key) for r in ngram_join.linked(docs).collect() if r.key}
    assert len({v for (_, i), v in links.items() if i == 7}) == 3
