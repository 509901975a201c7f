"""Texts without a letter that stand alone in a chunk."""

import pytest

from weftline.llm import language_id


@pytest.mark.parametrize("text", [None, "", "12 34"])
def test_alone_in_a_chunk(spark, monkeypatch, text):
    docs = spark.createDataFrame([(0, "one two three", "en"), (1, "un deux trois", "fr")], "doc_id long, text string, lang string")
    prototypes = language_id.learn(docs)
    alone = spark.createDataFrame([(2, text, "en")], docs.schema).coalesce(1)
    assert [(r.lang_pred, r.score) for r in language_id.predict(alone, prototypes, ["doc_id"]).collect()] == [("und", 0)]
    learned = language_id.learn(alone)
    assert set(learned) == (set() if text is None else {"en"}) and not any(v.any() for v in learned.values())
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 20)
    between = docs.where("doc_id = 0").unionByName(alone).unionByName(docs.where("doc_id = 1")).coalesce(1)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(between, prototypes, ["doc_id"]).collect()}
    assert got == {0: "en", 1: "fr", 2: "und"}
