"""Every stage by itself over nulls, empty and long texts, repeats and clashing columns; null ids of the other operators."""

from collections import Counter

import pytest

from weftline.llm import lm_scoring, substring_dedup


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def test_stages_keep_columns_and_take_any_rows(spark, docs, rows, no_docs, stages, sf_dir):
    for name, stage in stages.items():
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert set(docs.columns) <= set(out.columns), name
        if name in ("PII", "mixing sources to target weights"):
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert stage(spark, no_docs, sf_dir).count() == 0
    kept = Counter(r.doc_id for r in stages["n-gram Jaccard join"](spark, docs, sf_dir).collect())
    assert all(kept[i] == 1 for i in (11, 12, 13, 0, 1, 3)) and not kept[6]


def test_null_ids_are_documents_of_their_own(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"a {passage}"), (None, f"b {passage}"), (None, " ".join(f"v{i}" for i in range(25))), (None, "x " + " ".join(f"v{i}" for i in range(25))), (None, " ".join(f"u{i}" for i in range(20)) + " z " + " ".join(f"u{i}" for i in range(20)))]
    for chunk in (4_000_000, 50):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert Counter((r.id, r.n_words, r.n_removed) for r in got) == Counter([(1, 31, 0), (None, 31, 30), (None, 25, 0), (None, 26, 0), (None, 41, 20)])
        monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
        named = spark.createDataFrame([(1,), (None,)], "doc_id long")
        assert Counter((r.id, r.is_target) for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), named).collect()) == Counter([(1, True)] + [(None, False)] * 4)
