"""Columns of map type and of the names that operators make."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import language_id, mixing, ngram_join, pii, quality_rules

TEXT = "Write to me at someone@example.com, please. " + "The of and to in is a word that it was for on are as with they at be this. " * 9


def test_map_columns(spark):
    rows = [(i, f"{TEXT} {i}", f"s{i % 3}", {"a": i}, [{"b": 1}]) for i in range(40)] + [(1, f"{TEXT} 1", "s1", {"a": 0}, [{"b": 1}]), (1, f"{TEXT} 1", "s1", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>, more array<map<string,int>>")
    mixed = mixing.mix(docs, block=4)
    assert mixed.columns == [*docs.columns, "mix_slot", "mix_phase", "mix_position"]
    assert sorted(r.mix_position for r in mixed.collect()) == list(range(42))
    other = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("some other words that no one else has here")).otherwise(F.col("text")))
    kept = ngram_join.one_of_each(other).collect()
    assert [r.doc_id for r in kept if r.doc_id == 1] == [1]
    assert next(r for r in kept if r.doc_id == 1).extra is None  # nulls are least


def test_ids_of_new_columns_names(spark):
    docs = spark.createDataFrame([(1, "x", TEXT), (2, None, None)], "kept long, base string, text string").withColumns({"w_text": F.lit(7), "score": F.lit("mine")})
    judged = quality_rules.measure(docs, ["kept", "w_text"])
    assert judged.columns[:2] == ["kept", "w_text"] and len(set(judged.columns)) == len(judged.columns)
    assert [(r.kept, r.w_text, r.n_words) for r in judged.orderBy("kept").collect()] == [(1, 7, len(TEXT.split())), (2, 7, 0)]
    plain = quality_rules.measure(docs.select("text", F.col("base").alias("id")), ["id"])
    assert {r.kept for r in plain.collect()} == {r.kept_ for r in judged.collect()}
    found = pii.find(docs, ["base", "kept"])
    assert found.columns[:2] == ["base", "kept"] and {"base_", "spans"} <= set(found.columns)
    assert {r.base: r.n_email for r in found.collect()} == {"x": 1, None: 0}
    prototypes = language_id.learn(docs.select("text", F.lit("en").alias("lang")))
    told = language_id.predict(docs, prototypes, ["score", "text"])
    assert told.columns == ["score", "text", "lang_pred", "score_"]
    assert sorted((r.score, r.lang_pred) for r in told.collect()) == [("mine", "en"), ("mine", "und")]
