"""Decontamination decides by row, and searches items of null ids."""

from weftline.llm import decontamination


def test_drop_contaminated_by_row(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {passage} y", 1), (None, "clean of it", 2), (7, passage, 3), (7, "clean, too", 4), (7, None, 5), (None, None, 6), (8, passage.upper(), 7), (9, "eleven twelve alone", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w_digest int").repartition(3)
    items = spark.createDataFrame([(1, passage), (None, "eleven twelve"), (None, "no such words"), (None, passage)], "item_id long, text string")
    for bytes_ in (4_000_000, 20):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", bytes_)
        clean = decontamination.drop_contaminated(docs, items)
        assert clean.columns == docs.columns
        assert sorted(r.w_digest for r in clean.collect()) == [2, 4, 5, 6]
        found = {r.id: (r.n_hit, r["items"]) for r in decontamination.decontaminate(docs.where("w_digest > 6"), items).collect()}
        assert found == {8: (10, ["1"]), 9: (2, [])}
