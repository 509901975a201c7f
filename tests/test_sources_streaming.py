import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import io as IO
from weftline.streaming import logs as L

ROWS = [{"id": "a", "n": 1}, {"id": "", "n": 2}, {"id": "c", "n": 3}]


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("x.json", json.dumps(ROWS)),
        ("y.json", json.dumps({"instances": ROWS})),
        ("z.json", json.dumps({r["id"] or "k": r for r in ROWS})),
        ("w.jsonl", "\n\n".join(json.dumps(r) for r in ROWS) + "\n"),
    ],
)
def test_rows(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    got = IO.read_rows(spark, str(tmp_path / name), "id string, n int", key="id")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("c", 3)]


def test_malformed_line_is_an_error(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{oops\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_tree(spark):
    tree = {"src": {"a.py": {"text": ["x", "y"], "classes": [{"name": "K"}], "functions": []}, "deep": {"er": {"b.js": {"text": "z"}}}}, "none": 3}
    got = IO.flatten_tree(spark.createDataFrame([("i", json.dumps(tree)), ("j", None)], "instance_id string, tree string"), "instance_id").collect()
    assert [(r.path, r.text, json.loads(r.classes)) for r in got] == [("src/a.py", "x\ny", [{"name": "K"}]), ("src/deep/er/b.js", "z", [])]


def test_folders(spark, tmp_path):
    for name in ("src/a.py", "src/node_modules/b.py", "docs/c.txt", "d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert sorted(r.path for r in IO.walk_sources(spark, str(tmp_path)).collect()) == ["d.ts", "src/a.py"]


def test_graph_trace_and_logs(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"code_graph": {"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b", "type": "calls"}]}}))
    nodes, edges = IO.read_graph(spark, str(tmp_path / "g.json"))
    assert [r.id for r in nodes.collect()] == ["a"] and [tuple(r) for r in edges.collect()] == [("a", "b", "calls", 1.0, 0)]
    assert [r.value for r in IO.dot_lines(edges.withColumn("dst", F.lit('b"'))).collect()] == ['"a" -> "b\\"" [label="calls"];']
    assert [tuple(r) for r in IO.incident_text(edges).collect()] == [("a", "calls b")]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": [{"ph": "M", "name": "meta"}, {"ph": "X", "name": "f (x.py:3)", "ts": 1.0, "dur": 2.0, "pid": 1, "tid": 2}]}))
    assert [tuple(r) for r in IO.read_trace(spark, str(tmp_path / "t.json")).collect()] == [("f (x.py:3)", "f", "x.py", 3, 1.0, 2.0, 1, 2)]
    (tmp_path / "bad.json").write_text(json.dumps({"traceEvents": [{"ph": "B", "name": "f"}]}))
    with pytest.raises(Exception, match="phase B"):
        IO.read_trace(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "one.log").write_text("noise\n>>> run\nPASSED t\n")
    (tmp_path / "two.log").write_text("noise\n>>> run\npatch failed\n")
    logs = {r.file.rsplit("/", 1)[1]: (r.ran, r.log) for r in IO.read_logs(spark, str(tmp_path / "*.log"), ">>> run\n", ("patch failed",)).collect()}
    assert logs == {"one.log": (True, "PASSED t\n"), "two.log": (False, None)}


def test_cache_store_and_sinks(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"image_url": "u", "ocr_text": "t"}, {"url": "v"}]))
    (tmp_path / "m.json").write_text(json.dumps({"w": "x"}))
    assert [tuple(r) for r in IO.read_cache(spark, str(tmp_path / "l.json")).collect()] == [("u", "t")]
    assert [tuple(r) for r in IO.read_cache(spark, str(tmp_path / "m.json")).collect()] == [("w", "x")]
    store = IO.ObjectStore(spark, str(tmp_path / "store"))
    store.write("a/b.txt", "é")
    store.write("a/c.txt", "2")
    assert store.read("a/b.txt") == "é" and store.list("a") == ["b.txt", "c.txt"] and store.list() == ["a/"]
    store.delete("a")
    assert store.list() == []
    with pytest.raises(FileNotFoundError):
        store.read("a/b.txt")
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, s string")
    IO.write_csv(df, str(tmp_path / "csv"), ["s", "n", "gone"])
    assert {(r.s, r.n, r.gone) for r in IO.read_csv(spark, str(tmp_path / "csv"), "s string, n int, gone string").na.fill("").collect()} == {("", 1, ""), ("x", 2, "")}
    IO.write_json(df, str(tmp_path / "json"))
    IO.write_json(df, str(tmp_path / "json"), append=True)
    assert IO.read_jsonl(spark, str(tmp_path / "json"), "n int, s string").count() == 4
    assert IO.markdown(spark.createDataFrame([("a", 1 / 3)], "k string, v double"), "T") == "# T\n\n| k | v |\n| --- | --- |\n| a | 0.33 |\n"
    df.createOrReplaceTempView("a_view")
    assert {("a_view", "n", "int"), ("a_view", "s", "string")} <= {tuple(r)[:3] for r in IO.catalog_columns(spark).collect()}


@pytest.fixture
def stream_folder(spark, tmp_path):
    rows = [(i, "u" + str(i % 2), i, "2024-01-01 00:%02d:00" % i, "abc"[i % 3]) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id string, k int, t string, event_type string").withColumn("ts", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    return str(tmp_path / "in")


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parquet")


def test_streams(spark, stream_folder):
    assert {tuple(r) for r in L.run(L.counts(stream(spark, stream_folder), ["user_id"]), "complete").collect()} == {("u0", 15), ("u1", 15)}
    assert L.run(L.first_seen(stream(spark, stream_folder).select("event_type"), ["event_type"]), "append").count() == 3
    assert L.run(L.first_seen_within(stream(spark, stream_folder), ["event_type"], "ts", "1 hour"), "append").count() == 3
    kept = {r.user_id: r.kept for r in L.run(L.rolling_retention(stream(spark, stream_folder), "user_id", ["event_id"], 1, 4), "update").collect()}
    assert kept["u0"][0] == 0 and len(kept["u0"]) <= 4 and kept["u0"][-1] == 28
    windows = L.run(L.windowed_counts(stream(spark, stream_folder), "ts", "10 minutes", "0 seconds", []), "complete")
    assert sorted(r.n for r in windows.collect()) == [10, 10, 10]


def test_fan_out(spark, stream_folder, tmp_path):
    seen = []
    query = L.fan_out(stream(spark, stream_folder), {"b": lambda df, n: seen.append(("b", df.count())), "a": lambda df, n: seen.append(("a", df.count()))}, str(tmp_path / "state"))
    query.awaitTermination()
    assert seen == [("a", 30), ("b", 30)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, 'q"', 0.5)], "k long, t string, x double").coalesce(1)
    report = IO.markdown(df.orderBy("k"), "T", 1)
    assert report.endswith("| 1 | a\nb |  |\n\n1 more rows are not shown.\n") and "more rows" not in IO.markdown(df, "T", 2)
    IO.write_pretty_json(df, str(tmp_path / "out"))
    said = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    found = [json.loads(x) for x in said.split("\n\n") if x.strip()]
    assert sorted(found, key=lambda r: r["k"]) == [{"k": 1, "t": "a\nb", "x": None}, {"k": 2, "t": 'q"', "x": 0.5}] and "\n  " in said
