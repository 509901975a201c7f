"""Tables of SQLite databases read and written by tasks."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftline.sources import sqlite as L


@pytest.fixture
def made(tmp_path):
    """Two databases of a table with all kinds of columns, nulls and gaps of row numbers, and a table without numbers."""
    rng = random.Random(4)
    rows = []
    for d in range(2):
        c = sqlite3.connect(tmp_path / f"d{d}.sqlite")
        c.execute('create table t (id integer primary key, "a b" varchar(9) collate nocase, x double, n decimal(4,1), raw blob)')
        c.execute("create table k (a text primary key, b int) without rowid")
        c.execute("create view v as select id, x from t")
        for i in range(300):
            row = (d * 1000 + i * i, rng.choice(("a", "A", "b", "é", "", None)), rng.choice((1.0, 2.5, None)), rng.choice((1, 2.5, "x", None)), rng.choice((b"\0z", None)))
            c.execute("insert into t values (?, ?, ?, ?, ?)", row)
            rows.append(tuple(str(v) if k == 3 and v is not None else v for k, v in enumerate(row)))
        c.execute("insert into k values (?, ?)", (f"k{d}", d))
        c.commit()
        c.close()
    return str(tmp_path), rows


def _rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


def test_scan(spark, made):
    path, rows = made
    L.register(spark)
    df = spark.read.format("sqlite").option("table", "t").option("rows", 5000).load(path)
    assert df.dtypes == [("id", "bigint"), ("a b", "string"), ("x", "double"), ("n", "string"), ("raw", "binary")]
    assert df.rdd.getNumPartitions() > 20 and _rows(df) == sorted(rows, key=repr)
    for cond, holds in (
        ("`a b` > 'A'", lambda r: r[1] is not None and r[1] > "A"),
        ("`a b` = 'a' and id >= 500", lambda r: r[1] == "a" and r[0] >= 500),
        ("`a b` in ('a', 'é')", lambda r: r[1] in ("a", "é")),
        ("x is null", lambda r: r[2] is None),
        ("x > 1.5", lambda r: r[2] is not None and r[2] > 1.5),
        ("n = '2.5'", lambda r: r[3] == "2.5"),
        ("n > '1'", lambda r: r[3] is not None and r[3] > "1"),
    ):
        assert _rows(df.where(cond)) == sorted(filter(holds, rows), key=repr), cond
    some = spark.read.format("sqlite").option("table", "t").schema("x double").load(path)
    assert some.columns == ["x"] and some.count() == 600
    assert _rows(spark.read.format("sqlite").option("table", "k").load(path)) == [("k0", 0), ("k1", 1)]
    assert spark.read.format("sqlite").option("table", "v").load(f"{path}/d0.sqlite").count() == 300


def test_filters_reach_the_databases(made):
    path, rows = made
    reader = L.SQLiteSource({"path": path, "table": "t"}).reader(L.SQLiteSource({"path": path, "table": "t"}).schema())
    asked = [L.EqualTo(("a b",), "a"), L.LessThan(("id",), 100), L.EqualTo(("n",), "2.5"), L.GreaterThan(("x",), 1)]
    assert list(reader.pushFilters(asked)) == asked and [v for _, some in reader._where for v in some] == ["a", 100]
    read = [r["id"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(read) == sorted(r[0] for r in rows if r[1] == "a" and r[0] < 100)


def test_columns_named_as_row_numbers(spark, tmp_path):
    with sqlite3.connect(tmp_path / "r.db") as c:
        c.execute("create table r (rowid text, n int)")
        c.executemany("insert into r values (?, ?)", [("b", 1), (None, 2), ("b", 3)])
        c.execute("create table empty (n int)")
    c.close()
    L.register(spark)
    read = lambda t: spark.read.format("sqlite").option("table", t).load(str(tmp_path))
    assert _rows(read("r")) == sorted([("b", 1), (None, 2), ("b", 3)], key=repr) and read("empty").collect() == []


def test_round_trip_and_overwrite(spark, tmp_path):
    L.register(spark)
    path = f"file:{tmp_path}/out"
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("né"), "id")).alias("s"), (F.col("id") / 7).alias("d"))
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("sqlite").option("table", 'odd "name"').mode(mode).save(path)
        back = spark.read.format("sqlite").option("table", 'odd "name"').load(path)
        assert _rows(back) == sorted((tuple(r) for r in df.collect() * times), key=repr)


def test_what_there_is_not(spark, made, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.databases(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="mounted"):
        L.databases("s3://bucket/x")
    with pytest.raises(ValueError, match="no table"):
        L._declared(f"{made[0]}/d0.sqlite", "none")


def test_descriptions(spark, made):
    found = {(r.table_name, r.column_name, r.data_type) for r in L.tables(spark, made[0]).collect()}
    assert len(found) == 7 and {("t", "a b", "varchar(9)"), ("k", "b", "INT")} <= {(a, b, c.upper() if a == "k" else c) for a, b, c in found}
    prompt = L.prompts(spark, f"{made[0]}/d1.sqlite", 1).first()["prompt"]
    assert prompt.endswith("create table k (a text primary key, b int) without rowid;\n/*\n3 example rows:\nSELECT * FROM k LIMIT 1;\na    b\nk1    1\n*/\n\n".replace("create table", "CREATE TABLE"))  # as SQLite keeps it
    assert "/*" not in L.prompts(spark, f"{made[0]}/d1.sqlite").first()["prompt"]
