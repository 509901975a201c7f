"""Queries over SQLite databases that hold the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import shared_folder, table
from weftline.sources import sqlite as L


def _stored(spark, df, name: str) -> str:
    """The path of a table's databases, one a partition."""
    L.register(spark)
    path = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
    df.write.format("sqlite").option("table", name).mode("append").save(path)
    return path


@query("select o_orderkey, o_custkey::bigint as o_custkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 1000.0 and o_custkey is not null")
def sqlite_scan(spark, sf_dir):
    """Orders from databases, by ranges of rows and with filters that the databases apply."""
    kept = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = _stored(spark, kept, "orders")
    return spark.read.format("sqlite").option("table", "orders").load(path).where("o_orderstatus = 'F' and o_totalprice > 1000.0 and o_custkey is not null")


@query("select 'supplier' as table_name, unnest(['s_suppkey', 's_nationkey', 's_name']) as column_name, unnest(['INTEGER', 'INTEGER', 'TEXT']) as data_type, unnest([0, 1, 2]) as pos")
def sqlite_tables(spark, sf_dir):
    """Tables and columns that databases declare."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("s_nationkey"), F.lit("s").alias("s_name"))
    return L.tables(spark, _stored(spark, s, "supplier")).select("table_name", "column_name", "data_type", "pos").distinct()


@query(
    """select 'CREATE TABLE "nation" ("n_nationkey" INTEGER, "n_name" TEXT);' || chr(10) || '/*' || chr(10) || '3 example rows:' || chr(10) || 'SELECT * FROM nation LIMIT 3;' || chr(10)
|| 'n_nationkey    n_name' || chr(10) || string_agg(n_nationkey || '    ' || n_name || chr(10), '' order by n_nationkey) || '*/' || chr(10) || chr(10) as prompt from (select * from nation order by n_nationkey limit 3)"""
)
def sqlite_prompts(spark, sf_dir):
    """What creates a database's tables, with sample rows."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").orderBy("n_nationkey").coalesce(1)
    return L.prompts(spark, _stored(spark, n, "nation"), 3).select("prompt")
