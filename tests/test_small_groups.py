"""Many small graphs go through a task one behind the other, not as a table each."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph as G


@pytest.mark.parametrize("name", ["topological_order", "best_first"])
def test_graphs_stream(spark, name):
    e = spark.range(3001).select(F.when(F.col("id") > 0, F.col("id")).alias("g"), F.explode(F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in (("a", "b"), ("b", "c"), ("a", "c"))))).alias("x")).select("g", "x.*", F.lit(1.0).alias("weight"), F.lit("a").alias("root"))
    found = G.topological_order(e.select("g", "src", "dst"), "g") if name == "topological_order" else G.best_first(e, "g", "root")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(g or None, n, i + 1) for g in range(3001) for i, n in enumerate("abc")}
