"""The registered interval has all rounds of the operator."""

from pyspark.sql import functions as F

from weftline.operators import summary as S
from weftline.plans import QUERIES
from weftline.session import table


def test_bootstrap_ci_of_a_thousand_rounds(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    own = lambda n: S.bootstrap_interval(labels, "doc_id", F.col("quality") == 1, n).first()
    assert QUERIES["bootstrap_ci"](spark, sf_dir).first() == own(1000) != own(200)


def test_no_rows_of_rounds_are_broadcast(spark, sf_dir):
    """A join with the ranges of the rounds sends those ranges, never the table a thousand times over."""
    plan = QUERIES["bootstrap_ci"](spark, sf_dir)._jdf.queryExecution().sparkPlan()
    joins, open_ = [], [plan]
    while open_:
        node = open_.pop()
        open_ += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin":
            joins.append(node.children().apply(0 if "Left" in node.buildSide().toString() else 1).toString())
    assert joins and not any("Generate" in x for x in joins)
