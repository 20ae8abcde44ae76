"""Plan shape checks: the properties the scale design relies on."""

import os
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_corpus_joins_broadcast_the_id_side(spark):
    from litsift.plans.queries import q_labelled_articles
    plan = _plan(q_labelled_articles(spark, SF).unpersist())
    for kind in ("LeftSemi", "Inner"):
        assert "BroadcastHashJoin" in plan and kind in plan


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_top_k_per_class_limits_before_shuffle(spark):
    from litsift.plans.queries import q_head_per_class
    assert "WindowGroupLimit" in _plan(q_head_per_class(spark, SF))


def test_group_values_and_scalars_are_constants(spark):
    from litsift.operators.scalars import with_group_values, with_scalars
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id") % 7))
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = with_group_values(df, sizes, ["k"])
    assert "Join" not in _plan(out) and "Exchange" not in _plan(out)
    assert {(r.k, r.n) for r in out.collect()} == {(r.k, r.n) for r in sizes.collect()}
    many = df.withColumn("k", F.col("id")).select("k")
    assert with_group_values(many, many.withColumn("n", F.lit(1)), ["k"]).count() == 1000
    one = spark.range(5).agg(F.count(F.lit(1)).alias("n"))
    out = with_scalars(spark.range(3), one)
    assert [r["n"] for r in out.collect()] == [5, 5, 5]
    assert "CartesianProduct" not in _plan(out) and "NestedLoop" not in _plan(out)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_no_shuffle_on_class_or_model(spark):
    from litsift.plans import queries as q
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (q.q_stratified_split, q.q_prefix_split, q.q_balance_classes, q.q_roc_curve):
            plan = _plan(query(spark, SF))
            # a key of a few values alone; [Model, _pid] is split into slices
            joins = re.findall(r"SortMergeJoin \[(?:class|Model)#\d+\],.*", plan)
            assert not joins, joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
