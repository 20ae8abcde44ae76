import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litsift.operators import scalars


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.one_of(st.none(), st.integers(0, 40)), min_size=1, max_size=12), st.sampled_from([1, 3, 256]))
def test_same_result_on_both_sides_of_the_limit(spark, groups, limit):
    rows = [(g, i) for g in groups for i in range(3)] + [(99, 0)]
    df = spark.createDataFrame(rows, "g int, x int")
    sums = df.where("g is null or g <> 99").groupBy("g").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    old, scalars.MAX_GROUPS = scalars.MAX_GROUPS, limit
    try:
        got = scalars.with_group_values(df, sums, ["g"]).collect()
    finally:
        scalars.MAX_GROUPS = old
    want = [(g, x, None, None) if g == 99 else (g, x, 3, 3) for g, x in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [100, 300])
def test_null_group_stays(spark, n):
    df = spark.range(n).select(F.col("id").alias("g")).unionByName(spark.createDataFrame([(None,)], "g long"))
    assert scalars.with_group_values(df, df.groupBy("g").count(), ["g"]).filter("count = 1").count() == n + 1
