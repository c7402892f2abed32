"""Joins with a hot key: the same rows as a plain join, dealt evenly."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paytally.functions.skew import heavy_keys, skewed_join

BIG = "a long, b string, x long"
SMALL = "a long, b string, y long"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


key = st.one_of(st.none(), st.integers(0, 3))
text = st.sampled_from([None, "p", "q"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(big=st.lists(st.tuples(key, text, st.integers(0, 5)), max_size=40),
       small=st.lists(st.tuples(key, text, st.integers(0, 5)), max_size=6), how=st.sampled_from(["inner", "left"]))
def test_same_rows_as_a_plain_join(spark, no_broadcast, big, small, how):
    left, right = spark.createDataFrame(big, BIG), spark.createDataFrame(small, SMALL)
    got = skewed_join(left, right, ["a", "b"], how, tasks=3, least=2)
    want = left.join(right, ["a", "b"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("hot", [7, None])
def test_a_third_of_the_rows_in_one_key(spark, no_broadcast, hot):
    n = 60_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        k = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(1_000 + F.col("id") % 997)
        big = spark.range(n).select(k.cast("long").alias("k"), F.col("id").alias("x"))
        small = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
        joined = skewed_join(big, small, ["k"], "left", tasks=16, least=100)
        assert joined.count() == n
        assert joined.filter("y is not null and y <> 2 * k").count() == 0
        assert joined.filter("y is null").count() == (n // 3 if hot is None else 0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = big.join(small, ["k"], "left")
        worst = max(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
        assert worst > n / 3 and max(sizes) <= 3 * n / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_heavy_keys_are_few(spark):
    big = spark.range(10_000).select((F.col("id") % 5).alias("k"))
    assert heavy_keys(big, ["k"], 16, least=100).count() == 5
    assert heavy_keys(big, ["k"], 2, least=100).count() == 0
    assert heavy_keys(big.limit(0), ["k"], 4).count() == 0
