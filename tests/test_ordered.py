"""Exact order statistics against brute force, with ties, a hot value and awkward sizes."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paytally.functions.ordered import (
    by_ntile, by_rank_bin, by_rank_share, checkpointed, in_ranges, kth_values, percentiles,
    running_sums, tiled,
)


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x long")


def expected_ntile(values, k, desc=False):
    order = sorted(range(len(values)), key=lambda i: (-values[i] if desc else values[i], i))
    q, extra = divmod(len(values), k)
    tiles, at = {}, 0
    for t in range(1, k + 1):
        size = q + (1 if t <= extra else 0)
        for i in order[at:at + size]:
            tiles[i] = t
        at += size
    return tiles


HOT = [7] * 40 + list(range(50)) + [3] * 9  # two fifths of the rows share one value


@pytest.mark.parametrize("n", [1, 3, 10, 13, 99])
@pytest.mark.parametrize("k", [4, 5, 10])
def test_ntile_matches_brute_force(spark, n, k):
    values = HOT[:n]
    random.Random(n * k).shuffle(values)
    got = rows(tiled(frame(spark, values), "id", up=by_ntile("x", k), down=by_ntile("x", k, True)), "id")
    assert {i: r["up"] for i, r in got.items()} == expected_ntile(values, k)
    assert {i: r["down"] for i, r in got.items()} == expected_ntile(values, k, True)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40))
def test_ntile_property(spark, values):
    got = rows(tiled(frame(spark, values), "id", t=by_ntile("x", 4)), "id")
    assert {i: r["t"] for i, r in got.items()} == expected_ntile(values, 4)


@pytest.mark.parametrize("n", [4, 10, 11])
def test_rank_bins_have_right_closed_edges(spark, n):
    values = HOT[:n][::-1]
    got = rows(tiled(frame(spark, values), "id", b=by_rank_bin("x", 4)), "id")
    order = sorted(range(n), key=lambda i: (values[i], i))
    for rank, i in enumerate(order, 1):
        edges = [1 + (n - 1) * t / 4 for t in range(1, 4)]
        assert got[i]["b"] == 1 + sum(rank > e for e in edges)
    if n == 10:  # sizes differ from NTILE's 3, 3, 2, 2
        assert [sum(r["b"] == b for r in got.values()) for b in range(1, 5)] == [3, 2, 2, 3]


def test_rank_shares_and_empty_first_tier(spark):
    got = rows(tiled(frame(spark, list(range(9))), "id", t=by_rank_share("x", ["0.10", "0.50"])), "id")
    assert sorted(r["t"] for r in got.values()) == [2] * 4 + [3] * 5  # floor(0.9) = 0 rows on top
    assert got[8]["t"] == 2 and got[4]["t"] == 3


def test_kth_values_skip_floor_rows(spark):
    df = frame(spark, HOT)
    n = len(HOT)
    got = rows(kth_values(df, ["x", "id"], {"a": "0.25", "b": "0.75"}))[0]
    assert got["x_a"] == sorted(HOT)[math.floor(n * 0.25)]
    assert got["x_b"] == sorted(HOT)[math.floor(n * 0.75)]
    assert got["id_b"] == math.floor(n * 0.75)


def test_percentiles_by_group_with_nulls(spark):
    data = [("a", v) for v in HOT] + [("b", 5), ("b", 8), ("b", None), ("c", None)]
    df = spark.createDataFrame(data, "g string, x long")
    got = rows(percentiles(df, "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, by=["g"]), "g")
    assert set(got) == {"a", "b"}
    for name, p in (("p10", 10), ("p50", 50), ("p90", 90)):
        assert got["a"][name] == pytest.approx(np.percentile(HOT, p))
        assert got["b"][name] == pytest.approx(np.percentile([5, 8], p))


def test_running_sums_follow_the_global_order(spark):
    df = frame(spark, HOT).withColumn("one", F.lit(1))
    got = rows(running_sums(in_ranges(df, "x", "id"), ["x", "id"], rank="one", total="x"), "id")
    total = 0
    for rank, i in enumerate(sorted(range(len(HOT)), key=lambda i: (HOT[i], i)), 1):
        total += HOT[i]
        assert (got[i]["rank_upto"], got[i]["total_upto"]) == (rank, total)


def test_no_single_partition_window_over_rows(spark):
    """The plan may gather range totals and cuts in one task, never the rows."""
    parts = in_ranges(frame(spark, HOT), "x", "id")
    plan = running_sums(parts, ["x", "id"], s="x")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan


def test_checkpoint_uses_the_session_folder(spark):
    kept = checkpointed(frame(spark, [1, 2]))
    assert spark.sparkContext.getCheckpointDir() is not None
    assert "ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [[None, None, 1, 2, 3, 4], [None] * 5, [3, None, 3, 1, None, 3, 2], [None] * 30 + HOT])
@pytest.mark.parametrize("desc", [False, True])
def test_ntile_of_nulls_is_that_of_sql(spark, values, desc):
    df = frame(spark, values)
    side = "DESC NULLS LAST" if desc else "ASC NULLS FIRST"
    want = rows(df.selectExpr("id", f"ntile(3) OVER (ORDER BY x {side}, id) AS t"), "id")
    assert rows(tiled(df, "id", t=by_ntile("x", 3, desc)).select("id", "t"), "id") == want
