"""Bands, radix selection, activity masks, measure lattices and bucketed facts on small frames."""

import math
import random

import numpy as np
import pytest
from conftest import payment, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paytally.functions import select
from paytally.operators import bands, cohort, etl, kpi, measures, quality, rfm, stats
from paytally.sources import schemas


# --- bands -------------------------------------------------------------------------------------

def some_payments(n, seed=1):
    rng = random.Random(seed)
    return [payment(i, f"2025-0{1 + i % 6}-1{i % 9}", customer=i % 40, amount=f"{rng.lognormvariate(5, 1):.2f}",
                    mdr=f"{rng.uniform(0.5, 3):.4f}", cashback=f"{rng.uniform(0, 2):.2f}", fee=f"{rng.uniform(0, 1):.2f}",
                    channel=1 + i % 3) for i in range(n)]


def test_margin_band_equals_row_wise_residuals(facts):
    f = facts(*some_payments(400))
    got = rows(bands.margin_band(f))[0]
    x = np.array([[float(r["mdr_pct"]) * float(r["amount"]) / 100 - float(r["cashback_amt"]) - float(r["processing_fee_amt"]),
                   float(r["amount"])] for r in rows(f)])
    r = x[:, 0].sum() / x[:, 1].sum()
    width = bands._z(0.95) * math.sqrt(((x[:, 0] - r * x[:, 1]) ** 2).sum()) / x[:, 1].sum()
    assert got["observed"] == pytest.approx(100 * r, abs=1e-4)
    assert [got["ci_low"], got["ci_high"]] == pytest.approx([100 * (r - width), 100 * (r + width)], abs=1e-4)


def test_band_agrees_with_row_wise_resampling(spark, facts):
    f = facts(*some_payments(600))
    sums = {"num": F.col("cashback_amt"), "den": F.col("amount")}
    reps = bands.poisson_replicates(f.repartition(5), sums, 800)
    again = bands.poisson_replicates(f.coalesce(1), sums, 800)
    a, b = rows(reps, "replicate"), rows(again, "replicate")
    assert a.keys() == b.keys() == set(range(1, 801))
    assert all(a[k]["num"] == pytest.approx(b[k]["num"]) and a[k]["n"] == b[k]["n"] for k in a)
    drawn = np.array([r["num"] / r["den"] for r in a.values()])
    band = rows(bands.ratio_band(f, F.col("cashback_amt"), F.col("amount"), scale=1e4))[0]
    spread = (band["ci_high"] - band["ci_low"]) / 2 / bands._z(0.95) / 1e4
    assert drawn.std() == pytest.approx(spread, rel=0.12)
    assert np.mean([r["n"] for r in a.values()]) == pytest.approx(600, rel=0.01)


def test_poisson_weights():
    w = bands.poisson_weights(np.arange(2_000, dtype=np.uint64), 200, 7)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08
    assert [(w == k).mean() for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.005)


def test_bands_of_few_rows(facts):
    assert rows(bands.margin_band(facts())) == [{"n": 0, "observed": None, "ci_low": None, "ci_high": None}]
    one = rows(bands.mean_band(facts(payment(1, "2025-01-01"))))[0]
    assert (one["n"], one["observed"], one["ci_low"]) == (1, 100.0, None)
    plan = bands.margin_band(facts(*some_payments(9)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan


# --- radix selection ---------------------------------------------------------------------------

numbers = st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=True, width=64), st.sampled_from([0.0, -0.0, 5e-324, 1.5]))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(numbers, max_size=30))
def test_any_double_at_any_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    ranks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: i.cast("long"))
    ((n, found),) = select.values_at(df, "x", ranks) if known else ((0, {}),)
    assert n == len(known) and [found[i] for i in range(n)] == known


def test_doubles_that_all_differ(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(0, 8, 3_000), -rng.lognormal(0, 3, 1_000), rng.uniform(1, 1 + 1e-12, 500)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(x)], "x double, g int").repartition(6)
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.99, "e": 1.0}
    got = rows(select.percentiles(df, "x", probs))[0]
    assert [got[k] for k in probs] == pytest.approx(np.quantile(x, list(probs.values())).tolist(), rel=1e-15)
    by = rows(select.percentiles(df, "x", probs, by=["g"]), "g")
    for g in range(3):
        assert [by[g][k] for k in probs] == pytest.approx(np.quantile(x[g::3], list(probs.values())).tolist(), rel=1e-15)


def test_percentiles_of_nothing_and_of_decimals(spark, facts):
    assert rows(select.percentiles(facts(), "amount", {"p": 0.5})) == [{"p": None}]
    f = facts(payment(1, "2025-01-01", amount="-3.10"), payment(2, "2025-01-01", amount="7.25"), payment(3, "2025-01-01", amount=None))
    assert rows(select.percentiles(f, "amount", {"p": 0.5, "q": 1.0})) == [{"p": pytest.approx(2.075), "q": 7.25}]
    grouped = select.percentiles(f.withColumn("k", F.lit(None).cast("string")), "amount", {"p": 0.0}, by=["k"])
    assert rows(grouped) == [{"k": None, "p": -3.1}]


# --- masks -------------------------------------------------------------------------------------

def test_masks_over_more_months_than_a_long_holds(spark, facts):
    rng = random.Random(8)
    many = [payment(i, f"{1995 + rng.randint(0, 14)}-{rng.randint(1, 12):02d}-05", customer=rng.randint(1, 12),
                    status=rng.choice(["SUCCESS", "SUCCESS", "FAILED"])) for i in range(300)]
    f = facts(*many)
    for months in (11, 130):
        assert rows(cohort.retention_by_masks(f, months)) == rows(cohort.retention(f, months))
    key = lambda r: tuple(r.values())
    assert sorted(rows(cohort.activity_by_masks(f)), key=key) == sorted(rows(cohort.activity(f)), key=key)
    assert cohort.masks(f).count() == f.filter("status = 'SUCCESS'").select("customer_id").distinct().count()
    assert cohort.retention_by_masks(facts()).count() == cohort.activity_by_masks(facts()).count() == 0


# --- lattice -----------------------------------------------------------------------------------

def test_answers_come_from_the_smallest_level(facts):
    f = facts(*some_payments(120), payment(900, "2025-01-01", channel=None))
    dims = ["channel_id", "city_id", "device_os"]
    table = measures.lattice(f, dims)
    assert {r["level"] for r in rows(table)} == set(range(8))
    for filters, by in (({}, []), ({"channel_id": [1, 2]}, []), ({"channel_id": [3]}, ["city_id"]), ({}, ["channel_id", "device_os"]),
                        ({"device_os": ["none"]}, [])):
        where = f
        for c, v in filters.items():
            where = where.filter(F.col(c).isin(*v))
        key = lambda r: str(tuple(r.values()))
        assert sorted(rows(measures.answer(table, dims, filters, by)), key=key) == sorted(rows(measures.base(where, by)), key=key)
    kept = [{"channel_id", "city_id"}, {"channel_id", "city_id", "device_os"}]
    part = measures.lattice(f, dims, kept)
    assert rows(measures.answer(part, dims, {"city_id": [1]}, levels=kept)) == rows(measures.base(f.filter("city_id = 1")))
    with pytest.raises(ValueError):
        measures.answer(part, dims, {"customer_id": [1]}, levels=kept)


# --- bucketed fact -----------------------------------------------------------------------------

def test_customers_of_a_bucketed_fact_do_not_move(spark, facts, tmp_path):
    f = facts(*some_payments(200))
    spark.sql("drop table if exists fact_b")
    table = etl.save_by_customer(f, "fact_b", str(tmp_path / "b"), 4)
    try:
        plan = rfm.base(table, "2025-07-01")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" not in plan
        assert "hashpartitioning(customer_id" in rfm.base(f, "2025-07-01")._jdf.queryExecution().executedPlan().toString()
        assert rows(rfm.base(table), "customer_id") == rows(rfm.base(f), "customer_id")
    finally:
        spark.sql("drop table fact_b")


# --- checks and totals -------------------------------------------------------------------------

def test_orphans_of_an_empty_fact(spark, facts):
    star = {n: spark.createDataFrame([], s) for n, s in schemas.STAR.items()}
    got = rows(quality.orphans(facts(), star), "issue")
    assert {k: r["orphan_count"] for k, r in got.items()} == {
        f"missing_{k}": 0 for k in ("customer", "merchant", "channel", "city", "date")}
    found = rows(quality.orphans(facts(payment(1, "2025-01-01", customer=None), payment(2, "2025-01-01")), star), "issue")
    assert all(r["orphan_count"] == 2 for r in found.values())


def test_totals_without_distinct_aggregates(facts):
    f = facts(payment(1, "2025-01-01", customer=1, merchant=5), payment(2, "2025-01-01", customer=None, merchant=5),
              payment(3, "2025-01-01", customer=2, merchant=6))
    got = rows(kpi.gmv_summary(f))[0]
    assert (got["total_txn_count"], got["unique_customers"], got["unique_merchants"], got["total_gmv"]) == (3, 2, 2, 300.0)
    empty = rows(kpi.gmv_summary(facts()))[0]
    assert (empty["total_txn_count"], empty["unique_customers"], empty["total_gmv"]) == (0, 0, None)
    assert "Expand" not in kpi.gmv_summary(f)._jdf.queryExecution().optimizedPlan().toString()


def test_anderson_darling_with_ties(facts):
    from math import erfc, log, sqrt

    f = facts(*some_payments(150), *[payment(1_000 + i, "2025-01-01", amount="150.00") for i in range(30)])
    x = sorted(float(r["amount"]) for r in rows(f))
    n, mean = len(x), sum(x) / len(x)
    sd = sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
    low = [erfc(-(v - mean) / sd / sqrt(2)) / 2 for v in x]
    a2 = -n - sum((2 * i + 1) * (log(low[i]) + log(1 - low[n - 1 - i])) for i in range(n)) / n
    got = rows(stats.anderson_darling(f))[0]
    assert got["n"] == n and got["anderson_darling"] == pytest.approx(a2, abs=1e-3) and got["rejected"]
    assert rows(stats.anderson_darling(facts()))[0]["anderson_darling"] is None
    assert rows(stats.anderson_darling(facts(payment(1, "2025-01-01"))))[0]["anderson_darling"] is None
