"""Tests, intervals and scenarios against known values and brute force."""

import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from conftest import payment, rows
from pyspark.sql import functions as F

from paytally.functions.tails import beta_cdf
from paytally.operators import stats, whatif
from paytally.sources.readers import values


def test_chi_square_known_table(spark):
    # 2x2 table 10, 20 / 30, 5 with continuity correction
    counts = values(spark, [(10, 20, 30, 5)], "a int, b int, c int, d int")
    got = rows(stats.chi_square(counts))[0]
    n, gap = 65, abs(10 * 5 - 20 * 30) - 65 / 2
    want = n * gap * gap / (30 * 35 * 40 * 25)
    assert got["chi2"] == pytest.approx(want, abs=1e-6)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)), abs=1e-6)


def test_chi_square_empty_margin_is_null(spark):
    counts = values(spark, [(10, 0, 30, 0)], "a int, b int, c int, d int")
    assert rows(stats.chi_square(counts))[0]["chi2"] is None


def test_student_tail_reference_points():
    # two-sided 5 % points of Student's t
    for df, t in ((1, 12.7062047364), (5, 2.5705818366), (30, 2.0422724563)):
        assert beta_cdf(df / 2, 0.5, df / (df + t * t)) == pytest.approx(0.05, abs=1e-9)


def test_welch_and_cohens_d(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8]
    df = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b], "g boolean, x double")
    got = rows(stats.welch(df, F.col("g"), F.col("x")))[0]
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / 5 + vb**2 / 6)
    assert got["t"] == pytest.approx(t, abs=1e-6) and got["df"] == pytest.approx(dof, abs=1e-4)
    assert got["p_value"] == pytest.approx(beta_cdf(dof / 2, 0.5, dof / (dof + t * t)), abs=1e-6)
    d = rows(stats.cohens_d(df, F.col("g"), F.col("x")))[0]
    pooled = math.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2)
    assert d["cohens_d"] == pytest.approx((np.mean(a) - np.mean(b)) / pooled, abs=1e-6)


def test_mann_whitney_with_ties(spark):
    rng = random.Random(3)
    a, b = [rng.randint(0, 6) for _ in range(40)], [rng.randint(1, 8) for _ in range(31)]
    df = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b], "g boolean, x int")
    got = rows(stats.mann_whitney(df, F.col("g"), F.col("x")))[0]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u"] == u
    n, ties = 71, sum(c**3 - c for c in pd.Series(a + b).value_counts())
    sd = math.sqrt(40 * 31 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, 40 * 31 - u) - 40 * 31 / 2 - 0.5) / sd
    assert got["z"] == pytest.approx(z, abs=1e-6)
    assert got["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


@pytest.fixture(scope="module")
def sample(facts):
    rng = random.Random(11)
    return facts(*[
        payment(i, "2025-01-01", i % 60, amount=f"{rng.lognormvariate(5, 0.6):.2f}",
                mdr=f"{rng.uniform(0.5, 2.5):.4f}", cashback=f"{rng.uniform(0, 1):.2f}")
        for i in range(1500)
    ])


def test_bootstrap_is_reproducible_under_any_partitioning(sample):
    one = rows(stats.bootstrap_margin(sample.repartition(1), replicates=200, units=256))
    many = rows(stats.bootstrap_margin(sample.repartition(7), replicates=200, units=256))
    assert one == many
    other = rows(stats.bootstrap_margin(sample, replicates=200, units=256, seed=7))
    assert other != one


def test_bootstrap_band_is_that_of_row_resampling(sample):
    pdf = sample.selectExpr(
        "cast(amount as double) a",
        "cast(mdr_pct*amount*0.01 - cashback_amt - processing_fee_amt as double) n").toPandas()
    rng = np.random.default_rng(0)
    draws = [rng.integers(0, len(pdf), len(pdf)) for _ in range(1500)]
    ratios = [pdf.n.values[i].sum() / pdf.a.values[i].sum() * 100 for i in draws]
    low, high = np.percentile(ratios, [2.5, 97.5])
    got = rows(stats.bootstrap_margin(sample, replicates=1500, units=4096))[0]
    assert got["ci_low"] < got["observed"] < got["ci_high"]
    assert got["ci_high"] - got["ci_low"] == pytest.approx(high - low, rel=0.12)


def test_bootstrap_skips_small_groups(spark, facts):
    f = facts(*[payment(i, "2025-01-01", channel=1 if i else 2, amount=f"{10 + i}.00") for i in range(120)])
    ch = values(spark, [(1, "UPI"), (2, "CARD")], "channel_id int, channel_name string")
    got = rows(stats.bootstrap_channel_margin(f, ch, replicates=51, units=64))
    assert [r["channel_name"] for r in got] == ["UPI"]


def test_poisson_weights_have_unit_mean_and_variance(spark):
    u = spark.range(20000).select(stats.poisson_weight(stats._number(stats._digest(1, "id"), F.lit(3))).alias("w"))
    mean, var = u.agg(F.avg("w"), F.var_samp("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)


def test_experiment_lets_a_customer_be_in_both_groups(facts):
    f = facts(
        payment(1, "2025-06-01", 1, cashback="0.00"), payment(2, "2025-06-02", 1, cashback="1.00"),
        payment(3, "2025-07-02", 1), payment(4, "2025-06-09", 2, cashback="0.00"),
        payment(5, "2025-08-09", 3), payment(6, "2025-10-01", 2),
    )
    got = {k[0]: (r["customers"], r["repeaters"]) for k, r in
           rows(stats.repeat_experiment(f, "2025-06-01", "2025-09-30"), "grp").items()}
    assert got == {"A": (2, 1), "B": (1, 1)}


def test_moments_match_pandas(sample):
    x = sample.selectExpr("cast(amount as double) x").toPandas().x
    got = rows(stats.describe(sample))[0]
    assert got["skew"] == pytest.approx(x.skew(), abs=1e-5)
    assert got["kurt"] == pytest.approx(x.kurt(), abs=1e-5)
    assert got["std"] == pytest.approx(x.std(), abs=1e-4)
    pct = rows(stats.percentiles(sample))[0]
    assert pct["p95"] == pytest.approx(np.percentile(x, 95), abs=0.006)


def test_histogram_keeps_empty_bins_and_the_maximum(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "x double")
    got = rows(stats.histogram(df, "x", 5))
    assert [r["count"] for r in got] == [2, 0, 0, 0, 1]
    same = rows(stats.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 2))
    assert [r["count"] for r in same] == [4, 0]


def test_clip_and_trim(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert df.count() == stats.clip_at(df, "x", 0.95).count()
    assert stats.clip_at(df, "x", 0.95).agg(F.max("x")).first()[0] == 95
    assert stats.trim_above(df, "x", 0.99).count() == 99


# --- scenarios against published rows: five base totals determine every row -------------------------

PUBLISHED = [("14270055.81", "235659.812817", "161163.72", "31964.59", "42531.502817")]


@pytest.fixture()
def published(spark, monkeypatch):
    frame = spark.createDataFrame(
        [tuple(Decimal(v) for v in PUBLISHED[0])],
        "gmv decimal(24,2), mdr_income decimal(26,8), cashback decimal(24,5), cost decimal(24,3), "
        "net_revenue decimal(26,8)")
    monkeypatch.setattr(whatif, "base", lambda f: frame)
    return frame


def test_elasticity_grid_matches_published_rows(published):
    got = rows(whatif.elasticity_grid(published), "cashback_reduction_pct", "mdr_increase_pct")
    assert len(got) == 44
    assert got[(0, 0.0)]["projected_net_revenue"] == 42531.5
    assert got[(0, 0.25)]["projected_net_revenue"] == 78206.64
    assert got[(0, 0.25)]["projected_margin_pct"] == 0.548 and got[(0, 0.25)]["revenue_uplift"] == 35675.14


def test_mdr_ladder_matches_published_rows(published):
    got = rows(whatif.mdr_ladder(published), "mdr_increase_pct")
    assert got[0.1]["new_net_revenue"] == pytest.approx(56801.558627, abs=1e-4)
    assert got[0.1]["uplift"] == pytest.approx(14270.05581, abs=1e-4)


def test_sensitivity_band_is_close_to_the_simulated_one(published):
    got = rows(whatif.sensitivity(published), "reduction_pct")
    assert got[5]["proj_gmv"] == pytest.approx(14056004.97, abs=0.01)
    assert got[5]["proj_net_revenue"] == pytest.approx(47530.73, abs=100)
    assert got[5]["ci_lower"] == pytest.approx(46720.33, abs=100)
    assert got[5]["ci_upper"] == pytest.approx(48349.19, abs=100)
    assert got[0]["p_better_than_base"] == 0 and got[5]["p_better_than_base"] == 1
    assert rows(whatif.best_cut(whatif.sensitivity(published)))[0]["best_reduction_pct"] == 50


def test_base_scenario_equals_revenue_summary(sample):
    from paytally.operators import kpi
    base = rows(whatif.scenarios(sample, whatif.scenario_frame(sample.sparkSession, whatif.FULL)))[0]
    row = rows(kpi.revenue_summary(sample))[0]
    assert base["net_revenue"] == row["net_revenue"] and base["margin_pct"] == row["margin_pct"]
    assert base["revenue_uplift"] == 0
