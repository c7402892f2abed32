"""Edge cases and invariants of the analytical operators."""

import datetime as dt
import math

import pytest
from conftest import payment, rows

from paytally.operators import (
    behavior, cashback, channel, churn, clv, cohort, geo, kpi, measures, merchant, retry, rfm,
)
from paytally.sources.readers import values


@pytest.fixture(scope="module")
def gap(facts):
    """January, February and April; nobody pays in March."""
    return facts(
        payment(1, "2025-01-05", 1), payment(2, "2025-01-06", 2), payment(3, "2025-02-01", 1),
        payment(4, "2025-04-10", 1), payment(5, "2025-04-11", 3, amount="300.00"),
        payment(6, "2025-04-12", 4, status="FAILED"),
    )


def test_lag_skips_a_missing_month_but_the_calendar_does_not(gap):
    by_lag = rows(kpi.mom_growth(gap), "month")
    assert list(by_lag) == ["2025-01", "2025-02", "2025-04"]
    assert by_lag["2025-04"]["gmv_mom_pct"] == 300.0 and by_lag["2025-01"]["gmv_mom_pct"] is None
    assert by_lag["2025-02"]["mau_mom_pct"] == -50.0
    by_calendar = rows(measures.prev_month(gap), "month")
    assert by_calendar["2025-04"]["gmv_mom_pct"] is None
    assert by_calendar["2025-02"]["gmv_mom_pct"] == -50.0


def test_zero_cashback_gives_null_ratios(facts):
    f = facts(payment(1, "2025-01-01", cashback="0.00", fee="0.00"))
    row = rows(cashback.summary(f))[0]
    assert row["gmv_per_cashback_rupee"] is None and row["cashback_as_pct_of_gmv"] == 0
    assert rows(measures.cashback(f))[0]["gmv_per_cashback_rupee"] == 0  # measures show 0
    assert rows(measures.base(f))[0]["efficiency_ratio"] == 0


def test_failed_only_customer_is_not_a_user(gap):
    assert rows(kpi.gmv_summary(gap))[0]["unique_customers"] == 3
    assert {r["customer_id"] for r in rows(churn.activity(gap))} == {1, 2, 3}


def test_retention_counts_and_empty_offsets(gap):
    got = rows(cohort.retention(gap), "cohort_month", "months_since_cohort")
    assert got[("2025-01", 0)]["retention_pct"] == 100 and got[("2025-01", 0)]["cohort_size"] == 2
    assert got[("2025-01", 1)]["retained_users"] == 1 and got[("2025-01", 3)]["retention_pct"] == 50
    assert ("2025-01", 2) not in got
    wide = rows(cohort.milestones(gap), "cohort_month")
    assert wide["2025-01"]["month1_retention_pct"] == 50 and wide["2025-01"]["month6_retention_pct"] is None
    filled = rows(cohort.milestones(gap, {"month6": 6}, fill=0), "cohort_month")
    assert filled["2025-04"]["month6_retention_pct"] == 0
    assert rows(cohort.matrix(gap), "cohort_month")["2025-01"]["month_2"] == 0
    assert sum(r["cohort_size"] for r in rows(cohort.sizes(gap))) == 3


def test_new_and_returning(facts):
    f = facts(payment(1, "2025-01-05", 1), payment(2, "2025-01-06", 1), payment(3, "2025-02-01", 1),
              payment(4, "2025-02-02", 2), payment(5, "2025-02-03", 2))
    users = rows(behavior.new_returning(f), "month")
    assert (users["2025-02"]["new_users"], users["2025-02"]["returning_users"]) == (1, 1)
    txns = rows(behavior.new_returning(f, "txns"), "month")
    assert (txns["2025-02"]["new_txns"], txns["2025-02"]["returning_txns"]) == (2, 1)


def test_trailing_users_brute_force(facts):
    days = [("2025-01-01", 1), ("2025-01-10", 1), ("2025-01-10", 2), ("2025-02-20", 1), ("2025-03-01", 3),
            ("2025-01-30", 2), ("2025-01-31", 2), ("2025-02-09", 1)]
    f = facts(*[payment(i, d, c) for i, (d, c) in enumerate(days)])
    got = rows(behavior.trailing_users(f, 30), "date")
    assert max(got) == dt.date(2025, 3, 31)
    for date, row in got.items():
        first = date - dt.timedelta(days=29)
        want = {c for d, c in days if first <= dt.date.fromisoformat(d) <= date}
        assert row["users"] == len(want), date


def test_stickiness_uses_active_days(facts):
    f = facts(payment(1, "2025-01-01", 1), payment(2, "2025-01-01", 2), payment(3, "2025-01-02", 1),
              payment(4, "2025-01-02", 1))
    row = rows(behavior.stickiness(f))[0]
    assert (row["avg_dau"], row["mau"], row["stickiness_pct"]) == (1.5, 2, 75.0)


def test_shares_sum_to_hundred(spark, facts):
    f = facts(*[payment(i, "2025-01-01", i, channel=i % 3 + 1, city=i % 2 + 1, amount=f"{i + 1}.37",
                        merchant=i % 4, retry=i % 3) for i in range(24)])
    ch = values(spark, [(1, "UPI"), (2, "CARD"), (3, "WALLET")], "channel_id int, channel_name string")
    ci = values(spark, [(1, "A", "S", "Tier-1"), (2, "B", "S", "Tier-2")],
                "city_id int, city_name string, state string, tier string")
    me = values(spark, [(i, f"c{i % 2}", f"m{i}", 1) for i in range(4)],
                "merchant_id int, category string, merchant_name string, city_id int")
    for df, c in ((channel.mix(f, ch), "gmv_share_pct"), (channel.mix(f, ch), "txn_share_pct"),
                  (geo.tier(f, ci), "gmv_share_pct"), (merchant.category(f, me), "gmv_share_pct"),
                  (retry.by_count(f), "pct_of_total")):
        assert sum(r[c] for r in rows(df)) == pytest.approx(100, abs=0.02)
    within = rows(geo.channel_tier(f, ci, ch))
    for tier in ("Tier-1", "Tier-2"):
        assert sum(r["channel_pct_within_tier"] for r in within if r["tier"] == tier) == pytest.approx(
            100, abs=0.02)
    total = rows(kpi.gmv_summary(f))[0]["total_gmv"]
    assert sum(r["gmv"] for r in rows(channel.mix(f, ch))) == pytest.approx(total)
    assert sum(r["gmv"] for r in rows(merchant.top(f, me, ci, 10))) == pytest.approx(total)


@pytest.mark.parametrize("scheme", ["ntile4", "qcut4", "ntile5", "qcut5", "kth4"])
def test_segments_partition_the_customers(facts, scheme):
    f = facts(*[payment(100 * c + i, f"2025-{1 + (c * 7) % 12:02d}-{1 + i:02d}", c, amount=f"{10 + c % 5}.00")
                for c in range(1, 24) for i in range(1 + c % 4)])
    segments = rfm.segment(rfm.base(f), scheme)
    assert sum(r["customer_count"] for r in rows(rfm.summary(segments))) == 23
    k = 5 if scheme.endswith("5") else 4
    assert all(1 <= r[s] <= k for r in rows(segments) for s in ("r_score", "f_score", "m_score"))


def test_equal_customers_score_alike_under_thresholds(facts):
    f = facts(*[payment(c, "2025-01-01", c) for c in range(8)])
    kth = rows(rfm.segment(rfm.base(f, "2025-02-01"), "kth4"))
    assert {(r["r_score"], r["f_score"], r["m_score"]) for r in kth} == {(4, 4, 4)}
    tiles = rows(rfm.segment(rfm.base(f, "2025-02-01"), "ntile4"))
    assert sorted(r["m_score"] for r in tiles) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_snapshots_compare(spark):
    a = values(spark, [("Champions", 3), ("Lost", 1)], "segment string, user_count int")
    b = values(spark, [("Champions", 1), ("New", 2)], "segment string, user_count int")
    got = {k: r["change"] for k, r in rows(rfm.compare_snapshots(a, b), "segment").items()}
    assert got == {"Champions": -2, "Lost": -1, "New": 2}


def test_lorenz_ends_at_hundred(facts):
    f = facts(*[payment(c, "2025-01-01", c, amount=f"{c * c}.00") for c in range(1, 38)])
    curve = rows(clv.lorenz(f, points=10))
    assert len(curve) == 10 and curve[-1]["cumulative_revenue_pct"] == 100
    assert all(r["cumulative_revenue_pct"] <= r["cumulative_customers_pct"] for r in curve)
    pareto = rows(clv.lorenz(f, points=10, desc=True))
    assert all(r["cumulative_revenue_pct"] >= r["cumulative_customers_pct"] for r in pareto)


def test_top_share_uses_whole_customers(facts):
    f = facts(*[payment(c, "2025-01-01", c, amount=f"{c}00.00", cashback="0.00", fee="0.00")
                for c in range(1, 12)])
    got = rows(clv.top_share(f), "top_pct")
    assert got[10.0]["customers"] == 1 and got[20.0]["customers"] == 2
    assert got[10.0]["revenue_share_pct"] == pytest.approx(11 / 66 * 100, abs=0.01)


def test_funnel_reindexes_missing_labels(facts):
    f = facts(payment(1, "2025-01-01", 1), payment(2, "2025-12-01", 2))
    full = rows(churn.funnel(f, "2025-12-31", "E", reindex=True), "churn_risk")
    assert [full[x]["customer_count"] for x in ("Churned", "High Risk", "Medium Risk", "Active", "Low Risk")
            ] == [1, 0, 0, 0, 1]
    assert {r["churn_risk"] for r in rows(churn.funnel(f, "2025-12-31", "E"))} == {"Churned", "Low Risk"}


def test_counters_can_follow_the_last_date_of_any_status(facts):
    f = facts(payment(1, "2025-01-01", 1), payment(2, "2025-03-15", 1), payment(3, "2025-06-30", 2, status="FAILED"))
    by_success = rows(churn.activity(f))[0]
    by_all = rows(churn.activity(f, counters="all"))[0]
    assert (by_success["txn_last_90d"], by_all["txn_last_90d"]) == (2, 0)
    assert by_success["days_inactive"] == by_all["days_inactive"] == 0


def test_ytd_restarts_each_year(facts):
    f = facts(payment(1, "2024-12-31"), payment(2, "2025-01-01"), payment(3, "2025-01-03"))
    got = rows(measures.ytd(f), "txn_date")
    assert [got[d]["gmv_ytd"] for d in sorted(got)] == [100, 100, 200]


def test_rounding_is_decimal_like(spark):
    from paytally.functions.expr import ratio
    df = values(spark, [("675823.47", 14)], "a string, n int").selectExpr("cast(a as decimal(12,2)) a", "n")
    assert df.select(ratio("a", "n").alias("x")).first()["x"] == 48273.11
    assert math.isclose(675823.47 / 14, 48273.105)
