"""Readers, calendar, loading patterns and data quality on hand-made frames."""

import datetime as dt

from conftest import payment, rows

from paytally.operators import etl, quality
from paytally.sources import schemas
from paytally.sources.readers import calendar, normalize_bool, read_star, save_table, values


def test_csv_round_trip_keeps_types(spark, facts, tmp_path):
    star = {
        "dim_date": calendar(spark, "2025-01-01", "2025-01-05", ["01-01"]),
        "dim_channel": values(spark, [(1, "UPI")], "channel_id int, channel_name string"),
        "dim_city": values(spark, [(1, "X", "S", "Tier-1")],
                           "city_id int, city_name string, state string, tier string"),
        "dim_customer": spark.createDataFrame(
            [(1, dt.date(2025, 1, 1), dt.date(2025, 1, 2), 1, "A")], schemas.DIM_CUSTOMER),
        "dim_merchant": spark.createDataFrame([(1, "Food", "M", 1)], schemas.DIM_MERCHANT),
        "fact_transactions": facts(payment(1, "2025-01-02"), payment(2, "2025-01-03", status="FAILED")),
    }
    for name, df in star.items():
        save_table(df, f"{tmp_path}/{name}", fmt="csv")
    back = read_star(spark, str(tmp_path), "csv")
    assert list(back) == list(schemas.STAR)
    for name, df in back.items():
        assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.STAR[name]]
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, star[name].collect()))


def test_flag_text(spark):
    df = spark.createDataFrame([("True",), ("False",), (None,)], "flag string")
    assert [r["flag"] for r in rows(normalize_bool(df, ["flag"]))] == [True, False, None]


def test_calendar_week_weekend_holiday(spark):
    got = rows(calendar(spark, "2025-12-27", "2026-01-01", ["12-31"]), "date")
    assert got[dt.date(2025, 12, 27)]["is_weekend"] and not got[dt.date(2025, 12, 29)]["is_weekend"]
    assert got[dt.date(2025, 12, 31)]["week_of_year"] == 1  # ISO week
    assert [d.day for d, r in got.items() if r["holiday_flag"]] == [31]


def test_append_takes_only_newer_unseen_rows(facts):
    old = facts(payment(1, "2025-01-01"), payment(2, "2025-01-05"))
    staging = facts(payment(3, "2025-01-05"), payment(4, "2025-01-06"), payment(2, "2025-01-07"))
    assert sorted(r["transaction_id"] for r in rows(etl.new_rows(old, staging))) == [4]
    assert etl.incremental_append(old, staging).count() == 3


def test_append_into_empty_table(facts):
    assert etl.incremental_append(facts(), facts(payment(1, "2025-01-01"))).count() == 1


def test_refund_upsert_hits_and_misses(facts):
    old = facts(payment(1, "2025-01-01", status="FAILED"), payment(2, "2025-01-02"))
    updates = facts(
        payment(1, "2025-01-01", refunded="40", settled="2025-02-01", status="CHANGED"),
        payment(9, "2025-01-09", refunded="5", amount="77.00"),
    )
    got = rows(etl.upsert_refunds(old, updates), "transaction_id")
    assert float(got[1]["refunded_amt"]) == 40 and got[1]["settlement_date"] == dt.date(2025, 2, 1)
    assert got[1]["status"] == "FAILED"  # other columns keep their stored value
    assert float(got[2]["refunded_amt"]) == 0
    assert float(got[9]["amount"]) == 77 and len(got) == 3


def test_rollup_counts_all_but_sums_success(facts):
    f = facts(payment(1, "2025-01-01", customer=1), payment(2, "2025-01-01", customer=2, status="FAILED"))
    row = rows(etl.daily_rollup(f))[0]
    assert (row["txn_count"], row["success_count"], row["unique_customers"]) == (2, 1, 2)
    assert float(row["gmv"]) == 100 and float(row["net_revenue"]) == 0.85


def test_quality_findings(spark, facts):
    f = facts(
        payment(1, "2025-01-01"), payment(1, "2025-01-01"),
        payment(2, "2025-01-02", amount="0.00", cashback="1.00", settled="2025-01-01"),
        payment(3, "2025-01-03", amount="-5.00", mdr="6.0000", cashback="-1.00"),
        payment(4, "2025-01-04", amount=None, refunded="3"),
        payment(5, "2025-01-05", customer=None, channel=9),
    )
    issues = rows(quality.invalid_amounts(f), "issue")
    assert issues["negative_amount"]["count"] == 1 and issues["zero_amount"]["count"] == 1
    assert issues["negative_cashback"]["count"] == 1 and issues["cashback_exceeds_mdr"]["count"] == 1
    rules = {k: r["n"] for k, r in rows(quality.rule_violations(f), "rule").items()}
    assert rules == {"invalid_amounts": 2, "cashback_exceeds_amount": 2, "high_processing_fee": 2,
                     "invalid_settlement": 1, "refunded_success_txns": 1}
    assert rows(quality.null_counts(f))[0]["null_amount"] == 1
    assert rows(quality.duplicate_ids(f)) == [{"transaction_id": 1, "dup_count": 2}]
    assert rows(quality.duplicate_total(f))[0]["duplicate_txn_ids"] == 1
    assert rows(quality.potential_duplicates(f))[0]["potential_dups"] == 2
    assert rows(quality.mdr_out_of_range(f))[0]["invalid_mdr"] == 1
    star = {
        "dim_customer": values(spark, [(1,)], "customer_id int"),
        "dim_merchant": values(spark, [(1,)], "merchant_id int"),
        "dim_channel": values(spark, [(1,)], "channel_id int"),
        "dim_city": values(spark, [(1,)], "city_id int"),
        "dim_date": calendar(spark, "2025-01-01", "2025-01-03"),
    }
    lost = {k: r["orphan_count"] for k, r in rows(quality.orphans(f, star), "issue").items()}
    assert lost == {"missing_customer": 1, "missing_merchant": 0, "missing_channel": 1,
                    "missing_city": 0, "missing_date": 2}
    assert rows(quality.dates_not_in_dim(f, star["dim_date"]))[0]["fact_dates_not_in_dim"] == 2


def test_outlier_definitions_differ_for_small_samples(facts):
    f = facts(*[payment(i, "2025-01-01", amount="10.00") for i in range(10)],
              payment(99, "2025-01-01", amount="1000.00"))
    assert rows(quality.outliers(f, 3, pop=True))[0]["outlier_count"] == 1
    assert rows(quality.outliers(f, 3, pop=False))[0]["outlier_count"] == 1
    assert rows(quality.outliers(f, 3.05, pop=False))[0]["outlier_count"] == 0
