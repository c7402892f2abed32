"""Extracts, result pack and behaviour without broadcasts."""

import os

import pytest
from conftest import payment, rows

from paytally.operators import channel, geo, merchant, quality
from paytally.plans import export
from paytally.sources.readers import calendar, values


@pytest.fixture(scope="module")
def star(spark, facts):
    return {
        "dim_date": calendar(spark, "2025-01-01", "2025-12-31"),
        "dim_channel": values(spark, [(1, "UPI"), (2, "CARD")], "channel_id int, channel_name string"),
        "dim_city": values(spark, [(1, "A", "S", "Tier-1"), (2, "B", "T", "Tier-2")],
                           "city_id int, city_name string, state string, tier string"),
        "dim_customer": values(spark, [(i, 1 + i % 2, "A") for i in range(20)],
                               "customer_id int, city_id int, segment_tag string"),
        "dim_merchant": values(spark, [(1, "Food", "M1", 1), (2, "Fuel", "M2", 2)],
                               "merchant_id int, category string, merchant_name string, city_id int"),
        "fact_transactions": facts(*[
            payment(i, f"2025-{1 + i % 12:02d}-{1 + i % 27:02d}", i % 20, amount=f"{50 + i * 7 % 90}.25",
                    channel=1 + i % 2, city=1 + i % 2, merchant=1 + i % 2,
                    status="FAILED" if i % 11 == 0 else "SUCCESS")
            for i in range(120)
        ]),
    }


def test_export_all_writes_every_extract(spark, star, tmp_path):
    names = export.export_all(star, str(tmp_path), "csv")
    assert len([n for n in names if n[:2].isdigit()]) == 12
    for name in names:
        assert os.path.exists(tmp_path / name / "_SUCCESS"), name
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() > 0, name
    monthly = spark.read.option("header", True).csv(f"{tmp_path}/01_monthly_kpi").columns
    assert monthly == ["txn_month", "txn_count", "gmv", "gross_mdr_rev", "cashback_cost",
                       "processing_cost", "net_revenue", "mau", "margin_pct", "gmv_mom_growth_pct",
                       "rev_mom_growth_pct", "mau_mom_growth_pct"]


def test_pack_round_trip(spark, star, tmp_path):
    pack = export.kpi_pack(star)
    assert len(pack) == 8
    few = {k: pack[k] for k in ("gmv_summary", "whatif_scenarios")}
    export.write_pack(few, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/whatif_scenarios").count() == 6


def test_dimensions_beyond_the_broadcast_threshold(spark, star):
    """The same answers when no dimension may be broadcast."""
    f = star["fact_transactions"]

    def answers():
        return [rows(df) for df in (
            channel.mix(f, star["dim_channel"]), geo.state(f, star["dim_city"]),
            merchant.category(f, star["dim_merchant"]), quality.orphans(f, star))]

    before = answers()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = channel.mix(f, star["dim_channel"])
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert answers() == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
