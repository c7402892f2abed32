"""Geography: state, city and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, dbl, growth, lookup, money, pct, previous, ratio, share, successful, totals,
)

CITY = ["city_name", "state", "tier"]


def _located(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    return lookup(successful(f), dim_city, "city_id", *CITY)


def state(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    return totals(_located(f, dim_city), "state").select(
        "state",
        "txn_count",
        money("gmv").alias("gmv"),
        money("net").alias("net_revenue"),
        F.col("users").alias("unique_customers"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        share("gmv").alias("gmv_share_pct"),
        F.rank().over(Window.orderBy(F.desc("gmv"))).alias("gmv_rank"),  # one row per state
    ).orderBy(F.desc("gmv"))


def top_cities(f: DataFrame, dim_city: DataFrame, n: int = 20) -> DataFrame:
    cities = totals(_located(f, dim_city), *CITY)
    return cities.orderBy(F.desc("gmv"), *CITY).limit(n).select(
        *CITY,
        "txn_count",
        money("gmv").alias("gmv"),
        F.col("users").alias("unique_customers"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
    )


def tier(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    """Tier summary. ``city_count`` counts the cities with a SUCCESS payment: a set of at most the dimension's
    cities, so that a second distinct count does not multiply the rows."""
    cities = F.size(F.collect_set("city_id")).cast("long").alias("city_count")
    return totals(_located(f, dim_city), "tier", more=(cities,)).select(
        "tier",
        "city_count",
        "txn_count",
        money("gmv").alias("gmv"),
        money("net").alias("net_revenue"),
        F.col("users").alias("unique_customers"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        share("gmv").alias("gmv_share_pct"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy(F.desc("gmv"))


def category_tier(f: DataFrame, dim_city: DataFrame, dim_merchant: DataFrame) -> DataFrame:
    """Merchant category by tier. Rows are added up per merchant and city before the merchant
    dimension, which may be large, is joined."""
    per_merchant = (
        successful(f)
        .groupBy("merchant_id", "city_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("gmv"))
    )
    placed = lookup(per_merchant, dim_city, "city_id", "tier")
    return (
        lookup(placed, dim_merchant, "merchant_id", "category")
        .groupBy("tier", "category")
        .agg(F.sum("n").alias("txn_count"), F.sum("gmv").alias("gmv"))
        .select(
            "tier", "category", "txn_count", money("gmv").alias("gmv"),
            ratio("gmv", "txn_count").alias("avg_txn_value"),
        )
        .orderBy("tier", F.desc("gmv"))
    )


def channel_tier(f: DataFrame, dim_city: DataFrame, dim_channel: DataFrame) -> DataFrame:
    both = lookup(_located(f, dim_city), dim_channel, "channel_id", "channel_name")
    return totals(both, "tier", "channel_name").select(
        "tier", "channel_name", "txn_count", money("gmv").alias("gmv"),
        share("txn_count", "tier").alias("channel_pct_within_tier"),
    ).orderBy("tier", F.desc("txn_count"))


def state_mom(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    months = by_month(_located(f, dim_city), "state").select("state", "month", "gmv")
    return months.select(
        "state", "month", money("gmv").alias("gmv"),
        growth("gmv", previous("gmv", "month", "state")).alias("mom_pct"),
    ).orderBy("state", "month")


def opportunities(
    f: DataFrame, dim_city: DataFrame, min_gmv: int = 50000, k: int = 15
) -> DataFrame:
    """Cities above a GMV threshold with the lowest margin."""
    return (
        totals(_located(f, dim_city), *CITY)
        .filter(F.col("gmv") > min_gmv)
        .select(*CITY, money("gmv").alias("gmv"), pct("net", "gmv", 4).alias("margin_pct"))
        .orderBy("margin_pct", *CITY)
        .limit(k)
    )


def state_tier(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    return totals(_located(f, dim_city), "state", "tier").select(
        "state",
        "tier",
        "txn_count",
        F.col("users").alias("unique_customers"),
        money("gmv").alias("gmv"),
        money("net").alias("net_revenue"),
    ).orderBy(F.desc("gmv"))


def tier_of_top(f: DataFrame, dim_city: DataFrame, k: int = 15) -> DataFrame:
    """Tier GMV of the ``k`` largest state-tier cells only; ``tier`` has the true totals."""
    cells = totals(_located(f, dim_city), "state", "tier")
    top = cells.orderBy(F.desc("gmv"), "state", "tier").limit(k)
    return top.groupBy("tier").agg(F.sum("gmv").alias("gmv")).select(
        "tier", money("gmv").alias("gmv")
    )


def extract(f: DataFrame, dim_city: DataFrame) -> DataFrame:
    """Unrounded state-tier extract with GMV share."""
    return totals(_located(f, dim_city), "state", "tier").select(
        "state",
        "tier",
        "txn_count",
        dbl("gmv").alias("gmv"),
        dbl("net").alias("net_revenue"),
        F.col("users").alias("unique_users"),
        share("gmv", digits=10).alias("gmv_share_pct"),
    )
