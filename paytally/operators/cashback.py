"""Cashback economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, dbl, lookup, money, pct, ratio, successful, totals,
)


def summary(f: DataFrame) -> DataFrame:
    return totals(successful(f)).select(
        F.col("txn_count").alias("total_txns"),
        "cashback_txns",
        F.col("no_cashback_txns").alias("txns_without_cashback"),
        pct("cashback_txns", "txn_count").alias("cashback_txn_pct"),
        money("cashback").alias("total_cashback_cost"),
        money("gmv").alias("total_gmv"),
        money("cashback_gmv").alias("cashback_gmv"),
        money("no_cashback_gmv").alias("no_cashback_gmv"),
        pct("cashback", "gmv", 4).alias("cashback_as_pct_of_gmv"),
        ratio("gmv", "cashback").alias("gmv_per_cashback_rupee"),
        ratio("mdr", "cashback").alias("mdr_revenue_per_cashback_rupee"),
        ratio("net", "cashback").alias("net_return_per_cashback_rupee"),
    )


def by_channel(f: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Return on cashback by channel; ``cashback_*`` ratios use payments with cashback only."""
    named = lookup(successful(f), dim_channel, "channel_id", "channel_name")
    return totals(named, "channel_name").select(
        "channel_name",
        F.col("txn_count").alias("total_txns"),
        "cashback_txns",
        pct("cashback_txns", "txn_count").alias("cashback_txn_pct"),
        money("gmv").alias("gmv"),
        money("cashback").alias("total_cashback"),
        money("cashback_gmv").alias("cashback_gmv"),
        ratio("gmv", "cashback").alias("gmv_per_cashback_rupee"),
        pct("cashback", "gmv", 4).alias("cashback_rate_pct"),
        ratio("cashback_gmv", "cashback").alias("cashback_gmv_per_rupee"),
        pct("cashback", "cashback_gmv", 4).alias("cashback_gmv_rate_pct"),
        money("net").alias("net_revenue"),
    ).orderBy(F.desc("total_cashback"))


def monthly(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select(
        "month",
        money("cashback").alias("total_cashback"),
        money("gmv").alias("gmv"),
        pct("cashback", "gmv", 4).alias("cashback_rate_pct"),
        money("fee").alias("processing_cost"),
        money("mdr").alias("mdr_income"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
        ratio("gmv", "cashback").alias("gmv_per_cashback_rupee"),
    ).orderBy("month")


def txn_groups(f: DataFrame) -> DataFrame:
    """Payments with and without cashback."""
    group = F.when(F.col("cashback_amt") > 0, "With Cashback").otherwise("Without Cashback")
    return totals(successful(f), group.alias("cashback_group")).select(
        "cashback_group",
        F.col("users").alias("unique_users"),
        "txn_count",
        money("gmv").alias("total_gmv"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        ratio("gmv", "users").alias("gmv_per_customer"),
        ratio("txn_count", "users").alias("avg_txns_per_user"),
    )


def customer_groups(f: DataFrame) -> DataFrame:
    """Customers who ever received cashback against those who never did."""
    customers = successful(f).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("txns"),
        F.sum("amount").alias("spend"),
        F.sum("cashback_amt").alias("cashback"),
    )
    group = F.when(F.col("cashback") > 0, "Received Cashback").otherwise("No Cashback")
    return (
        customers.groupBy(group.alias("cashback_group"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("spend").alias("spend"),
            F.sum("txns").alias("txns"),
            F.sum("cashback").alias("cashback"),
        )
        .select(
            "cashback_group",
            "customer_count",
            ratio("spend", "customer_count").alias("avg_spend_per_customer"),
            ratio("txns", "customer_count").alias("avg_txns_per_customer"),
            ratio("cashback", "customer_count", 4).alias("avg_cashback_received"),
        )
    )


def roi_extract(f: DataFrame) -> DataFrame:
    """Unrounded monthly cashback extract."""
    return by_month(successful(f)).select(
        F.col("month").alias("txn_month"),
        dbl("gmv").alias("gmv"),
        dbl("cashback").alias("cashback_cost"),
        dbl("net").alias("net_revenue"),
        ratio("gmv", "cashback", 10).alias("gmv_per_cashback"),
        pct("cashback", "gmv", 10).alias("cashback_as_pct_gmv"),
    ).orderBy("txn_month")
