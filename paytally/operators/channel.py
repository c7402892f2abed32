"""Channel, device and acquirer analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, dbl, growth, lookup, money, pct, previous, ratio, rnd, safe_div, share, successful,
    totals,
)

NAME = "channel_name"


def _named(f: DataFrame, dim: DataFrame) -> DataFrame:
    return lookup(f, dim, "channel_id", NAME)


def _paid(f: DataFrame, dim: DataFrame, *more: str) -> DataFrame:
    return totals(_named(successful(f), dim), NAME, *more)


def mix(f: DataFrame, dim: DataFrame) -> DataFrame:
    return _paid(f, dim).select(
        NAME,
        "txn_count",
        money("gmv").alias("gmv"),
        share("txn_count").alias("txn_share_pct"),
        share("gmv").alias("gmv_share_pct"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        F.col("users").alias("unique_users"),
    ).orderBy(F.desc("gmv"))


def monthly(f: DataFrame, dim: DataFrame) -> DataFrame:
    return by_month(_named(successful(f), dim), NAME).select(
        "month", NAME, "txn_count", money("gmv").alias("gmv"), money("net").alias("net_revenue")
    ).orderBy("month", F.desc("gmv"))


def margin(f: DataFrame, dim: DataFrame) -> DataFrame:
    return _paid(f, dim).select(
        NAME,
        money("gmv").alias("gmv"),
        money("mdr").alias("gross_mdr"),
        money("cashback").alias("total_cashback"),
        money("fee").alias("processing_cost"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy(F.desc("margin_pct"))


def above_mean(f: DataFrame, dim: DataFrame) -> DataFrame:
    """Channels above the unweighted mean of the channel margins."""
    margins = margin(f, dim).select(NAME, "margin_pct")
    mean = F.avg("margin_pct").over(Window.partitionBy())  # one row per channel
    return margins.select(
        NAME, "margin_pct", rnd(mean, 4).alias("mean_margin_pct"),
        (F.col("margin_pct") > mean).alias("above_mean"),
    )


def rates(f: DataFrame, dim: DataFrame) -> DataFrame:
    return _paid(f, dim).select(
        NAME,
        ratio("mdr_pct_sum", "txn_count", 4).alias("avg_mdr_pct"),
        ratio("cashback", "txn_count", 4).alias("avg_cashback_per_txn"),
        ratio("fee", "txn_count", 4).alias("avg_processing_per_txn"),
        pct("net", "gmv", 4).alias("net_margin_pct"),
    ).orderBy(F.desc("net_margin_pct"))


def efficiency(f: DataFrame, dim: DataFrame) -> DataFrame:
    """Net revenue per unit of cost."""
    return _paid(f, dim).select(
        NAME,
        "txn_count",
        money("gmv").alias("gmv"),
        money("mdr").alias("gross_mdr_income"),
        money("cashback").alias("cashback_cost"),
        money("fee").alias("processing_cost"),
        money("net").alias("net_revenue"),
        money("cost").alias("total_cost"),
        ratio("net", "cost", 4).alias("efficiency_ratio"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy(F.desc("efficiency_ratio"))


def best_efficiency(f: DataFrame, dim: DataFrame) -> DataFrame:
    """The channel with the highest efficiency ratio."""
    ranked = _paid(f, dim).select(NAME, safe_div("net", "cost").alias("efficiency"))
    return ranked.agg(
        F.max_by(NAME, "efficiency").alias("best_channel"),
        rnd(F.max("efficiency"), 4).alias("efficiency_ratio"),
    )


def fees(f: DataFrame, dim: DataFrame) -> DataFrame:
    return _paid(f, dim).select(
        NAME,
        ratio("fee", "txn_count", 4).alias("avg_processing_fee"),
        money("min_fee", 4).alias("min_processing_fee"),
        money("max_fee", 4).alias("max_processing_fee"),
        "txn_count",
    ).orderBy(F.desc("avg_processing_fee"))


def success(f: DataFrame, dim: DataFrame) -> DataFrame:
    return totals(_named(f, dim), NAME).select(
        NAME,
        F.col("txn_count").alias("total_txns"),
        "success_txns",
        pct("success_txns", "txn_count").alias("success_rate_pct"),
        ratio("success_retries", "success_txns").alias("avg_retries_on_success"),
    ).orderBy(F.desc("success_rate_pct"))


def failures(f: DataFrame, dim: DataFrame) -> DataFrame:
    return totals(_named(f, dim), NAME).select(
        NAME,
        F.col("txn_count").alias("total_txns"),
        "failed_txns",
        pct("failed_txns", "txn_count").alias("failure_rate_pct"),
    ).orderBy(F.desc("failure_rate_pct"))


def mom(f: DataFrame, dim: DataFrame) -> DataFrame:
    months = by_month(_named(successful(f), dim), NAME).select("month", NAME, "gmv")
    before = previous("gmv", "month", NAME)
    return months.select(
        "month",
        NAME,
        money("gmv").alias("gmv"),
        money(F.col("gmv") - before).alias("mom_change"),
        growth("gmv", before).alias("mom_pct"),
    ).orderBy(NAME, "month")


def device(f: DataFrame, dim: DataFrame) -> DataFrame:
    return _paid(f, dim, "device_os").select(
        NAME,
        "device_os",
        "txn_count",
        money("gmv").alias("gmv"),
        share("txn_count", NAME).alias("pct_of_channel"),
    ).orderBy(NAME, F.desc("txn_count"))


def acquirer(f: DataFrame) -> DataFrame:
    return totals(f, "acquirer_id").select(
        "acquirer_id",
        F.col("txn_count").alias("total_txns"),
        "success_txns",
        "failed_txns",
        pct("success_txns", "txn_count").alias("success_rate_pct"),
        ratio("success_fee", "success_txns", 4).alias("avg_processing_fee"),
        money("success_gmv").alias("total_gmv_processed"),
    ).orderBy(F.desc("success_rate_pct"))


def acquirer_cost(f: DataFrame) -> DataFrame:
    """Fees by acquirer over attempts of every status."""
    return totals(f, "acquirer_id").select(
        "acquirer_id",
        "txn_count",
        ratio("fee", "txn_count", 4).alias("avg_fee"),
        money("fee").alias("total_cost"),
        money("gmv").alias("gmv"),
        pct("success_txns", "txn_count").alias("success_rate"),
    ).orderBy("avg_fee")


def performance(f: DataFrame, dim: DataFrame) -> DataFrame:
    """Unrounded channel extract with shares and users; attempts of unknown channels fall out."""
    return _paid(f, dim).select(
        NAME,
        "txn_count",
        dbl("gmv").alias("gmv"),
        dbl("net").alias("net_revenue"),
        dbl("cashback").alias("cashback_cost"),
        dbl("fee").alias("processing_cost"),
        F.col("users").alias("unique_users"),
        pct("net", "gmv", 10).alias("margin_pct"),
        dbl("cost").alias("total_cost"),
        ratio("net", "cost", 10).alias("efficiency_ratio"),
        share("gmv", digits=10).alias("gmv_share_pct"),
    )
