"""Retries and failed attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import lookup, money, pct, ratio, share, totals


def by_count(f: DataFrame) -> DataFrame:
    return totals(f, "retry_count").select(
        "retry_count",
        "txn_count",
        share("txn_count").alias("pct_of_total"),
        F.col("success_txns").alias("success_count"),
        pct("success_txns", "txn_count").alias("success_rate_pct"),
        ratio("fee", "txn_count", 4).alias("avg_processing_fee"),
        ratio("success_fee", "success_txns", 4).alias("avg_processing_cost"),
    ).orderBy("retry_count")


def wasted_cost(f: DataFrame) -> DataFrame:
    """Fees of unsuccessful attempts against fees of successful ones."""
    failed = F.col("fee") - F.coalesce("success_fee", F.lit(0))
    return totals(f).withColumn("failed_fee", failed).select(
        money("failed_fee").alias("failed_processing_cost"),
        money("success_fee").alias("success_processing_cost"),
        pct("failed_fee", "fee").alias("wasted_cost_pct"),
    )


def by_channel(f: DataFrame, dim_channel: DataFrame) -> DataFrame:
    named = lookup(f, dim_channel, "channel_id", "channel_name")
    return totals(named, "channel_name", "retry_count").select(
        "channel_name", "retry_count", "txn_count", ratio("gmv", "txn_count").alias("avg_amount")
    ).orderBy("channel_name", "retry_count")
