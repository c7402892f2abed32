"""Processing cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import lookup, money, pct, ratio, successful, totals


def summary(f: DataFrame) -> DataFrame:
    return totals(successful(f)).select(
        money("fee").alias("total_processing_cost"),
        ratio("fee", "txn_count", 4).alias("avg_cost_per_txn"),
        money("min_fee", 4).alias("min_cost"),
        money("max_fee", 4).alias("max_cost"),
        "txn_count",
        pct("fee", "gmv", 4).alias("cost_as_pct_of_gmv"),
    )


def by_channel(f: DataFrame, dim_channel: DataFrame) -> DataFrame:
    named = lookup(successful(f), dim_channel, "channel_id", "channel_name")
    return totals(named, "channel_name").select(
        "channel_name",
        ratio("fee", "txn_count", 4).alias("avg_processing_cost"),
        money("fee").alias("total_processing_cost"),
        "txn_count",
        pct("fee", "gmv", 4).alias("cost_pct_gmv"),
    ).orderBy(F.desc("avg_processing_cost"))
