"""Merchant categories and top merchants.

The merchant dimension grows with the platform, so facts are reduced per merchant before the join;
a merchant with a third of all payments is then a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    dbl, lookup, mdr_revenue, money, pct, ratio, share, successful,
)


def _sums(s: DataFrame, *by: str) -> DataFrame:
    return s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("gmv"),
        F.sum(mdr_revenue()).alias("mdr"),
        F.sum("cashback_amt").alias("cashback"),
        F.sum("processing_fee_amt").alias("fee"),
    )


def _category_totals(f: DataFrame, dim_merchant: DataFrame) -> DataFrame:
    """Totals per (merchant, customer) roll up to categories; customers are counted once per
    category through a two-level distinct."""
    pairs = _sums(successful(f), "merchant_id", "customer_id")
    return (
        lookup(pairs, dim_merchant, "merchant_id", "category")
        .groupBy("category")
        .agg(
            F.sum("n").alias("txn_count"),
            *[F.sum(c).alias(c) for c in ("gmv", "mdr", "cashback", "fee")],
            F.countDistinct("customer_id").alias("users"),
        )
        .withColumn("net", F.col("mdr") - F.col("cashback") - F.col("fee"))
    )


def category(f: DataFrame, dim_merchant: DataFrame) -> DataFrame:
    return _category_totals(f, dim_merchant).select(
        "category",
        "txn_count",
        F.col("users").alias("unique_customers"),
        money("gmv").alias("gmv"),
        share("gmv").alias("gmv_share_pct"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy(F.desc("gmv"))


def extract(f: DataFrame, dim_merchant: DataFrame) -> DataFrame:
    """Unrounded category extract."""
    return _category_totals(f, dim_merchant).select(
        "category",
        "txn_count",
        dbl("gmv").alias("gmv"),
        dbl("net").alias("net_revenue"),
        dbl("cashback").alias("cashback"),
        F.col("users").alias("unique_users"),
        pct("net", "gmv", 10).alias("margin_pct"),
        share("gmv", digits=10).alias("gmv_share"),
    )


def top(f: DataFrame, dim_merchant: DataFrame, dim_city: DataFrame, n: int = 20) -> DataFrame:
    """Merchants by GMV with category and home city; equal names in one city count together."""
    named = lookup(
        _sums(successful(f), "merchant_id"), dim_merchant, "merchant_id",
        "merchant_name", "category", "city_id",
    )
    placed = lookup(named, dim_city, "city_id", "city_name")
    keys = ["merchant_name", "category", "city_name"]
    rolled = placed.groupBy(*keys).agg(
        F.sum("n").alias("txn_count"),
        *[F.sum(c).alias(c) for c in ("gmv", "mdr", "cashback", "fee")],
    )
    return rolled.orderBy(F.desc("gmv"), *keys).limit(n).select(
        *keys,
        "txn_count",
        money("gmv").alias("gmv"),
        money(F.col("mdr") - F.col("cashback") - F.col("fee")).alias("net_revenue"),
        ratio("gmv", "txn_count").alias("avg_ticket_size"),
    )
