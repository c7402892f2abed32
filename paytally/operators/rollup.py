"""Rollups that can be maintained: sums and exact distinct customers that add up without the fact.

Distinct customers are kept as bitmaps, one per key and block of 32,768 customer numbers. Bitmaps of
days or cities are joined by OR, so months, channels and tiers follow from the stored state, and a
new day's state is folded into the old one. A state row has at most 4 kB; rows without any of a
block's customers do not exist. Customer numbers are integers; NULL is no customer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import mdr_revenue, successful

SUMS = ("txn_count", "gmv", "mdr", "cashback", "fee")


def sums(f: DataFrame, *by: str | Column) -> DataFrame:
    """Additive measures of successful payments by key; money stays decimal."""
    return successful(f).groupBy(*by).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("gmv"), F.sum(mdr_revenue()).alias("mdr"),
        F.sum("cashback_amt").alias("cashback"), F.sum("processing_fee_amt").alias("fee"))


def add_sums(*parts: DataFrame, by: list[str | Column]) -> DataFrame:
    """Sums of one or more rollups by (fewer) keys. A decimal keeps the type of the first part."""
    rows = reduce(DataFrame.unionByName, parts)
    kinds = {c: parts[0].schema[c].dataType for c in SUMS}
    return rows.groupBy(*by).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS])


def user_state(f: DataFrame, *by: str | Column) -> DataFrame:
    """Customers of successful payments by key: one bitmap ``users`` per key and ``block`` of customers."""
    known = successful(f).filter("customer_id is not null")
    return known.groupBy(*by, F.bitmap_bucket_number("customer_id").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("users"))


def fold(*states: DataFrame, by: list[str | Column]) -> DataFrame:
    """The state of the union of customers by (fewer) keys."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*by, "block").agg(F.bitmap_or_agg("users").alias("users"))


def count_users(*states: DataFrame, by: list[str | Column]) -> DataFrame:
    """Exact distinct customers by key, from states of any finer keys."""
    folded = fold(*states, by=by)
    keys = [c for c in folded.columns if c not in ("block", "users")]
    return folded.groupBy(*keys).agg(F.sum(F.bitmap_count("users")).alias("unique_customers"))
