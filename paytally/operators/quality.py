"""Data-quality checks. Checks on the same table share one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType

from paytally.functions.expr import (
    FAILED, PENDING, SUCCESS, dbl, lookup, mdr_revenue, money, month_key, month_start, pct,
    ratio, rnd, share, successful,
)
from paytally.functions.ordered import percentiles

CRITICAL = ["transaction_id", "customer_id", "merchant_id", "amount", "mdr_pct", "status",
            "txn_date", "channel_id"]
from paytally.sources.readers import values


def _as_rows(df: DataFrame, key: str, value: str, checks: dict[str, Column]) -> DataFrame:
    """One aggregate per check in a single pass, returned as one row per check."""
    row = df.agg(*[c.alias(name) for name, c in checks.items()])
    cells = ", ".join(f"'{name}', `{name}`" for name in checks)
    return row.select(F.expr(f"stack({len(checks)}, {cells}) AS ({key}, {value})"))


def row_counts(star: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("total_rows")).select(
            F.lit(name).alias("table_name"), "total_rows"
        )
        for name, df in star.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def null_counts(f: DataFrame, columns: list[str] = CRITICAL) -> DataFrame:
    return f.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def invalid_amounts(f: DataFrame) -> DataFrame:
    amount, cashback = F.col("amount"), F.col("cashback_amt")
    return _as_rows(f, "issue", "count", {
        "negative_amount": F.count_if(amount < 0),
        "zero_amount": F.count_if(amount == 0),
        "negative_cashback": F.count_if(cashback < 0),
        "negative_processing": F.count_if(F.col("processing_fee_amt") < 0),
        "cashback_exceeds_mdr": F.count_if(cashback > mdr_revenue()),
    })


def orphans(f: DataFrame, star: dict[str, DataFrame]) -> DataFrame:
    """Fact rows without a dimension row, one row per dimension, also where the fact is empty.

    Counting per key first keeps a hot key to one row.
    """
    keys = [
        ("missing_customer", "customer_id", "dim_customer", "customer_id"),
        ("missing_merchant", "merchant_id", "dim_merchant", "merchant_id"),
        ("missing_channel", "channel_id", "dim_channel", "channel_id"),
        ("missing_city", "city_id", "dim_city", "city_id"),
        ("missing_date", "txn_date", "dim_date", "date"),
    ]

    def number(c: Column, kind: DataType) -> Column:
        """Integers and dates as numbers, so that keys are combined without text."""
        if isinstance(kind, DateType):
            return F.unix_date(c).cast("long")
        return c.cast("long") if plain else c.cast("string")

    plain = all(isinstance(f.schema[k].dataType, (IntegralType, DateType)) for _, k, _, _ in keys)
    # One scan: a row per key kind, combined per (kind, key) before the shuffle.
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("issue"), number(F.col(key), f.schema[key].dataType).alias("key"))
        for i, (_, key, _, _) in enumerate(keys)
    ]))
    per_key = f.select(cells.alias("c")).groupBy("c.issue", "c.key").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(DataFrame.unionByName, [
        star[dim].select(F.lit(i).alias("issue"), number(F.col(dim_key), star[dim].schema[dim_key].dataType).alias("key"))
        for i, (_, _, dim, dim_key) in enumerate(keys)
    ]).withColumn("known", F.lit(True))
    counts = per_key.join(known.distinct(), ["issue", "key"], "left").groupBy("issue").agg(
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n"))
    issues = values(f.sparkSession, [(i, k[0]) for i, k in enumerate(keys)], "i int, issue string")
    return issues.join(counts.withColumnRenamed("issue", "_i"), F.col("i") == F.col("_i"), "left").orderBy("i").select(
        "issue", F.coalesce("n", F.lit(0)).cast("long").alias("orphan_count"))


def duplicate_ids(f: DataFrame, k: int = 10) -> DataFrame:
    return (
        f.groupBy("transaction_id")
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .filter("dup_count > 1")
        .orderBy(F.desc("dup_count"), "transaction_id")
        .limit(k)
    )


def duplicate_total(f: DataFrame) -> DataFrame:
    """Rows minus distinct ids, from counts per id instead of a global distinct."""
    per_id = f.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("transaction_id").isNotNull(), 1).otherwise(0)
    return per_id.agg((F.sum("n") - F.sum(known)).alias("duplicate_txn_ids"))


def potential_duplicates(f: DataFrame, k: int = 20) -> DataFrame:
    keys = ["customer_id", "txn_date", "amount", "channel_id"]
    return (
        successful(f)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("potential_dups"))
        .filter("potential_dups > 1")
        .orderBy(F.desc("potential_dups"), *keys)
        .limit(k)
        .withColumn("amount", dbl("amount"))
    )


def status_distribution(f: DataFrame) -> DataFrame:
    counts = f.groupBy("status").agg(F.count(F.lit(1)).alias("txn_count"))
    return counts.withColumn("pct", share("txn_count"))


def date_coverage(f: DataFrame) -> DataFrame:
    """Dates are reduced to the distinct ones first, so no distinct count runs on fact rows."""
    days = f.groupBy("txn_date").agg(F.count(F.lit(1)).alias("n"))
    return days.agg(
        F.min("txn_date").alias("earliest_txn"),
        F.max("txn_date").alias("latest_txn"),
        F.count("txn_date").alias("distinct_dates"),
        F.countDistinct(month_start()).alias("distinct_months"),
    )


def dates_not_in_dim(f: DataFrame, dim_date: DataFrame) -> DataFrame:
    days = f.select("txn_date").distinct()
    lost = days.join(dim_date, days["txn_date"] == dim_date["date"], "left_anti")
    return lost.agg(F.count("txn_date").alias("fact_dates_not_in_dim"))


def mdr_range(f: DataFrame) -> DataFrame:
    s = successful(f)
    median = percentiles(s, "mdr_pct", {"median_mdr": 0.5})
    return s.agg(
        dbl(F.min("mdr_pct")).alias("min_mdr"),
        dbl(F.max("mdr_pct")).alias("max_mdr"),
        ratio(F.sum("mdr_pct"), F.count("mdr_pct"), 6).alias("avg_mdr"),
    ).crossJoin(F.broadcast(median.withColumn("median_mdr", rnd("median_mdr", 6))))


def mdr_out_of_range(f: DataFrame, low: float = 0, high: float = 5) -> DataFrame:
    outside = (F.col("mdr_pct") < low) | (F.col("mdr_pct") > high)
    return f.agg(
        dbl(F.min("mdr_pct")).alias("min_mdr"),
        dbl(F.max("mdr_pct")).alias("max_mdr"),
        ratio(F.sum("mdr_pct"), F.count("mdr_pct"), 6).alias("avg_mdr"),
        F.count_if(outside).alias("invalid_mdr"),
    )


def outliers(f: DataFrame, k: float = 3, pop: bool = False) -> DataFrame:
    """SUCCESS rows further than ``k`` standard deviations from the mean amount."""
    s = successful(f).select(dbl("amount").alias("x"))
    spread = F.stddev_pop("x") if pop else F.stddev_samp("x")
    stats = s.agg(F.avg("x").alias("mean"), spread.alias("std"))
    far = F.abs(F.col("x") - F.col("mean")) > k * F.col("std")
    return s.crossJoin(F.broadcast(stats)).agg(F.count_if(far).alias("outlier_count"))  # one row


def rule_violations(f: DataFrame) -> DataFrame:
    amount = F.col("amount")
    tenth = F.lit("0.10").cast("decimal(3,2)")
    return _as_rows(f, "rule", "n", {
        "invalid_amounts": F.count_if(amount <= 0),
        "cashback_exceeds_amount": F.count_if(F.col("cashback_amt") > amount),
        "high_processing_fee": F.count_if(F.col("processing_fee_amt") > amount * tenth),
        "invalid_settlement": F.count_if(F.col("settlement_date") < F.col("txn_date")),
        "refunded_success_txns": F.count_if(
            (F.col("status") == SUCCESS) & (F.col("refunded_amt") > 0)
        ),
    })


def amount_summary(f: DataFrame) -> DataFrame:
    return successful(f).agg(
        money(F.min("amount")).alias("min_amount"),
        money(F.max("amount")).alias("max_amount"),
        ratio(F.sum("amount"), F.count("amount")).alias("avg_amount"),
        F.count(F.lit(1)).alias("total_txns"),
    )


def daily_extremes(f: DataFrame, k: int = 10, asc: bool = True) -> DataFrame:
    days = successful(f).groupBy("txn_date").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("gmv")
    )
    order = F.asc("gmv") if asc else F.desc("gmv")
    return days.orderBy(order, "txn_date").limit(k).select(
        "txn_date", "txn_count", money("gmv").alias("daily_gmv")
    )


def monthly_counts(f: DataFrame) -> DataFrame:
    months = successful(f).groupBy(month_start().alias("m")).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("gmv")
    )
    return months.select(
        month_key("m").alias("month"), "txn_count", money("gmv").alias("monthly_gmv")
    ).orderBy("month")


def channel_counts(f: DataFrame, dim_channel: DataFrame) -> DataFrame:
    per_id = f.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        lookup(per_id, dim_channel, "channel_id", "channel_name")
        .groupBy("channel_name")
        .agg(F.sum("n").alias("txn_count"))
        .orderBy(F.desc("txn_count"))
    )


def device_share(f: DataFrame) -> DataFrame:
    counts = f.groupBy("device_os").agg(F.count(F.lit(1)).alias("txn_count"))
    return counts.withColumn("pct", share("txn_count")).orderBy(F.desc("txn_count"))


def health_report(f: DataFrame) -> DataFrame:
    ok = F.col("status") == SUCCESS
    row = f.agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.count_if(ok).alias("success_txns"),
        F.count_if(F.col("status") == FAILED).alias("failed_txns"),
        F.count_if(F.col("status") == PENDING).alias("pending_txns"),
        F.sum(F.when(ok, F.col("amount"))).alias("gmv"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    return row.select(
        "total_txns", "success_txns", "failed_txns", "pending_txns",
        pct("success_txns", "total_txns").alias("success_rate_pct"),
        money("gmv").alias("total_gmv"),
        ratio("gmv", "success_txns").alias("avg_txn_value"),
        "unique_customers",
    )
