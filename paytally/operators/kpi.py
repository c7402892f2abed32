"""Platform KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, dbl, growth, lookup, money, month_key, month_start, net_revenue, pct, previous,
    ratio, rnd, share, successful, totals,
)
from paytally.functions.ordered import percentiles


def gmv_summary(f: DataFrame) -> DataFrame:
    # A row per customer and one per merchant, combined per id before the shuffle; no distinct aggregate.
    cells = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("customer_id").cast("string").alias("id")),
        F.struct(F.lit(1).alias("kind"), F.col("merchant_id").cast("string").alias("id"))))
    ids = successful(f).select("amount", cells.alias("c")).groupBy("c.kind", "c.id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    customer, merchant = F.col("kind") == 0, F.col("kind") == 1
    return ids.agg(
        F.coalesce(F.sum(F.when(customer, F.col("n"))), F.lit(0)).alias("txn_count"),
        F.sum(F.when(customer, F.col("amount"))).alias("gmv"),
        F.count(F.when(customer, F.col("id"))).alias("unique_customers"),
        F.count(F.when(merchant, F.col("id"))).alias("unique_merchants"),
    ).select(
        money("gmv").alias("total_gmv"),
        F.col("txn_count").alias("total_txn_count"),
        "unique_customers",
        "unique_merchants",
        ratio("gmv", "txn_count").alias("avg_txn_value"),
    )


def monthly_gmv(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select(
        "month", money("gmv").alias("gmv"), "txn_count", F.col("users").alias("unique_customers")
    ).orderBy("month")


def revenue_summary(f: DataFrame) -> DataFrame:
    return totals(successful(f)).select(
        money("gmv").alias("total_gmv"),
        money("mdr").alias("gross_mdr_revenue"),
        money("cashback").alias("total_cashback"),
        money("fee").alias("total_processing_cost"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
    )


def monthly_revenue(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select(
        "month",
        money("gmv").alias("gmv"),
        money("mdr").alias("gross_mdr"),
        money("cashback").alias("cashback"),
        money("fee").alias("processing_cost"),
        money("net").alias("net_revenue"),
    ).orderBy("month")


def margin(f: DataFrame) -> DataFrame:
    return totals(successful(f)).select(pct("net", "gmv", 4).alias("margin_pct"))


def monthly_margin(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select(
        "month",
        "txn_count",
        F.col("users").alias("mau"),
        money("gmv").alias("gmv"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy("month")


def mau(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select("month", F.col("users").alias("mau")).orderBy("month")


def mau_activity(f: DataFrame) -> DataFrame:
    return by_month(successful(f)).select(
        "month",
        F.col("users").alias("mau"),
        "txn_count",
        ratio("txn_count", "users").alias("avg_txns_per_user"),
    ).orderBy("month")


def mom_growth(f: DataFrame) -> DataFrame:
    """Month-over-month growth. The lag runs on one row per month."""
    months = by_month(successful(f)).select("month", "gmv", "net", "users")
    return months.select(
        "month",
        money("gmv").alias("gmv"),
        money("net").alias("net_revenue"),
        F.col("users").alias("mau"),
        growth("gmv", previous("gmv", "month")).alias("gmv_mom_pct"),
        growth("net", previous("net", "month")).alias("rev_mom_pct"),
        growth("users", previous("users", "month")).alias("mau_mom_pct"),
    ).orderBy("month")


def status_share(f: DataFrame) -> DataFrame:
    return (
        f.groupBy("status")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("amount"))
        .select(
            "status", "txn_count", share("txn_count").alias("pct"),
            money("amount").alias("total_amount"),
        )
        .orderBy(F.desc("txn_count"))
    )


def monthly_success(f: DataFrame) -> DataFrame:
    return by_month(f).select(
        "month",
        F.col("txn_count").alias("total_txns"),
        "success_txns",
        pct("success_txns", "txn_count").alias("success_rate_pct"),
    ).orderBy("month")


def monthly_aov(f: DataFrame) -> DataFrame:
    """Average, range and exact median of the amount by month."""
    s = successful(f).select("txn_date", "amount").withColumn("m", month_start())
    value, weight = F.col("_v"), F.col("_w")
    found = percentiles(s, "amount", {"median": 0.5}, by=["m"], also={
        "gmv": F.sum(value * weight), "n": F.sum(weight), "lo": F.min(value), "hi": F.max(value)})
    return found.select(
        month_key("m").alias("month"),
        ratio("gmv", "n").alias("avg_order_value"),
        money("lo").alias("min_amount"),
        money("hi").alias("max_amount"),
        rnd("median", 2).alias("median_amount"),
    ).orderBy("month")


def revenue_per_user(f: DataFrame) -> DataFrame:
    users = successful(f).groupBy("customer_id").agg(F.sum(net_revenue()).alias("net"))
    return users.agg(
        ratio(F.sum("net"), F.count("net"), 4).alias("avg_revenue_per_user"),
        money(F.min("net"), 4).alias("min_rev_per_user"),
        money(F.max("net"), 4).alias("max_rev_per_user"),
    )


def platform_summary(f: DataFrame) -> DataFrame:
    return totals(successful(f)).select(
        money("gmv").alias("total_gmv"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
        F.col("txn_count").alias("total_txns"),
        F.col("users").alias("unique_customers"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
        pct("cashback", "gmv", 4).alias("cashback_rate_pct"),
        ratio("fee", "txn_count", 4).alias("avg_proc_fee"),
    )


def executive_summary(f: DataFrame, dim_channel: DataFrame, channel: str = "UPI") -> DataFrame:
    """Period, totals, success rate, GMV per cashback unit and one channel's share of GMV."""
    ids = dim_channel.filter(F.col("channel_name") == channel).select("channel_id").distinct()
    marked = f.join(ids.withColumn("_in", F.lit(True)), "channel_id", "left")
    ok = F.col("status") == "SUCCESS"
    row = marked.agg(
        F.min(F.when(ok, F.col("txn_date"))).alias("period_start"),
        F.max(F.when(ok, F.col("txn_date"))).alias("period_end"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.sum(F.when(ok, F.col("amount"))).alias("gmv"),
        F.sum(F.when(ok, net_revenue())).alias("net"),
        F.sum(F.when(ok, F.col("cashback_amt"))).alias("cashback"),
        F.sum(F.when(ok & F.col("_in"), F.col("amount"))).alias("part"),
        F.countDistinct(F.when(ok, F.col("customer_id"))).alias("customers"),
    )
    return row.select(
        "period_start", "period_end",
        money("gmv").alias("total_gmv"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
        F.col("customers").alias("total_customers"),
        pct("n_ok", "n").alias("success_rate_pct"),
        ratio("gmv", "cashback").alias("gmv_per_cashback"),
        pct("part", "gmv", 1).alias("channel_gmv_share_pct"),
    )


def monthly_kpi(f: DataFrame) -> DataFrame:
    """Monthly performance with unrounded ratios and growth."""
    months = by_month(successful(f)).select(
        "month", "txn_count", "gmv", "mdr", "cashback", "fee", "net", "users"
    )
    return months.select(
        F.col("month").alias("txn_month"),
        "txn_count",
        dbl("gmv").alias("gmv"),
        dbl("mdr").alias("gross_mdr_rev"),
        dbl("cashback").alias("cashback_cost"),
        dbl("fee").alias("processing_cost"),
        dbl("net").alias("net_revenue"),
        F.col("users").alias("mau"),
        pct("net", "gmv", 10).alias("margin_pct"),
        growth("gmv", previous("gmv", "month"), 10).alias("gmv_mom_growth_pct"),
        growth("net", previous("net", "month"), 10).alias("rev_mom_growth_pct"),
        growth("users", previous("users", "month"), 10).alias("mau_mom_growth_pct"),
    ).orderBy("txn_month")


def device_breakdown(f: DataFrame) -> DataFrame:
    return totals(successful(f), "device_os").select(
        "device_os",
        "txn_count",
        money("gmv").alias("gmv"),
        share("txn_count").alias("pct_of_total"),
        share("gmv").alias("gmv_share_pct"),
        ratio("gmv", "txn_count").alias("avg_txn_value"),
    ).orderBy(F.desc("txn_count"))


def daytype(f: DataFrame, dim_date: DataFrame, *flags: str) -> DataFrame:
    """Totals by calendar flags, ``is_weekend`` and ``holiday_flag`` by default."""
    flags = flags or ("is_weekend", "holiday_flag")
    days = dim_date.select(F.col("date").alias("txn_date"), *flags)
    return totals(lookup(successful(f), days, "txn_date", *flags), *flags).select(
        *flags,
        "txn_count",
        F.col("users").alias("unique_users"),
        money("gmv").alias("total_gmv"),
        ratio("gmv", "txn_count").alias("avg_txn_amount"),
        pct("net", "gmv", 4).alias("margin_pct"),
    ).orderBy(*flags)
