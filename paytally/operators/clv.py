"""Customer lifetime value: net revenue per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    days_since, dbl, lookup, money, month_start, net_revenue, pct, ratio, rnd, share, successful,
)
from paytally.functions.ordered import (
    by_ntile, by_rank_share, checkpointed, in_ranges, percentiles as exact_percentiles,
    running_sums, tiled,
)
from paytally.operators.rfm import reference_date

ID = "customer_id"


def per_customer(f: DataFrame) -> DataFrame:
    return successful(f).groupBy(ID).agg(
        F.count(F.lit(1)).alias("txns"),
        F.sum("amount").alias("gmv"),
        F.sum(net_revenue()).alias("net"),
        F.min("txn_date").alias("first_txn_date"),
        F.max("txn_date").alias("last_txn_date"),
    )


def historical(f: DataFrame, ref: str | None = None) -> DataFrame:
    """Realised value, activity span and tenure up to ``ref``."""
    customers = per_customer(f).crossJoin(F.broadcast(reference_date(f, ref)))  # one row
    return customers.select(
        ID,
        F.col("txns").alias("total_txns"),
        money("gmv").alias("lifetime_gmv"),
        money("net").alias("lifetime_net_revenue"),
        ratio("gmv", "txns").alias("avg_order_value"),
        "first_txn_date",
        "last_txn_date",
        days_since(F.col("last_txn_date"), "first_txn_date").alias("active_days"),
        days_since(F.col("ref"), "first_txn_date").alias("tenure_days"),
    )


# Upper edges and labels. ``closed`` edges belong to the lower bucket.
BUCKETS = {
    "rupee": (True, [(0, "Negative"), (10, "₹0–10"), (50, "₹10–50"), (100, "₹50–100"),
                     (200, "₹100–200")], "₹200+"),
    "half_open": (False, [(0, "Negative CLV"), (10, "0 - 10"), (50, "10 - 50"), (100, "50 - 100"),
                          (500, "100 - 500")], "500+"),
    "right_closed": (True, [(0, "Negative"), (10, "₹0-10"), (50, "₹10-50"), (100, "₹50-100"),
                            (500, "₹100-500")], "₹500+"),
}


def clv_bucket(value: str, scheme: str) -> Column:
    closed, edges, last = BUCKETS[scheme]
    out = None
    for edge, label in edges:
        hit = F.col(value) <= edge if closed else F.col(value) < edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def buckets(f: DataFrame, scheme: str = "rupee") -> DataFrame:
    return (
        per_customer(f)
        .groupBy(clv_bucket("net", scheme).alias("clv_bucket"))
        .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("net").alias("total"))
        .select(
            "clv_bucket",
            "customer_count",
            share("customer_count").alias("pct"),
            money("total").alias("total_revenue"),
            ratio("total", "customer_count", 4).alias("avg_clv"),
        )
        .orderBy("avg_clv")
    )


def _net(f: DataFrame) -> DataFrame:
    return checkpointed(per_customer(f).select(ID, "net"))


def quintiles(f: DataFrame, k: int = 5) -> DataFrame:
    groups = tiled(_net(f), ID, quintile=by_ntile("net", k, desc=True))
    return (
        groups.groupBy("quintile")
        .agg(F.count(F.lit(1)).alias("users"), F.sum("net").alias("net"))
        .select("quintile", "users", money("net").alias("revenue"), share("net").alias("revenue_pct"))
        .orderBy("quintile")
    )


# Upper rank share and label of the Pareto tiers.
TIERS = [("0.10", "Top 10%"), ("0.25", "Top 11-25%"), ("0.50", "Top 26-50%")]
LAST_TIER = "Bottom 50%"


def rank_tiers(f: DataFrame) -> DataFrame:
    """Customers in rank tiers and their part of revenue."""
    tiered = tiled(_net(f), ID, tier_no=by_rank_share("net", [s for s, _ in TIERS]))
    label = F.element_at(
        F.array(*[F.lit(name) for _, name in TIERS], F.lit(LAST_TIER)), F.col("tier_no")
    )
    return (
        tiered.groupBy("tier_no")
        .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("net").alias("net"))
        .select(
            label.alias("customer_tier"),
            "customer_count",
            money("net").alias("segment_revenue"),
            share("net").alias("pct_of_total_revenue"),
            ratio("net", "customer_count").alias("avg_clv"),
        )
        .orderBy(F.desc("avg_clv"))
    )


def projected(f: DataFrame) -> DataFrame:
    """Mean monthly revenue per customer times mean number of active months."""
    monthly = successful(f).groupBy(ID, month_start().alias("m")).agg(
        F.sum(net_revenue()).alias("net")
    )
    users = monthly.groupBy(ID).agg(
        F.sum("net").alias("net"), F.count(F.lit(1)).alias("months")
    ).select((dbl("net") / F.col("months")).alias("rev"), "months")
    means = users.agg(F.avg("rev").alias("rev"), ratio(F.sum("months"), F.count("months"), 12).alias("m"))
    return means.select(
        rnd("rev", 4).alias("avg_monthly_rev_per_user"),
        rnd("m", 2).alias("avg_active_months"),
        rnd(F.col("rev") * F.col("m"), 4).alias("projected_clv_avg"),
    )


# Labels of the value tiers at the 90th, 75th and 50th percentile. The "shifted" set
# is the one of the dashboard extract, whose edges belong to the lower tier.
VALUE_TIERS = {
    "sql": ["Top 10%", "Top 25%", "Top 50%", "Bottom 50%"],
    "shifted": ["Top 1%", "Top 10%", "Top 25%", "Bottom 50%"],
}


def tiers(f: DataFrame, dim_customer: DataFrame, labels: str = "sql") -> DataFrame:
    """Customers with their percentile tier and segment tag."""
    value = money("net") if labels == "sql" else dbl("net")
    customers = checkpointed(per_customer(f).withColumn("value", value))
    limits = exact_percentiles(customers, "value", {"p90": 0.9, "p75": 0.75, "p50": 0.5})
    out = None
    for limit, name in zip(("p90", "p75", "p50"), VALUE_TIERS[labels]):
        reach = F.col("value") >= F.col(limit)
        hit = reach if labels == "sql" else F.col("value") > F.col(limit)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    how = "inner" if labels == "sql" else "left"
    tagged = lookup(customers.crossJoin(F.broadcast(limits)), dim_customer, ID, "segment_tag", how=how)
    return tagged.select(
        ID,
        F.col("txns").alias("total_txns"),
        dbl("gmv").alias("total_gmv"),
        F.col("value").alias("lifetime_value"),
        F.col("first_txn_date").alias("first_txn"),
        F.col("last_txn_date").alias("last_txn"),
        days_since(F.col("last_txn_date"), "first_txn_date").alias("active_days"),
        out.otherwise(VALUE_TIERS[labels][3]).alias("clv_bucket"),
        "segment_tag",
    )


def percentiles(f: DataFrame) -> DataFrame:
    net = _net(f)
    limits = exact_percentiles(
        net, "net", {"p25_ltv": 0.25, "median_ltv": 0.5, "p75_ltv": 0.75, "p90_ltv": 0.9}
    )
    means = net.agg(
        ratio(F.sum("net"), F.count("net")).alias("avg_ltv"),
        money(F.sum("net")).alias("total_net_revenue"),
    )
    rounded = limits.select(*[rnd(c, 2).alias(c) for c in limits.columns])
    return rounded.crossJoin(F.broadcast(means))  # one row each


def by_segment(f: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Value by customer segment; facts are reduced per customer before the join."""
    return (
        lookup(per_customer(f), dim_customer, ID, "segment_tag")
        .groupBy("segment_tag")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("txns").alias("txns"),
            F.sum("gmv").alias("gmv"),
            F.sum("net").alias("net"),
        )
        .select(
            "segment_tag",
            "customer_count",
            ratio("net", "txns", 4).alias("avg_net_revenue_per_txn"),
            money("gmv").alias("total_gmv"),
            money("net").alias("total_net_revenue"),
            ratio("net", "customer_count").alias("avg_clv_per_customer"),
        )
        .orderBy(F.desc("avg_clv_per_customer"))
    )


def top(f: DataFrame, dim_customer: DataFrame, dim_city: DataFrame, k: int = 100) -> DataFrame:
    """Most valuable customers with segment, home city and tier."""
    homes = lookup(per_customer(f), dim_customer, ID, "segment_tag", "city_id")
    placed = lookup(homes, dim_city, "city_id", "city_name", "tier")
    return placed.orderBy(F.desc("net"), ID).limit(k).select(
        ID, "segment_tag", "city_name", "tier",
        F.col("txns").alias("total_txns"),
        money("gmv").alias("total_spend"),
        money("net").alias("lifetime_value"),
        "first_txn_date", "last_txn_date",
    )


def top_share(f: DataFrame, shares: list[str] = ("0.10", "0.20")) -> DataFrame:
    """Part of revenue earned with the top share of customers by rank."""
    tiered = tiled(_net(f), ID, tier_no=by_rank_share("net", list(shares)))
    upto = Window.orderBy("tier_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tiers_ = tiered.groupBy("tier_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net").alias("net")
    ).select(  # one row per share
        "tier_no",
        F.sum("n").over(upto).alias("customers"),
        F.sum("net").over(upto).alias("top"),
        F.sum("net").over(Window.partitionBy()).alias("total"),
    )
    name = F.element_at(F.array(*[F.lit(float(s) * 100) for s in shares]), F.col("tier_no"))
    return tiers_.filter(F.col("tier_no") <= len(shares)).select(
        name.alias("top_pct"),
        "customers",
        money("top").alias("revenue"),
        pct("top", "total").alias("revenue_share_pct"),
    ).orderBy("top_pct")


def share_above(f: DataFrame, p: float = 0.9) -> DataFrame:
    """Part of revenue earned with customers at or above a percentile of value."""
    net = _net(f)
    limit = exact_percentiles(net, "net", {"threshold": p})
    above = dbl("net") >= F.col("threshold")
    row = net.crossJoin(F.broadcast(limit)).agg(  # one row
        F.max("threshold").alias("threshold"),
        F.count_if(above).alias("customers"),
        F.sum(F.when(above, F.col("net"))).alias("top"),
        F.sum("net").alias("total"),
    )
    return row.select(
        rnd("threshold", 2).alias("threshold"), "customers", money("top").alias("revenue"),
        pct("top", "total").alias("revenue_share_pct"),
    )


def lorenz(f: DataFrame, points: int = 100, desc: bool = False) -> DataFrame:
    """Cumulative share of revenue at ``points`` evenly spaced shares of customers.

    Ascending order gives the Lorenz curve, descending the Pareto curve.
    """
    order = -F.col("net") if desc else F.col("net")
    rows = per_customer(f).select(
        order.alias("_v"), ID, "net", F.lit(1).cast("long").alias("one")
    )
    parts = in_ranges(rows, "_v", ID)
    total = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("total"))
    ranked = running_sums(parts, ["_v", ID], rank="one", revenue="net").crossJoin(
        F.broadcast(total)  # one row
    )
    step = F.floor(F.col("rank_upto") * points / F.col("n"))
    before = F.floor((F.col("rank_upto") - 1) * points / F.col("n"))
    return ranked.filter(step > before).select(
        F.col("rank_upto").cast("long").alias("customers"),
        pct("rank_upto", "n", 4).alias("cumulative_customers_pct"),
        pct("revenue_upto", "total", 4).alias("cumulative_revenue_pct"),
    ).orderBy("customers")
