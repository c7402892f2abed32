"""Churn risk: activity, rule labels, funnel, value at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    days_since, money, net_revenue, ratio, share, successful, within_last,
)
from paytally.operators.rfm import reference_date
from paytally.sources.readers import values

ID = "customer_id"


def activity(f: DataFrame, ref: str | None = None, counters: str = "success") -> DataFrame:
    """One row per customer: last payment, payments in the last 90 and 30 days, totals.

    ``ref`` defaults to the last SUCCESS date. With ``counters='all'`` the 90/30-day counters run
    back from the last date of any status instead.
    """
    day = reference_date(f, ref)
    if counters == "all":
        day = day.crossJoin(f.agg(F.max("txn_date").alias("count_ref")))
    else:
        day = day.withColumn("count_ref", F.col("ref"))
    count_ref = F.col("count_ref")
    return (
        successful(f)
        .crossJoin(F.broadcast(day))  # one row
        .groupBy(ID)
        .agg(
            F.max("txn_date").alias("last_txn_date"),
            F.count(F.lit(1)).alias("total_txns"),
            F.count_if(within_last("txn_date", 90, count_ref)).alias("txn_last_90d"),
            F.count_if(within_last("txn_date", 30, count_ref)).alias("txn_last_30d"),
            F.sum("amount").alias("total_gmv"),
            F.sum(net_revenue()).alias("lifetime_value"),
            F.max("ref").alias("ref"),
        )
        .withColumn("days_inactive", days_since(F.col("ref"), "last_txn_date"))
        .drop("ref")
    )


# Label, then inclusive ranges of days inactive, payments in 90 and in 30 days; first
# match wins, ``None`` is an open end. The last entry is the label of all other customers.
ANY = (None, None)
SCHEMES = {
    "A": (
        [
            ("Churned", (91, None), (None, 0), ANY),
            ("High Churn Risk", (61, 90), (None, 1), ANY),
            ("Medium Churn Risk", (31, 60), ANY, ANY),
            ("Active", ANY, ANY, (3, None)),
        ],
        "Low Risk",
    ),
    "A-summary": (
        [
            ("Churned", (91, None), (None, 0), ANY),
            ("High Churn Risk", (61, 90), (None, 1), ANY),
            ("Medium Churn Risk", (31, 60), ANY, ANY),
        ],
        "Active",
    ),
    "A-risk": (
        [
            ("Churned", (91, None), (None, 0), ANY),
            ("High Churn Risk", (61, 90), (None, 1), ANY),
        ],
        "Other",
    ),
    "B": (
        [
            ("CHURNED", (91, None), (None, 0), ANY),
            ("HIGH_RISK", (61, None), (None, 1), ANY),
            ("AT_RISK", (31, None), ANY, (None, 0)),
            ("ACTIVE", ANY, (3, None), (1, None)),
        ],
        "MODERATE_RISK",
    ),
    "C": (
        [
            ("High Risk", (61, None), (None, 1), ANY),
            ("Medium Risk", (30, 60), (None, 4), ANY),
            ("Slipping Away", ANY, ANY, (None, 0)),
        ],
        "Active / Low Risk",
    ),
    "D": (
        [
            ("High Risk", (61, None), (None, 1), ANY),
            ("Medium Risk", (31, None), (None, 4), ANY),
            ("Slipping Away", ANY, ANY, (None, 0)),
        ],
        "Active",
    ),
    "E": (
        [
            ("Churned", (91, None), (None, 0), ANY),
            ("High Risk", (61, 90), (None, 1), ANY),
            ("Medium Risk", (31, 60), ANY, ANY),
            ("Active", ANY, (3, None), ANY),
        ],
        "Low Risk",
    ),
}


def labels(scheme: str) -> list[str]:
    rules, default = SCHEMES[scheme]
    return [r[0] for r in rules] + [default]


def _inside(c: str, low: int | None, high: int | None) -> Column:
    test = F.lit(True)
    if low is not None:
        test = test & (F.col(c) >= low)
    return test if high is None else test & (F.col(c) <= high)


def churn_label(scheme: str) -> Column:
    rules, default = SCHEMES[scheme]
    out = None
    for name, days, t90, t30 in rules:
        hit = (
            _inside("days_inactive", *days)
            & _inside("txn_last_90d", *t90)
            & _inside("txn_last_30d", *t30)
        )
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def label(f: DataFrame, ref: str | None = None, scheme: str = "A",
          counters: str = "success") -> DataFrame:
    return activity(f, ref, counters).withColumn("churn_risk", churn_label(scheme))


def funnel(f: DataFrame, ref: str | None = None, scheme: str = "A", counters: str = "success",
           reindex: bool = False) -> DataFrame:
    """Customers, inactivity and GMV per label. ``reindex`` also lists labels nobody has."""
    groups = label(f, ref, scheme, counters).groupBy("churn_risk").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("days_inactive").alias("days"),
        F.sum("total_txns").alias("txns"),
        F.sum("total_gmv").alias("gmv"),
    )
    names = labels(scheme)
    order = values(f.sparkSession, list(enumerate(names)), "sort_order int, churn_risk string")
    joined = order.join(groups, "churn_risk", "left" if reindex else "inner")
    filled = joined.withColumn("customer_count", F.coalesce("customer_count", F.lit(0)))
    return filled.select(
        "churn_risk",
        "sort_order",
        "customer_count",
        share("customer_count").alias("pct"),
        ratio("days", "customer_count").alias("avg_days_inactive"),
        ratio("txns", "customer_count").alias("avg_lifetime_txns"),
        money("gmv").alias("at_risk_gmv"),
    ).orderBy("sort_order")


def gmv_at_risk(f: DataFrame, ref: str | None = None, scheme: str = "A-risk",
                risky: list[str] | None = None) -> DataFrame:
    """Users and historical GMV of the labels counted as at risk."""
    risky = risky or labels(scheme)[:-1]
    return (
        label(f, ref, scheme)
        .filter(F.col("churn_risk").isin(risky))
        .groupBy("churn_risk")
        .agg(F.count(F.lit(1)).alias("users"), F.sum("total_gmv").alias("gmv"))
        .select("churn_risk", "users", money("gmv").alias("historical_gmv_at_risk"))
    )
