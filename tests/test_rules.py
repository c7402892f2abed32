"""Labels and bucket edges, spelled out independently of the rule tables."""

import itertools

import pytest
from conftest import rows

from paytally.functions.expr import months_since
from paytally.operators import behavior, churn, clv, rfm
from pyspark.sql import functions as F


def four(r, f, m):
    if (r, f, m) == (4, 4, 4):
        return "Champions"
    if min(r, f) >= 3:
        return "Loyal Customers"
    if r == 4:
        return "Recent Customers"  # f is at most 2 here
    if min(r, f, m) >= 2:
        return "Customers Needing Attention"
    if r == 2 and f <= 2:
        return "At Risk"
    if r == 1:
        return "Lost Customers" if f == 1 else "Cannot Lose Them"
    return "Hibernating"


def five(r, f, m):
    if min(r, f, m) >= 4:
        return "Champions"
    if min(r, f) >= 3:
        return "Loyal Users"
    if f <= 2 and r >= 3:
        return "New Customers" if r >= 4 else "Potential Loyalists"
    if f >= 3:
        return "At Risk"
    if m >= 3:
        return "Cannot Lose Them"
    return "Lost Customers" if r == f == 1 else "Hibernating"


def threshold(r, f, m):
    if (r, f, m) == (4, 4, 4):
        return "Champions"
    if min(r, f) >= 3:
        return "Loyal Customers"
    if f <= 2:
        if r == 4:
            return "New Customers"
        if r == 3:
            return "Potential Loyalists" if m >= 3 else "Needs Attention"
        return "Cant Lose Them" if m >= 3 else "Lost Customers"
    return "At Risk" if r == 2 else "Hibernating"


@pytest.mark.parametrize("scheme,expected,k", [("ntile4", four, 4), ("ntile5", five, 5),
                                               ("qcut5", five, 5), ("kth4", threshold, 4)])
def test_rfm_labels_for_every_score(spark, scheme, expected, k):
    cells = list(itertools.product(range(1, k + 1), repeat=3))
    df = spark.createDataFrame(cells, "r_score int, f_score int, m_score int")
    for row in rows(df.withColumn("label", rfm.rfm_label(scheme))):
        assert row["label"] == expected(row["r_score"], row["f_score"], row["m_score"]), row


def test_short_labels_never_say_promising(spark):
    cells = list(itertools.product(range(1, 5), repeat=3))
    df = spark.createDataFrame(cells, "r_score int, f_score int, m_score int")
    short = {r["l"] for r in rows(df.withColumn("l", rfm.rfm_label("qcut4")))}
    assert short == {"Champions", "Loyal Customers", "Recent Customers", "Needs Attention", "At Risk",
                     "Cannot Lose", "Lost", "Hibernating"}


# scheme, days inactive, payments in 90 days, in 30 days, label
CASES = [
    ("A", 91, 0, 0, "Churned"), ("A", 91, 1, 0, "Low Risk"), ("A", 90, 1, 0, "High Churn Risk"),
    ("A", 61, 2, 0, "Low Risk"), ("A", 60, 9, 0, "Medium Churn Risk"), ("A", 31, 0, 0, "Medium Churn Risk"),
    ("A", 30, 3, 3, "Active"), ("A", 30, 3, 2, "Low Risk"),
    ("A-summary", 30, 0, 0, "Active"), ("A-risk", 45, 0, 0, "Other"),
    ("B", 91, 0, 0, "CHURNED"), ("B", 91, 1, 0, "HIGH_RISK"), ("B", 61, 2, 0, "AT_RISK"),
    ("B", 31, 5, 1, "ACTIVE"), ("B", 5, 2, 1, "MODERATE_RISK"),
    ("C", 61, 1, 0, "High Risk"), ("C", 30, 4, 1, "Medium Risk"), ("C", 61, 2, 0, "Slipping Away"),
    ("C", 29, 1, 1, "Active / Low Risk"),
    ("D", 30, 4, 1, "Active"), ("D", 31, 4, 0, "Medium Risk"), ("D", 70, 4, 0, "Medium Risk"),
    ("D", 31, 5, 0, "Slipping Away"),
    ("E", 10, 3, 0, "Active"), ("E", 10, 2, 9, "Low Risk"), ("E", 75, 1, 0, "High Risk"),
]


@pytest.mark.parametrize("scheme", sorted({c[0] for c in CASES}))
def test_churn_labels(spark, scheme):
    cases = [c for c in CASES if c[0] == scheme]
    df = spark.createDataFrame(
        [c[1:] for c in cases], "days_inactive int, txn_last_90d int, txn_last_30d int, want string")
    for row in rows(df.withColumn("label", churn.churn_label(scheme))):
        assert row["label"] == row["want"], (scheme, row)


EDGES = {
    "rupee": {-1: "Negative", 0: "Negative", 10: "₹0–10", 11: "₹10–50", 50: "₹10–50", 100: "₹50–100",
              200: "₹100–200", 201: "₹200+"},
    "half_open": {-1: "Negative CLV", 0: "0 - 10", 10: "10 - 50", 50: "50 - 100", 100: "100 - 500",
                  500: "500+"},
    "right_closed": {0: "Negative", 10: "₹0-10", 50: "₹10-50", 500: "₹100-500", 501: "₹500+"},
}


@pytest.mark.parametrize("scheme", EDGES)
def test_value_bucket_edges(spark, scheme):
    df = spark.createDataFrame([(v,) for v in EDGES[scheme]], "x int")
    got = {r["x"]: r["b"] for r in rows(df.withColumn("b", clv.clv_bucket("x", scheme)))}
    assert got == EDGES[scheme]


def test_frequency_edges(spark):
    want = {1: "1 transaction", 2: "2-5 transactions", 5: "2-5 transactions", 6: "6-10 transactions",
            11: "11-20 transactions", 20: "11-20 transactions", 21: "20+ transactions"}
    df = spark.createDataFrame([(n,) for n in want], "n int")
    assert {r["n"]: r["b"] for r in rows(df.withColumn("b", behavior.freq_bucket("n")))} == want


def test_months_since_crosses_years(spark):
    df = spark.createDataFrame([("2024-11-30", "2025-02-01")], "a string, b string")
    got = df.select(months_since(F.to_date("b"), F.to_date("a")).alias("k")).first()["k"]
    assert got == 3
