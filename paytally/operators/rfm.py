"""Recency, frequency, monetary: base, scores, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    days_since, dbl, lookup, money, month_start, net_revenue, ratio, rnd, share, successful,
)
from paytally.functions.ordered import (
    by_ntile, by_rank_bin, checkpointed, kth_values, percentiles, tiled,
)

ID = "customer_id"


def reference_date(f: DataFrame, ref: str | None = None) -> DataFrame:
    """One row ``ref``: the given date, or the last SUCCESS date."""
    if ref is None:
        return successful(f).agg(F.max("txn_date").alias("ref"))
    return f.sparkSession.range(0, 1, 1, 1).select(F.lit(ref).cast("date").alias("ref"))


def base(f: DataFrame, ref: str | None = None) -> DataFrame:
    """One row per customer. Unused measures are pruned, so select before caching."""
    customers = successful(f).groupBy(ID).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("amount").alias("monetary"),
        F.sum(net_revenue()).alias("net_revenue"),
        F.min("txn_date").alias("first_txn_date"),
        F.max("txn_date").alias("last_txn_date"),
        F.countDistinct(month_start()).alias("active_months"),
    )
    return customers.crossJoin(F.broadcast(reference_date(f, ref))).select(  # one row
        ID,
        "last_txn_date",
        days_since(F.col("ref"), "last_txn_date").alias("recency_days"),
        "frequency",
        "monetary",
        ratio("monetary", "frequency").alias("avg_order_value"),
        "first_txn_date",
        "active_months",
        "net_revenue",
    )


def preview(rfm_base: DataFrame, k: int = 20) -> DataFrame:
    """The biggest spenders."""
    return rfm_base.orderBy(F.desc("monetary"), ID).limit(k)


# Segment labels with the inclusive score ranges of R, F and M; first match wins.
# ``None`` is an open end.
ANY = (None, None)
SEGMENTS = {
    "ntile4": (
        [
            ("Champions", (4, 4), (4, 4), (4, 4)),
            ("Loyal Customers", (3, None), (3, None), ANY),
            ("Recent Customers", (4, 4), (None, 2), ANY),
            ("Promising", (3, None), (4, 4), ANY),
            ("Customers Needing Attention", (2, None), (2, None), (2, None)),
            ("At Risk", (2, 2), (None, 2), ANY),
            ("Cannot Lose Them", (1, 1), (2, None), ANY),
            ("Lost Customers", (1, 1), (1, 1), ANY),
        ],
        "Hibernating",
    ),
    "qcut4": (
        [
            ("Champions", (4, 4), (4, 4), (4, 4)),
            ("Loyal Customers", (3, None), (3, None), ANY),
            ("Recent Customers", (4, 4), (None, 2), ANY),
            ("Needs Attention", (2, None), (2, None), (2, None)),
            ("At Risk", (2, 2), (None, 2), ANY),
            ("Cannot Lose", (1, 1), (2, None), ANY),
            ("Lost", (1, 1), (1, 1), ANY),
        ],
        "Hibernating",
    ),
    "ntile5": (
        [
            ("Champions", (4, None), (4, None), (4, None)),
            ("Loyal Users", (3, None), (3, None), ANY),
            ("New Customers", (4, None), (None, 2), ANY),
            ("Potential Loyalists", (3, None), (None, 2), ANY),
            ("At Risk", (None, 2), (3, None), ANY),
            ("Cannot Lose Them", (None, 2), (None, 2), (3, None)),
            ("Lost Customers", (1, 1), (1, 1), ANY),
        ],
        "Hibernating",
    ),
    "kth4": (
        [
            ("Champions", (4, 4), (4, 4), (4, 4)),
            ("Loyal Customers", (3, None), (3, None), ANY),
            ("New Customers", (4, 4), (None, 2), ANY),
            ("Potential Loyalists", (3, None), (None, 2), (3, None)),
            ("At Risk", (2, 2), (3, None), ANY),
            ("Cant Lose Them", (None, 2), (None, 2), (3, None)),
            ("Lost Customers", (None, 2), (None, 2), (None, 2)),
            ("Hibernating", (1, 1), ANY, ANY),
        ],
        "Needs Attention",
    ),
}
SEGMENTS["qcut5"] = SEGMENTS["ntile5"]


def _inside(score: str, low: int | None, high: int | None) -> Column:
    c = F.col(score)
    test = F.lit(True)
    if low is not None:
        test = test & (c >= low)
    return test if high is None else test & (c <= high)


def rfm_label(scheme: str) -> Column:
    rules, default = SEGMENTS[scheme]
    out = None
    for label, r, f, m in rules:
        hit = _inside("r_score", *r) & _inside("f_score", *f) & _inside("m_score", *m)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


QUARTERS = {"p25": "0.25", "p50": "0.50", "p75": "0.75"}


def _threshold_scores(df: DataFrame, **columns: tuple[str, bool]) -> DataFrame:
    """Scores 4..1 against the quartile values of each column, equal values scoring alike."""
    limits = kth_values(df, [c for c, _ in columns.values()], QUARTERS)  # one row

    def score_of(c: str, low_is_good: bool) -> Column:
        x, p25, p50, p75 = F.col(c), *[F.col(f"{c}_{q}") for q in QUARTERS]
        if low_is_good:
            best = F.when(x <= p25, 4).when(x <= p50, 3).when(x <= p75, 2)
        else:
            best = F.when(x >= p75, 4).when(x >= p50, 3).when(x >= p25, 2)
        return best.otherwise(1)

    scores = {out: score_of(c, low) for out, (c, low) in columns.items()}
    return df.crossJoin(F.broadcast(limits)).withColumns(scores).drop(*limits.columns)


def _value_bins(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Bins with right-closed edges at the interpolated quantiles of the values."""
    probs = {f"_e{i}": i / k for i in range(1, k)}
    edges = F.broadcast(percentiles(df, value, probs))  # one row
    bins = F.lit(1)
    for e in probs:
        bins = bins + F.when(F.col(value) > F.col(e), 1).otherwise(0)
    return df.crossJoin(edges).withColumn(out, bins).drop(*probs)


def score(b: DataFrame, scheme: str) -> DataFrame:
    """Add ``r_score``, ``f_score``, ``m_score``. ``b`` is a checkpointed base."""
    days, count, spend = "recency_days", "frequency", "monetary"
    if scheme == "kth4":
        return _threshold_scores(
            b, r_score=(days, True), f_score=(count, False), m_score=(spend, False)
        )
    k = 5 if scheme.endswith("5") else 4
    cut = by_rank_bin if scheme.startswith("qcut") else by_ntile
    tiles = {"f_score": cut(count, k), "m_score": cut(spend, k)}
    flip = F.lit(k + 1) - F.col("r_score")  # few days score high
    if scheme == "ntile5":
        return tiled(b, ID, r_score=by_ntile(days, k, desc=True), **tiles)
    if scheme in ("ntile4", "qcut4"):
        return tiled(b, ID, r_score=cut(days, k), **tiles).withColumn("r_score", flip)
    if scheme == "qcut5":
        binned = _value_bins(tiled(b, ID, **tiles), days, k, "r_score")
        return binned.withColumn("r_score", flip)
    if scheme == "mixed4":
        return _threshold_scores(tiled(b, ID, **tiles), r_score=(days, True))
    raise ValueError(f"unknown RFM scheme: {scheme}")


def segment(rfm_base: DataFrame, scheme: str = "ntile4") -> DataFrame:
    """Scores and, except for the score-only scheme ``mixed4``, the segment label.

    The base is computed once into the checkpoint folder; scoring then reads that small table.
    """
    b = checkpointed(
        rfm_base.select(
            ID, "last_txn_date", "recency_days", "frequency", "monetary", "avg_order_value",
            "net_revenue",
        )
    )
    scored = score(b, scheme).withColumns(
        {
            "rfm_score": F.concat("r_score", "f_score", "m_score"),
            "rfm_total": F.col("r_score") + F.col("f_score") + F.col("m_score"),
        }
    )
    return scored if scheme == "mixed4" else scored.withColumn("segment", rfm_label(scheme))


def summary(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("monetary").alias("gmv"),
            F.sum("net_revenue").alias("net"),
            F.sum("recency_days").alias("recency"),
            F.sum("frequency").alias("freq"),
            F.avg("avg_order_value").alias("aov"),
        )
        .select(
            "segment",
            "customer_count",
            share("customer_count").alias("pct_customers"),
            money("gmv").alias("total_gmv"),
            ratio("gmv", "customer_count").alias("avg_gmv"),
            share("gmv").alias("pct_gmv"),
            ratio("recency", "customer_count", 1).alias("avg_recency_days"),
            ratio("freq", "customer_count", 1).alias("avg_frequency"),
            rnd("aov", 2).alias("avg_order_value"),
            money("net").alias("total_revenue"),
        )
        .orderBy(F.desc("total_gmv"))
    )


def score_cells(segments: DataFrame) -> DataFrame:
    keys = ["r_score", "f_score", "m_score"]
    return (
        segments.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("monetary").alias("gmv"))
        .select(*keys, "customer_count", ratio("gmv", "customer_count").alias("avg_monetary"))
        .orderBy(*[F.desc(k) for k in keys])
    )


def top_segment(segments: DataFrame, label: str = "Champions", k: int = 50) -> DataFrame:
    return (
        segments.filter(F.col("segment") == label)
        .orderBy(F.desc("monetary"), ID)
        .limit(k)
        .select(
            ID, "segment", "recency_days", "frequency", money("monetary").alias("monetary"),
            F.col("avg_order_value").alias("aov"),
        )
    )


# The segments of the alert list.
ALERT = ["Cannot Lose Them", "At Risk"]


def priority(segments: DataFrame, dim_customer: DataFrame, labels: list[str] = ALERT,
             k: int = 100) -> DataFrame:
    listed = lookup(segments.filter(F.col("segment").isin(labels)), dim_customer, ID, "city_id")
    return listed.orderBy(F.desc("monetary"), ID).limit(k).select(
        ID, "segment", "recency_days", "frequency",
        money("monetary").alias("lifetime_spend"), "city_id",
    )


def snapshot(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("user_count")).orderBy(
        F.desc("user_count")
    )


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """User counts of two snapshots side by side."""
    old = before.select("segment", F.col("user_count").alias("users_before"))
    new = after.select("segment", F.col("user_count").alias("users_after"))
    zero = {"users_before": 0, "users_after": 0}
    return old.join(new, "segment", "full_outer").na.fill(zero).withColumn(
        "change", F.col("users_after") - F.col("users_before")
    )


def extract(f: DataFrame, dim_customer: DataFrame, ref: str | None = None) -> DataFrame:
    """Customer extract with quintile scores and the customer's own segment tag."""
    segments = segment(base(f, ref), "qcut5")
    tagged = lookup(segments, dim_customer, ID, "segment_tag", how="left")
    return tagged.select(
        ID, "last_txn_date", "frequency", dbl("monetary").alias("monetary"),
        dbl("net_revenue").alias("net_revenue"), "recency_days", "r_score", "f_score", "m_score",
        "rfm_total", F.col("segment").alias("rfm_segment"), "segment_tag",
    )
