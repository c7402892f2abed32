"""Cohorts by month of the first SUCCESS payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    money, month_key, month_of_index, month_start, net_revenue, pct, ratio, rnd, safe_div,
    successful,
)
from paytally.operators.behavior import user_months


def assign(f: DataFrame) -> DataFrame:
    first = successful(f).groupBy("customer_id").agg(F.min("txn_date").alias("first_txn_date"))
    return first.select(
        "customer_id", month_key("first_txn_date").alias("cohort_month"), "first_txn_date"
    )


def activity(f: DataFrame) -> DataFrame:
    return user_months(f).select(
        "customer_id",
        month_of_index("first_m").alias("cohort_month"),
        month_of_index("m").alias("activity_month"),
        (F.col("m") - F.col("first_m")).alias("months_since_cohort"),
    )


def sizes(f: DataFrame) -> DataFrame:
    return assign(f).groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("cohort_size")
    ).orderBy("cohort_month")


def _cells(f: DataFrame) -> DataFrame:
    """Active customers per cohort and month offset. Every customer is active at offset 0, so the
    cohort size is the count of that cell (a window over the few cells of a cohort)."""
    cells = (
        user_months(f)
        .groupBy("first_m", (F.col("m") - F.col("first_m")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("users"))
    )
    size = F.max(F.when(F.col("offset") == 0, F.col("users"))).over(Window.partitionBy("first_m"))
    return cells.withColumn("size", size)


def retention(f: DataFrame, max_month: int = 11, months: list[int] | None = None,
              digits: int = 2) -> DataFrame:
    """Long retention table for offsets 0..``max_month`` or the listed offsets."""
    wanted = (
        F.col("offset").isin(months) if months else F.col("offset").between(0, max_month)
    )
    return _cells(f).filter(wanted).select(
        month_of_index("first_m").alias("cohort_month"),
        F.col("size").alias("cohort_size"),
        F.col("offset").alias("months_since_cohort"),
        F.col("users").alias("retained_users"),
        pct("users", "size", digits).alias("retention_pct"),
    ).orderBy("cohort_month", "months_since_cohort")


# Column prefix and month offset; the "month 12" milestone reads offset 11.
MILESTONES = {"month1": 1, "month3": 3, "month6": 6, "month12": 11}


def milestones(f: DataFrame, at: dict[str, int] = MILESTONES, fill: float | None = None) -> DataFrame:
    """Retention at chosen offsets, one row per cohort; ``fill`` replaces missing offsets."""
    wide = _cells(f).groupBy("first_m", "size").agg(
        *[F.max(F.when(F.col("offset") == k, F.col("users"))).alias(n) for n, k in at.items()]
    )

    def value(name):
        p = pct(name, "size")
        return (p if fill is None else F.coalesce(p, F.lit(float(fill)))).alias(
            f"{name}_retention_pct"
        )

    return wide.select(
        month_of_index("first_m").alias("cohort_month"),
        F.col("size").alias("cohort_size"),
        *[value(n) for n in at],
    ).orderBy("cohort_month")


def average(f: DataFrame, max_month: int = 11) -> DataFrame:
    """Mean retention per offset, every cohort counting once."""
    return (
        _cells(f)
        .filter(F.col("offset").between(0, max_month))
        .groupBy(F.col("offset").alias("months_since_cohort"))
        .agg(
            rnd(F.avg(safe_div("users", "size") * 100), 2).alias("avg_retention_pct"),
            F.sum("users").alias("total_retained"),
            F.sum("size").alias("total_cohort_size"),
        )
        .orderBy("months_since_cohort")
    )


def revenue(f: DataFrame) -> DataFrame:
    """Lifetime net revenue per cohort from one aggregate per customer, without a self-join."""
    customers = successful(f).groupBy("customer_id").agg(
        F.min("txn_date").alias("first"), F.sum(net_revenue()).alias("net")
    )
    return (
        customers.groupBy(month_start("first").alias("m"))
        .agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("size"))
        .select(
            month_key("m").alias("cohort_month"),
            money("net").alias("cohort_lifetime_revenue"),
            F.col("size").alias("cohort_size"),
            ratio("net", "size", 4).alias("revenue_per_user"),
        )
        .orderBy("cohort_month")
    )


def matrix(f: DataFrame, months: int = 12) -> DataFrame:
    """Retention per cohort (rows) and offset (columns ``month_0``..), 0 where nobody came back."""
    offsets = list(range(months))
    wide = _cells(f).groupBy("first_m", "size").pivot("offset", offsets).agg(F.max("users"))
    return wide.select(
        month_of_index("first_m").alias("cohort_month"),
        *[F.coalesce(pct(str(k), "size"), F.lit(0.0)).alias(f"month_{k}") for k in offsets],
    ).orderBy("cohort_month")


# --- activity as bit masks ---------------------------------------------------------------------

WIDTH = 63  # months per mask: all bits of a long but its sign


def masks(f: DataFrame) -> DataFrame:
    """One row per customer: ``_m0``, ``_m1``, ... with a bit per month of a SUCCESS payment, ``_base`` the month
    number of the lowest bit.

    Masks are joined by OR map-side, so one row per customer and task is shuffled, whatever the activity.
    """
    s = successful(f).select("customer_id", (F.year("txn_date") * 12 + F.month("txn_date") - 1).alias("_i"))
    span = s.agg(F.min("_i").alias("lo"), F.max("_i").alias("hi")).first()  # one row
    low, high = (0, 0) if span["lo"] is None else (span["lo"], span["hi"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_i") - low) % WIDTH)
    blocks = range((high - low) // WIDTH + 1)
    return s.groupBy("customer_id").agg(*[
        F.coalesce(F.bit_or(F.when(F.floor((F.col("_i") - low) / WIDTH) == b, bit)), F.lit(0).cast("long")).alias(f"_m{b}")
        for b in blocks]).withColumn("_base", F.lit(low))


def _bit(names: list[str], at: Column) -> Column:
    """Whether bit ``at`` is set, counted through all masks; beyond them no bit is set."""
    mask = F.element_at(F.array(*names, F.lit(0).cast("long")),
                        (F.least(F.floor(at / WIDTH), F.lit(len(names))) + 1).cast("int"))
    return F.call_function("shiftright", mask, (at % WIDTH).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _first_bit(names: list[str]) -> Column:
    """Number of the lowest set bit: the set bits below it in (mask & -mask) - 1."""
    found = [F.when(F.col(n) != 0, F.bit_count(F.col(n).bitwiseAND(-F.col(n)) - 1) + i * WIDTH) for i, n in enumerate(names)]
    return F.coalesce(*found)


def retention_by_masks(f: DataFrame, max_month: int = 11, digits: int = 2) -> DataFrame:
    """``retention`` from the masks: months since the first bit are shifts, cohorts count bits."""
    rows = masks(f)
    names = [c for c in rows.columns if c.startswith("_m")]
    rows = rows.withColumn("_first", _first_bit(names))
    counts = rows.groupBy((F.col("_base") + F.col("_first")).alias("first_m")).agg(
        F.count(F.lit(1)).alias("size"),
        *[F.sum(_bit(names, F.col("_first") + k)).alias(f"u{k}") for k in range(max_month + 1)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), F.col(f"u{k}").alias("users"))
                                for k in range(max_month + 1)]))
    return counts.select("first_m", "size", cells.alias("c")).select("first_m", "size", "c.*").filter("users > 0").select(
        month_of_index("first_m").alias("cohort_month"), F.col("size").alias("cohort_size"),
        F.col("offset").alias("months_since_cohort"), F.col("users").alias("retained_users"),
        pct("users", "size", digits).alias("retention_pct"),
    ).orderBy("cohort_month", "months_since_cohort")


def activity_by_masks(f: DataFrame) -> DataFrame:
    """``activity`` from the masks: one row per set bit."""
    rows = masks(f)
    names = [c for c in rows.columns if c.startswith("_m")]
    months = F.filter(F.sequence(F.lit(0), F.lit(len(names) * WIDTH - 1)), lambda i: _bit(names, i) == 1)
    return rows.withColumn("_first", _first_bit(names)).select(
        "customer_id", "_base", "_first", F.explode(months).alias("_at")).select(
        "customer_id", month_of_index(F.col("_base") + F.col("_first")).alias("cohort_month"),
        month_of_index(F.col("_base") + F.col("_at")).alias("activity_month"),
        (F.col("_at") - F.col("_first")).alias("months_since_cohort"))
