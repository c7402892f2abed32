"""Dashboard measures: each function is a measure set under any grouping; slicers are filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, growth, lookup, money, month_index, month_key, month_of_index, month_start, pct,
    previous, ratio, rnd, successful, totals,
)
from paytally.functions.ordered import checkpointed
from paytally.operators import behavior
from paytally.operators.rollup import SUMS, sums


def _or_zero(c: Column) -> Column:
    """The measures show 0 where a denominator is zero."""
    return F.coalesce(c, F.lit(0.0))


def _base_columns(t: DataFrame, by: list[str]) -> DataFrame:
    return t.select(
        *by,
        money("gmv").alias("total_gmv"),
        money("mdr").alias("gross_mdr_income"),
        money("cashback").alias("total_cashback"),
        money("fee").alias("total_processing_cost"),
        money("net").alias("net_revenue"),
        _or_zero(pct("net", "gmv", 4)).alias("margin_pct"),
        _or_zero(ratio("gmv", "txn_count")).alias("avg_ticket_size"),
        F.col("txn_count").alias("total_transactions"),
        _or_zero(pct("cashback", "gmv", 4)).alias("cashback_pct_of_gmv"),
        _or_zero(pct("fee", "gmv", 4)).alias("processing_cost_pct_of_gmv"),
        _or_zero(ratio("net", "cost", 4)).alias("efficiency_ratio"),
    )


def base(f: DataFrame, by: list[str] = ()) -> DataFrame:
    return _base_columns(totals(successful(f), *by), list(by))


LEVEL = "level"


def level_of(dims: list[str], used: set[str]) -> int:
    """The grouping id of the level that keeps the ``used`` ones of ``dims``: a bit for each one left out."""
    return sum(1 << i for i, d in enumerate(reversed(dims)) if d not in used)


def lattice(f: DataFrame, dims: list[str], levels: list[set[str]] | None = None) -> DataFrame:
    """Additive measures for sets of dimensions (all subsets by default), told apart by ``level``.

    The fact is read once and combined by all dimensions; the sets are grouped from those few rows. Keep
    the result in a table: ``answer`` then serves any filter without the fact.
    """
    finest = sums(f, *dims)
    wanted = [set(d for i, d in enumerate(dims) if n >> i & 1) for n in range(1 << len(dims))] if levels is None else levels
    sets = [[F.col(d) for d in dims if d in level] for level in wanted]
    return finest.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.grouping_id(*dims).cast("long").alias(LEVEL))


def answer(table: DataFrame, dims: list[str], filters: dict[str, list] | None = None, by: list[str] = (),
           levels: list[set[str]] | None = None) -> DataFrame:
    """``base`` under ``filters`` (column to values) by ``by``, from the level with the fewest dimensions that
    has them all. ``levels`` lists what the table holds, if not all sets."""
    by, filters = list(by), filters or {}
    used = set(by) | set(filters)
    fit = [level for level in levels or [used] if used <= level]
    if not fit or not used <= set(dims):
        raise ValueError(f"no level answers {sorted(used)}")
    rows = table.filter(F.col(LEVEL) == level_of(dims, min(fit, key=lambda x: (len(x), sorted(x)))))
    for column, kept in filters.items():
        rows = rows.filter(F.col(column).isin(*kept))
    found = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS]).withColumns({
        "txn_count": F.coalesce("txn_count", F.lit(0)), "net": F.col("mdr") - F.col("cashback") - F.col("fee"),
        "cost": F.col("cashback") + F.col("fee")})
    return _base_columns(found, by)


def users(f: DataFrame) -> DataFrame:
    """User measures by month; ``mau_30d`` is the trailing 30-day count at the month's end.

    The fact is read once, for one row per customer and day; the rest reads those.
    """
    active = checkpointed(behavior.user_days(f))
    months = active.groupBy(month_start().alias("m")).agg(
        F.count(F.lit(1)).alias("user_days"),
        F.sum("n").alias("txns"),
        behavior.days_of_month("txn_date").alias("days"),
        F.countDistinct("customer_id").alias("users"),
    )
    trailing = behavior.trailing_users(f, 30, active).select(
        F.trunc("date", "MM").alias("m"), "date", F.col("users").alias("mau_30d")
    )
    ends = trailing.filter(F.col("date") == F.last_day("date"))
    mean = F.col("user_days") / F.col("days")
    return months.join(ends, "m").select(
        month_key("m").alias("month"),
        "mau_30d",
        F.col("users").alias("unique_customers"),
        rnd(mean, 4).alias("avg_dau"),
        _or_zero(pct(mean, "users", 4)).alias("stickiness_pct"),
        _or_zero(pct(mean, "mau_30d", 4)).alias("stickiness_30d_pct"),
        F.col("txns").alias("total_transactions"),
        _or_zero(ratio("txns", "users", 4)).alias("txns_per_user"),
    ).orderBy("month")


def users_overall(f: DataFrame) -> DataFrame:
    """Sum and mean of the monthly users, and the mean monthly stickiness."""
    months = behavior.stickiness(f, 10)
    return months.agg(
        F.sum("mau").alias("total_mau"),
        rnd(F.avg("mau"), 4).alias("average_mau"),
        rnd(F.avg("stickiness_pct"), 4).alias("average_stickiness_pct"),
    )


def prev_month(f: DataFrame) -> DataFrame:
    """Growth against the previous calendar month; NULL when that month has no payment."""
    now = totals(successful(f), month_index().alias("m")).select("m", "gmv", "net", "users")
    before = now.select(
        (F.col("m") + 1).alias("m"),
        *[F.col(c).alias(f"prev_{c}") for c in ("gmv", "net", "users")],
    )
    return now.join(before, "m", "left").select(
        month_of_index("m").alias("month"),
        money("gmv").alias("gmv"),
        money("prev_gmv").alias("prev_month_gmv"),
        growth("gmv", "prev_gmv").alias("gmv_mom_pct"),
        money("net").alias("net_revenue"),
        money("prev_net").alias("prev_month_revenue"),
        growth("net", "prev_net").alias("revenue_mom_pct"),
        F.col("users").alias("mau"),
        F.col("prev_users").alias("prev_month_mau"),
        growth("users", "prev_users").alias("mau_mom_pct"),
    ).orderBy("month")


def ytd(f: DataFrame) -> DataFrame:
    """Year-to-date GMV and revenue by day, from one row per day."""
    days = totals(successful(f), "txn_date").select("txn_date", "gmv", "net")
    year = Window.partitionBy(F.year("txn_date")).orderBy("txn_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return days.select(
        "txn_date",
        money(F.sum("gmv").over(year)).alias("gmv_ytd"),
        money(F.sum("net").over(year)).alias("revenue_ytd"),
    ).orderBy("txn_date")


def channel(f: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Channel measures; the share is of all payments, so unknown channels show as a NULL name."""
    named = lookup(successful(f), dim_channel, "channel_id", "channel_name", how="left")
    all_gmv = F.sum("gmv").over(Window.partitionBy())  # one row per channel
    return totals(named, "channel_name").select(
        "channel_name",
        money("net").alias("channel_net_revenue"),
        money("cost").alias("channel_total_cost"),
        _or_zero(ratio("net", "cost", 4)).alias("efficiency_ratio"),
        _or_zero(pct("gmv", all_gmv)).alias("gmv_share_pct"),
    )


def cashback(f: DataFrame, by: list[str] = ()) -> DataFrame:
    return totals(successful(f), *by).select(
        *by,
        _or_zero(ratio("gmv", "cashback")).alias("gmv_per_cashback_rupee"),
        _or_zero(pct("cashback", "gmv", 4)).alias("cashback_rate_pct"),
        F.col("cashback_txns").alias("cashback_transactions"),
        _or_zero(pct("cashback_txns", "txn_count")).alias("cashback_coverage_pct"),
    )


def success_rate(f: DataFrame, by: list[str] = ()) -> DataFrame:
    return totals(f, *by).select(
        *by, _or_zero(pct("success_txns", "txn_count")).alias("success_rate_pct")
    )


def latest_mom(f: DataFrame) -> DataFrame:
    """The last known month-over-month growth of net revenue."""
    months = by_month(successful(f)).select(
        "month", growth("net", previous("net", "month")).alias("mom")
    )
    known = months.filter(F.col("mom").isNotNull())
    return known.agg(
        F.max("month").alias("month"), F.max_by("mom", "month").alias("latest_revenue_mom_pct")
    )
