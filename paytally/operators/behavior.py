"""User activity: daily and monthly users, stickiness, frequency, time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    hour_key, money, month_index, month_key, month_num, month_of_index, month_start, pct, ratio,
    share, successful, totals, within_last,
)
from paytally.functions.ordered import by_ntile, checkpointed, tiled


def user_days(f: DataFrame) -> DataFrame:
    """One row per customer and active day; the base of every activity measure."""
    return successful(f).groupBy("customer_id", "txn_date").agg(F.count(F.lit(1)).alias("n"))


def user_months(f: DataFrame) -> DataFrame:
    """One row per customer and active month, with the customer's first month.

    The first aggregate spreads a busy customer over all map tasks; the window then sees at most one
    row per customer and month.
    """
    months = successful(f).groupBy("customer_id", month_index().alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return months.withColumn("first_m", F.min("m").over(Window.partitionBy("customer_id")))


def dau(f: DataFrame, last_days: int | None = None, limit: int | None = None) -> DataFrame:
    """Daily active users: all days, the days since ``last_days`` before the last date of the
    table, or the last ``limit`` days."""
    s = successful(f)
    if last_days is not None:
        last = f.agg(F.max("txn_date").alias("_last"))
        s = s.crossJoin(F.broadcast(last)).filter(  # one row
            within_last("txn_date", last_days, F.col("_last"))
        )
    days = s.groupBy("txn_date").agg(F.countDistinct("customer_id").alias("dau"))
    if limit is not None:
        return days.orderBy(F.desc("txn_date")).limit(limit)
    return days.orderBy("txn_date")


def days_of_month(date: str) -> Column:
    """Distinct dates within one month: a set of at most 31, so that a second distinct count in the same
    aggregate does not multiply the rows."""
    return F.size(F.collect_set(date)).cast("long")


def _months(f: DataFrame) -> DataFrame:
    return user_days(f).groupBy(month_start().alias("m")).agg(
        F.count(F.lit(1)).alias("user_days"),
        days_of_month("txn_date").alias("days"),
        F.countDistinct("customer_id").alias("mau"),
    )


def avg_dau(f: DataFrame) -> DataFrame:
    return _months(f).select(
        month_key("m").alias("month"), ratio("user_days", "days", 0).alias("avg_dau")
    ).orderBy("month")


def stickiness(f: DataFrame, digits: int = 2) -> DataFrame:
    """Mean daily users over monthly users; the mean is rounded before the ratio is taken."""
    mean = ratio("user_days", "days", digits)
    return _months(f).select(
        month_key("m").alias("month"),
        "mau",
        mean.alias("avg_dau"),
        pct(mean, "mau", digits).alias("stickiness_pct"),
    ).orderBy("month")


def new_returning(f: DataFrame, unit: str = "users") -> DataFrame:
    """New and returning customers by month, or their transactions with ``unit='txns'``."""
    weight = {"users": F.lit(1), "txns": F.col("n")}[unit]
    new = F.col("m") == F.col("first_m")
    months = user_months(f).groupBy("m").agg(
        F.count(F.lit(1)).alias("total_active"),
        F.sum(F.when(new, weight).otherwise(0)).cast("long").alias("new"),
        F.sum(F.when(~new, weight).otherwise(0)).cast("long").alias("returning"),
    )
    named = months.select(
        month_of_index("m").alias("month"),
        "total_active",
        F.col("new").alias(f"new_{unit}"),
        F.col("returning").alias(f"returning_{unit}"),
    )
    if unit == "users":
        named = named.withColumn("returning_pct", pct("returning_users", "total_active"))
    return named.orderBy("month")


# Upper edge (inclusive) and label of the frequency buckets.
FREQUENCY = [(1, "1 transaction"), (5, "2-5 transactions"), (10, "6-10 transactions"),
             (20, "11-20 transactions"), (None, "20+ transactions")]


def freq_bucket(count: str):
    """Label a transaction count."""
    (edge, label), *rest = FREQUENCY
    out = F.when(F.col(count) <= edge, label)
    for edge, label in rest:
        out = out.otherwise(label) if edge is None else out.when(F.col(count) <= edge, label)
    return out


def frequency_buckets(f: DataFrame) -> DataFrame:
    users = successful(f).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    buckets = users.groupBy(freq_bucket("n").alias("frequency_bucket")).agg(
        F.count(F.lit(1)).alias("user_count"), F.min("n").alias("_first")
    )
    return buckets.withColumn("pct", share("user_count")).orderBy("_first").drop("_first")


def deciles(f: DataFrame, n: int = 10) -> DataFrame:
    """Customers in ``n`` equal groups by spend, biggest spenders first."""
    users = checkpointed(
        successful(f).groupBy("customer_id").agg(F.sum("amount").alias("spent"))
    )
    groups = tiled(users, "customer_id", decile=by_ntile("spent", n, desc=True))
    return (
        groups.groupBy("decile")
        .agg(F.count(F.lit(1)).alias("user_count"), F.sum("spent").alias("gmv"))
        .select(
            "decile", "user_count", money("gmv").alias("total_gmv"),
            ratio("gmv", "user_count").alias("avg_gmv_per_user"),
            share("gmv").alias("gmv_share_pct"),
        )
        .orderBy("decile")
    )


def hourly(f: DataFrame) -> DataFrame:
    return totals(successful(f), hour_key().alias("hour_of_day")).select(
        "hour_of_day", "txn_count", money("gmv").alias("gmv"), F.col("users").alias("unique_users")
    ).orderBy("hour_of_day")


def hour_month_matrix(f: DataFrame) -> DataFrame:
    """Payments by hour (rows) and calendar month (columns ``m1``..``m12``)."""
    counts = (
        successful(f)
        .groupBy(hour_key().alias("hour"), month_num().alias("m"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = counts.groupBy("hour").pivot("m", list(range(1, 13))).agg(F.sum("n")).na.fill(0)
    return wide.select("hour", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]).orderBy("hour")


def trailing_users(f: DataFrame, days: int = 30, active: DataFrame | None = None) -> DataFrame:
    """Distinct customers in the ``days`` days up to each date, without expanding rows. ``active`` may give
    ``user_days`` where they are stored already.

    An active day keeps a customer in the count for ``days`` days or until the next active day,
    whichever is earlier. Each such stretch is +1 at its start and -1 after its end; a running total
    over the calendar (one row per date) gives the count. The dates run to the end of the last month.
    """
    history = Window.partitionBy("customer_id").orderBy("txn_date")
    expiry = F.date_add("txn_date", days)
    stretch = (user_days(f) if active is None else active).select(
        "txn_date",
        F.least(expiry, F.coalesce(F.lead("txn_date").over(history), expiry)).alias("until"),
    )
    edges = stretch.select(
        F.explode(
            F.array(
                F.struct(F.col("txn_date").alias("date"), F.lit(1).alias("step")),
                F.struct(F.col("until").alias("date"), F.lit(-1).alias("step")),
            )
        ).alias("e")
    ).groupBy("e.date").agg(F.sum("e.step").alias("step"))
    span = (successful(f) if active is None else active).agg(
        F.min("txn_date").alias("a"), F.max("txn_date").alias("b"))
    dates = span.select(F.explode(F.sequence("a", F.last_day("b"))).alias("date"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    users = F.sum(F.coalesce("step", F.lit(0))).over(upto)
    return dates.join(edges, "date", "left").select("date", users.alias("users")).orderBy("date")
