"""Column builders shared by the operators.

Money stays decimal until the final ratio. ``totals`` is the one aggregation behind most operators:
it computes every standard measure, and Catalyst prunes the measures an operator does not select.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS, FAILED, PENDING = "SUCCESS", "FAILED", "PENDING"

_CENT = Decimal("0.01")


# --- filters -----------------------------------------------------------------------------------


def successful(f: DataFrame) -> DataFrame:
    return f.filter(F.col("status") == SUCCESS)


def amount_at_most(f: DataFrame, cap: float) -> DataFrame:
    return f.filter(F.col("amount") <= F.lit(Decimal(str(cap))))


def within_last(day: str | Column, days: int, ref: Column) -> Column:
    """``day`` lies at most ``days`` days before ``ref`` (or after it)."""
    return _col(day) >= F.date_sub(ref, days)


def between_dates(day: str | Column, start: str, end: str) -> Column:
    return _col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


# --- derived columns ---------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mdr_revenue() -> Column:
    return F.col("mdr_pct") * F.col("amount") * F.lit(_CENT)


def net_revenue() -> Column:
    return mdr_revenue() - F.col("cashback_amt") - F.col("processing_fee_amt")


def with_revenue(f: DataFrame) -> DataFrame:
    return f.withColumns({"mdr_revenue": mdr_revenue(), "net_revenue": net_revenue()})


def is_success() -> Column:
    return F.when(F.col("status") == SUCCESS, 1).otherwise(0)


def with_success_flag(f: DataFrame) -> DataFrame:
    return f.withColumn("is_success", is_success())


# --- dates -------------------------------------------------------------------------------------


def month_start(day: str | Column = "txn_date") -> Column:
    """First day of the month; group by this and format after the aggregation."""
    return F.trunc(_col(day), "MM")


def month_key(day: str | Column = "txn_date") -> Column:
    return F.date_format(_col(day), "yyyy-MM")


def hour_key(ts: str | Column = "txn_ts") -> Column:
    return F.hour(_col(ts))


def month_num(day: str | Column = "txn_date") -> Column:
    return F.month(_col(day))


def month_index(day: str | Column = "txn_date") -> Column:
    """Months since year 0, an integer that is cheap to group by and to subtract."""
    return F.year(_col(day)) * 12 + F.month(_col(day)) - 1


def months_since(day: str | Column, origin: str | Column) -> Column:
    return month_index(day) - month_index(origin)


def month_of_index(index: str | Column) -> Column:
    """Inverse of ``month_index`` as ``yyyy-MM`` text."""
    i = _col(index)
    year, month = F.floor(i / 12), F.pmod(i, F.lit(12)) + 1
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def days_since(ref: Column, day: str | Column) -> Column:
    return F.datediff(ref, _col(day))


# --- ratios ------------------------------------------------------------------------------------


def dbl(c: str | Column) -> Column:
    return _col(c).cast("double")


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Double quotient, NULL when the denominator is zero."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def rnd(x: str | Column, digits: int = 2) -> Column:
    """Round a double half away from zero, deciding on the scaled value. 675823.47 / 14, stored just
    below 48273.105, rounds to 48273.11 as in decimal arithmetic."""
    scale = float(10**digits)
    return F.round(_col(x) * scale, 0) / scale


def pct(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    return rnd(safe_div(num, den) * 100, digits)


def ratio(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    return rnd(safe_div(num, den), digits)


def money(c: str | Column, digits: int = 2) -> Column:
    """Round an exact decimal and hand it out as double."""
    return dbl(F.round(_col(c), digits))


def growth(current: str | Column, previous: str | Column, digits: int | None = 2) -> Column:
    """Percentage change, NULL without a previous value or when it is zero."""
    change = (dbl(current) - dbl(previous)) / F.nullif(dbl(previous), F.lit(0.0)) * 100
    return change if digits is None else rnd(change, digits)


def share(c: str, *within: str, digits: int = 2) -> Column:
    """Per cent of the total; use on aggregated rows only."""
    return pct(c, F.sum(c).over(Window.partitionBy(*within)), digits)


def previous(c: str, order: str, *within: str) -> Column:
    return F.lag(c).over(Window.partitionBy(*within).orderBy(order))


# --- aggregation -------------------------------------------------------------------------------


def totals(f: DataFrame, *by: str | Column, more: tuple[Column, ...] = ()) -> DataFrame:
    """Standard measures by key. Decimal sums keep full precision; unused ones are pruned. ``more`` adds named
    aggregates to the same pass; they must not be distinct counts.

    Net revenue is linear in its parts, so it is derived once per group instead of once per row.
    The single distinct count is planned by Spark as a two-level aggregate on (key, customer), which
    spreads a hot key over all tasks.
    """
    ok = F.col("status") == SUCCESS
    return (
        f.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.sum("amount").alias("gmv"),
            F.sum(mdr_revenue()).alias("mdr"),
            F.sum("cashback_amt").alias("cashback"),
            F.sum("processing_fee_amt").alias("fee"),
            F.min("processing_fee_amt").alias("min_fee"),
            F.max("processing_fee_amt").alias("max_fee"),
            F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount"),
            F.sum("mdr_pct").alias("mdr_pct_sum"),
            F.count_if(F.col("cashback_amt") > 0).alias("cashback_txns"),
            F.count_if(F.col("cashback_amt") == 0).alias("no_cashback_txns"),
            F.sum(F.when(F.col("cashback_amt") > 0, F.col("amount")).otherwise(0)).alias(
                "cashback_gmv"
            ),
            F.sum(F.when(F.col("cashback_amt") == 0, F.col("amount")).otherwise(0)).alias(
                "no_cashback_gmv"
            ),
            F.count_if(ok).alias("success_txns"),
            F.count_if(F.col("status") == FAILED).alias("failed_txns"),
            F.count_if(F.col("status") == PENDING).alias("pending_txns"),
            F.sum(F.when(ok, F.col("amount"))).alias("success_gmv"),
            F.sum(F.when(ok, F.col("processing_fee_amt"))).alias("success_fee"),
            F.sum(F.when(ok, F.col("retry_count"))).alias("success_retries"),
            F.min("txn_date").alias("first_date"),
            F.max("txn_date").alias("last_date"),
            F.countDistinct("customer_id").alias("users"),
            *more,
        )
        .withColumns(
            {
                "net": F.col("mdr") - F.col("cashback") - F.col("fee"),
                "cost": F.col("cashback") + F.col("fee"),
            }
        )
    )


def by_month(f: DataFrame, *more: str) -> DataFrame:
    """``totals`` by month start, ``month`` formatted afterwards (``month_date`` keeps the date)."""
    return totals(f, month_start().alias("month_date"), *more).withColumn(
        "month", month_key("month_date")
    )


def lookup(f: DataFrame, dim: DataFrame, key: str, *columns: str, how: str = "inner") -> DataFrame:
    """Add dimension columns. Without a hint Spark broadcasts the dimension while its size stays
    below ``spark.sql.autoBroadcastJoinThreshold``; beyond that AQE shuffles and splits hot keys."""
    return f.join(dim.select(key, *columns), key, how)
