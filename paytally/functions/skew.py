"""Equi-joins that survive a hot key without a broadcast of either side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys))


def heavy_keys(big: DataFrame, keys: list[str], tasks: int, least: int = 1_000) -> DataFrame:
    """Keys with more rows than an even share: the key columns as ``_h_<key>`` and ``_slots``, the number of
    shares they fill.

    A share is the mean number of rows per task (``least`` at the smallest), so there are at most
    ``tasks`` heavy keys whatever the data. Counts are combined map-side: a hot key sends one row
    per map task.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.greatest(F.ceil(F.sum("_n") / F.lit(tasks)), F.lit(least)).alias("_share"))
    return (counts.join(F.broadcast(share), F.col("_n") > F.col("_share"))  # one row
            .select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                    F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_slots")))


def skewed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                spread: list[str] | None = None, tasks: int | None = None, least: int = 1_000) -> DataFrame:
    """``big.join(small, keys, how)`` (inner or left) with hot keys of ``big`` dealt over many tasks.

    Rows of a heavy key are salted by a hash of the ``spread`` columns (default: all of ``big``) and the
    matching rows of ``small`` copied once per salt; all other rows keep salt 0. NULL keys never
    match; their rows are dealt like any others, so that a left join cannot gather them in one task.
    Only the heavy keys are broadcast, at most ``tasks`` rows by construction.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    n = tasks or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(big, keys, n, least))  # at most n rows
    slots, marked = F.coalesce(F.col("_slots"), F.lit(1)), [f"_h_{k}" for k in keys]
    salt = F.pmod(F.xxhash64(*(spread or big.columns)), slots).cast("int")
    left = big.join(heavy, _same(keys, "_h_"), "left").withColumn("_salt", salt).drop("_slots", *marked)
    copies = F.explode(F.sequence(F.lit(0), slots - 1))
    right = small.join(heavy, _same(keys, "_h_"), "left").withColumn("_salt", copies).drop("_slots", *marked)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
