"""Bands of ratios, means and scenarios without resampling units.

A ratio of two sums moves, to first order, by the sum of the rows' residuals. Resampling rows with
independent Poisson(1) counts therefore gives it the variance ``sum((x - r y)^2) / sum(y)^2``, which
follows from five sums of one scan: no replicates, no units, and only the columns of x and y are read.
``poisson_replicates`` is the resampling itself, row by row, for statistics that are far from linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    dbl, lookup, mdr_revenue, net_revenue, rnd, safe_div, successful,
)
from paytally.operators.whatif import CASHBACK_ELASTICITY, GRIDS, MDR_NOISE


def _z(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def ratio_band(s: DataFrame, num: Column, den: Column, by: list[str] = (), min_n: int = 0,
               scale: float = 100.0, level: float = 0.95) -> DataFrame:
    """n, observed sum(num) / sum(den) * scale and its band, per key; keys with fewer than ``min_n`` rows go.

    A single row, or a denominator of zero, has no band.
    """
    by = list(by)
    x, y = dbl("_x"), dbl("_y")
    one = s.select(*by, num.alias("_x"), den.alias("_y")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"),
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"),
    ).filter(F.col("n") >= min_n)
    r = safe_div("sx", "sy")
    spread = F.col("xx") - 2 * F.col("r") * F.col("xy") + F.col("r") * F.col("r") * F.col("yy")
    width = _z(level) * F.sqrt(F.greatest(spread, F.lit(0.0))) / F.abs(dbl("sy"))
    return one.withColumn("r", r).withColumn("w", F.when(F.col("n") > 1, width)).select(
        *by, "n", rnd(F.col("r") * scale, 4).alias("observed"),
        rnd((F.col("r") - F.col("w")) * scale, 4).alias("ci_low"),
        rnd((F.col("r") + F.col("w")) * scale, 4).alias("ci_high"))


def margin_band(f: DataFrame, **options) -> DataFrame:
    return ratio_band(successful(f), net_revenue(), F.col("amount"), **options)


def mean_band(f: DataFrame, column: str = "amount", **options) -> DataFrame:
    known = successful(f).filter(F.col(column).isNotNull())
    return ratio_band(known, F.col(column), F.lit(1), scale=1.0, **options)


def channel_margin_band(f: DataFrame, dim_channel: DataFrame, min_n: int = 100, **options) -> DataFrame:
    """Keyed by channel before the names are joined, one row per channel."""
    found = ratio_band(successful(f), net_revenue(), F.col("amount"), ["channel_id"], min_n, **options)
    return lookup(found, dim_channel, "channel_id", "channel_name").drop("channel_id")


PARTS = ("gmv", "mdr", "cashback", "fee")


def _moments(f: DataFrame) -> DataFrame:
    """One row: sums of the four parts of net revenue (``s_``) and of their products (``p_a_b``)."""
    rows = successful(f).select(
        F.col("amount").alias("gmv"), mdr_revenue().alias("mdr"), F.col("cashback_amt").alias("cashback"),
        F.col("processing_fee_amt").alias("fee"))
    return rows.agg(*[F.sum(c).alias(f"s_{c}") for c in PARTS],
                    *[F.sum(dbl(a) * dbl(b)).alias(f"p_{a}_{b}")
                      for a, b in combinations_with_replacement(PARTS, 2)])


def scenario_bands(f: DataFrame, grid: str = "mdr", level: float = 0.95) -> DataFrame:
    """Net revenue per scenario of a grid with its band; all scenarios read one row of sums and products.

    A scenario weighs the parts of net revenue, so its variance is a quadratic form of the products.
    The "mdr" grid adds independent noise on every payment's rate, the "cashback" grid a reaction of
    volume that multiplies two sums and is linearised.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(m)).alias("mdr_delta"), F.lit(c).alias("cashback_cut_pct"),
                 F.lit(p).alias("fee_cut_pct")) for m, c, p in GRIDS[grid]]))
    rows = _moments(f).withColumn("g", cells)
    total = {c: dbl(f"s_{c}") for c in PARTS}
    cut, fee = dbl("g.cashback_cut_pct") / 100, dbl("g.fee_cut_pct") / 100
    weight = {"gmv": F.col("g.mdr_delta") / 100, "mdr": F.lit(1.0), "cashback": cut - 1, "fee": fee - 1}
    mean = sum((weight[c] * total[c] for c in PARTS[1:]), weight["gmv"] * total["gmv"])
    if grid == "cashback":  # mdr * (1 + reaction * gmv / base) at gmv = base
        reaction = CASHBACK_ELASTICITY * cut / 100
        mean = mean + total["mdr"] * reaction
        weight |= {"mdr": 1 + reaction, "gmv": reaction * total["mdr"] / F.nullif(total["gmv"], F.lit(0.0))}
    spread = F.lit(0.0)
    for a, b in combinations_with_replacement(PARTS, 2):
        spread = spread + (1 if a == b else 2) * weight[a] * weight[b] * F.col(f"p_{a}_{b}")
    if grid == "mdr":
        spread = spread + (MDR_NOISE / 100) ** 2 * F.col("p_gmv_gmv")
    base = total["mdr"] - total["cashback"] - total["fee"]
    half = _z(level) * F.sqrt(F.greatest(spread, F.lit(0.0)))
    return rows.select(
        "g.*", rnd(mean, 2).alias("rev_mean"), rnd(mean - half, 2).alias("rev_ci_low"),
        rnd(mean + half, 2).alias("rev_ci_high"),
        rnd((mean - base) / F.nullif(base, F.lit(0.0)) * 100, 4).alias("rev_change_pct"))


#: Poisson(1): chance of at most 0, 1, 2, ... as 64-bit thresholds.
def _thresholds() -> np.ndarray:
    term = np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 18.0))])
    return (np.cumsum(term)[:-1].clip(max=1 - 2.0**-53) * 2.0**64).astype(np.uint64)


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) counts, one row per id and one column per replicate, from the id and the seed alone."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed << 32))[None] * np.uint64(
            0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return np.searchsorted(_thresholds(), h, side="right")


def poisson_replicates(s: DataFrame, sums: dict[str, Column], replicates: int, id_col: str = "transaction_id",
                       seed: int = 42, chunk: int = 1_000) -> DataFrame:
    """Totals of ``sums`` and of rows (n) in each bootstrap replicate; every row draws its own counts.

    A task adds up vectors of ``replicates`` totals while it reads and hands on one row per replicate, so
    the shuffle holds replicates x tasks rows whatever the table. The draws follow from the row's id:
    a task that runs again gives the same totals.
    """
    names = list(sums)
    rows = s.select(F.xxhash64(F.col(id_col)).alias("id"), *[dbl(c).alias(n) for n, c in sums.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) + 1, replicates))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = np.column_stack([np.ones(batch.num_rows)] + [
                np.nan_to_num(batch.column(i + 1).to_numpy(zero_copy_only=False)) for i in range(len(names))])
            for at in range(0, len(ids), chunk):
                total += values[at:at + chunk].T @ poisson_weights(ids[at:at + chunk], replicates, seed).astype(float)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *map(pa.array, total)],
            names=["replicate", "n", *names])

    schema = "replicate int, n double, " + ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(run, schema).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
