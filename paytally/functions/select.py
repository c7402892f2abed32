"""Exact percentiles by radix selection: count by leading digits, keep the digits that hold the rank, repeat.

Values become integers of the same order. Each pass counts, map-side combined, at most 4,096 digits per
wanted interval; no value is shuffled, sorted or stored. A column with a range of b bits takes b / 12
passes after the one that finds the range, so cents of amounts below ten million take three.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType, DecimalType, DoubleType, FloatType, IntegerType, IntegralType, LongType, StructType,
)

DIGIT = 12


@F.pandas_udf(LongType())
def _bits(x: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; -0.0 counts as 0.0."""
    raw = (x.to_numpy(dtype="float64") + 0.0).view(np.int64)
    keys = np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)
    return pd.Series(keys, index=x.index).where(x.notna().to_numpy(), None).astype("Int64")


def ordered_key(c: Column, kind: DataType) -> Column:
    """A 64-bit integer that sorts like the value."""
    if isinstance(kind, IntegralType):
        return c.cast("long")
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        return _bits(c.cast("double"))
    raise TypeError(f"no order-preserving integer for {kind.simpleString()}")


def value_of_key(key: int, kind: DataType) -> float:
    if isinstance(kind, IntegralType):
        return float(key)
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return key / 10**kind.scale
    return float(np.int64(key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))


def values_at(df: DataFrame, value: str, ranks: Column, by: list[str] = ()) -> list[tuple]:
    """(group..., n, {rank: value}) with the values at 0-based ranks, which ``ranks`` lists as an array from n.

    Groups are few (months, channels): each needs a few integers on the driver. NULLs and NaNs are left out.
    """
    by = list(by)
    kind = df.schema[value].dataType
    known = F.col(value).isNotNull()
    if isinstance(kind, (DoubleType, FloatType)):
        known = known & ~F.isnan(value)
    rows = df.filter(known).select(*by, ordered_key(F.col(value), kind).alias("_k"))
    start = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    groups = start.withColumn("ranks", ranks).collect()
    keys = [tuple(g[b] for b in by) for g in groups]
    # Open intervals: (group, lo, hi) -> the ranks within it that are still asked for, as (rank, rest).
    wanted = {(i, g["lo"], g["hi"]): sorted({(r, r) for r in g["ranks"]}) for i, g in enumerate(groups) if g["n"]}
    found: list[dict[int, float]] = [{} for _ in groups]
    while wanted:
        for (i, lo, hi) in [w for w in wanted if w[1] == w[2]]:
            for rank, _ in wanted.pop((i, lo, hi)):
                found[i][rank] = value_of_key(lo, kind)
        if not wanted:
            break
        cells = [(i, lo, hi, max(0, (hi - lo).bit_length() - DIGIT), at) for at, (i, lo, hi) in enumerate(wanted)]
        hits = _digits(rows, by, keys, cells)
        rests = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(rank).cast("long").alias("rank"),
                                   F.lit(rest).cast("long").alias("rest"))
                          for at, w in enumerate(wanted.values()) for rank, rest in w])
        upto = F.sum("c").over(Window.partitionBy("at").orderBy("d"))  # at most 4,096 rows per interval
        asked = F.explode(F.filter(rests, lambda r: r["at"] == F.col("at")))
        placed = hits.withColumn("upto", upto).select("at", "d", "c", "upto", asked.alias("r")).filter(
            (F.col("r.rest") < F.col("upto")) & (F.col("r.rest") >= F.col("upto") - F.col("c")))
        before = list(wanted)
        wanted = {}
        for row in placed.select("at", "d", "r.rank", (F.col("r.rest") - F.col("upto") + F.col("c")).alias("rest")).collect():
            i, lo, hi = before[row["at"]]
            shift = cells[row["at"]][3]
            low = row["d"] << shift
            low, high = max(lo, low), min(hi, low + (1 << shift) - 1)
            wanted.setdefault((i, low, high), []).append((row["rank"], row["rest"]))
    return [(*k, g["n"], f) for k, g, f in zip(keys, groups, found)]


def _digits(rows: DataFrame, by: list[str], keys: list[tuple], cells: list[tuple]) -> DataFrame:
    """(at, d, c): rows per digit of each open interval."""
    spec = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"),
                              F.lit(shift).alias("shift"), F.lit(at).alias("at")) for _, lo, hi, shift, at in cells])
    if by:
        listed = [(*keys[i], lo, hi, shift, at) for i, lo, hi, shift, at in cells]
        schema = StructType([rows.schema[b] for b in by]).add(
            "lo", LongType()).add("hi", LongType()).add("shift", IntegerType()).add("at", IntegerType())
        frame = rows.sparkSession.createDataFrame(listed, schema).groupBy(*by).agg(
            F.collect_list(F.struct("lo", "hi", "shift", "at")).alias("_spec"))
        frame = frame.withColumnsRenamed({b: f"_g_{b}" for b in by})
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
        rows = rows.join(F.broadcast(frame), same)  # one row per group
        spec = F.col("_spec")
    inside = F.filter(spec, lambda c: (F.col("_k") >= c["lo"]) & (F.col("_k") <= c["hi"]))
    return rows.select("_k", F.explode(inside).alias("c")).select(
        "c.at", F.call_function("shiftright", F.col("_k"), F.col("c.shift")).alias("d")).groupBy(
        "at", "d").agg(F.count(F.lit(1)).alias("c"))


def percentiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles like ``ordered.percentiles``, one double column per entry."""
    by = list(by)
    at = F.array(*[F.lit(float(p)) for p in probs.values()])
    places = F.transform(at, lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x).cast("long")),
                                      F.transform(places, lambda x: F.ceil(x).cast("long"))))
    rows = []
    for *key, n, found in values_at(df, value, ranks, by):
        if n == 0:
            rows.append((*key, *[None] * len(probs)))
            continue
        out = []
        for p in probs.values():
            place = float(p) * (n - 1)
            low, high = int(np.floor(place)), int(np.ceil(place))
            out.append(found[low] + (found[high] - found[low]) * (place - low))
        rows.append((*key, *out))
    schema = StructType([df.schema[b] for b in by])
    for name in probs:
        schema.add(name, DoubleType())
    return df.sparkSession.createDataFrame(rows, schema)
