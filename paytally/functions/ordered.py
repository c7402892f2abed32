"""Exact global order statistics without a single-task window.

``NTILE``, ``ROW_NUMBER``, k-th value and percentile over all customers would move every row to one
task. Here rows are range-partitioned on a unique order key, each range is counted, and only the
ranges that hold a wanted rank are sorted. A value shared by a third of all rows is split over many
ranges, because the tie-break column is part of the range key. Results are exact for any data.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset, it is an error, except within one process (``local[n]``), where a temporary folder is
    enough for tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="paytally-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system of ``path`` delete it when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder that goes when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet in a scratch folder: small, and read by columns.

    For frames of the fact's size; a checkpoint keeps whole rows uncompressed and computes its last stage twice.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition by ``order``; ``_part`` numbers the ranges in order.

    The frame is checkpointed: range bounds come from a sample, so every reader must see one run.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    return checkpointed(parts)


def range_offsets(parts: DataFrame, **sums: str) -> DataFrame:
    """Per range: size of each sum and its total over all earlier ranges (``<name>_before``).

    One row per range partition, so the window below sees a few hundred rows.
    """
    sizes = parts.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumns(
        {f"{n}_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums}
    )


def running_sums(parts: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Exact running totals (``<name>_upto``, inclusive) over the global order of ``parts``."""
    offsets = range_offsets(parts, **{f"_{n}": c for n, c in sums.items()})
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = offsets.select("_part", *[f"_{n}_before" for n in sums])
    return (
        parts.join(F.broadcast(before), "_part")  # one row per range partition
        .withColumns(
            {f"{n}_upto": F.col(f"_{n}_before") + F.sum(c).over(within) for n, c in sums.items()}
        )
        .drop(*[f"_{n}_before" for n in sums])
    )


def rows_at_ranks(
    parts: DataFrame, order: list[str], ranks: DataFrame, weight: str = "_w"
) -> DataFrame:
    """Rows of ``parts`` that cover the 1-based global ranks listed in ``ranks`` (slot, rank).

    ``ranks`` holds one row per requested cut. Only ranges that contain a wanted rank are sorted.
    """
    offsets = range_offsets(parts, _n=weight)
    hits = ranks.join(
        F.broadcast(offsets),  # one row per range partition
        (F.col("rank") > F.col("_n_before")) & (F.col("rank") <= F.col("_n_before") + F.col("_n")),
    ).select("slot", "rank", "_part", "_n_before")
    upto = F.col("_n_before") + F.sum(weight).over(
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sorted_parts = parts.join(
        F.broadcast(hits.select("_part", "_n_before").distinct()), "_part"  # at most one per rank
    ).withColumn("_upto", upto)
    wanted = hits.select("_part", "slot", "rank")  # one row per requested rank
    return (
        sorted_parts.join(F.broadcast(wanted), "_part")
        .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col(weight)))
        .select(*parts.columns, "slot", "rank")
    )


Cut = tuple[Column, int, str, int]  # value, number of cuts, rank of cut t as SQL over n and t, NULL side


def by_ntile(value: str, k: int, desc: bool = False) -> Cut:
    """SQL ``NTILE(k)``: the first ``n mod k`` tiles get one extra row. NULL is the lowest value: first in
    ascending order, last in descending order."""
    rank = f"t * (n div {k}) + least(t, n % {k})"
    return (-F.col(value), k - 1, rank, 1) if desc else (F.col(value), k - 1, rank, -1)


def by_rank_bin(value: str, k: int) -> Cut:
    """Equal-count bins on first-come ranks with right-closed edges at 1 + (n-1)*t/k; NULL first."""
    return F.col(value), k - 1, f"1 + ((n - 1) * t) div {k}", -1


def by_rank_share(value: str, shares: list[str]) -> Cut:
    """Tiers bounded by the ranks floor(n * share), highest values first, NULL last."""
    cases = " ".join(f"WHEN {i + 1} THEN {s}BD" for i, s in enumerate(shares))
    return -F.col(value), len(shares), f"floor(n * CASE t {cases} END)", 1


def tiled(df: DataFrame, tie: str, **tiles: Cut) -> DataFrame:
    """Number the tiles of each entry from 1, in the order of (value, ``tie``); ``tie`` is unique.

    The cut rows of all entries are found in one range-partitioned pass; numbering a row is then a
    comparison with one broadcast row of cuts. ``df`` should be checkpointed: it is read twice.
    """
    specs = list(tiles.items())
    # One array makes Spark widen the values to their common type without loss.
    values = F.array(*[value for _, (value, _, _, _) in specs])
    sides = F.element_at(F.array(*[F.lit(side) for _, (_, _, _, side) in specs]), F.col("_m") + 1)
    pairs = df.select(F.posexplode(values).alias("_m", "_v"), F.col(tie).alias("_t"))
    kind = pairs.schema["_v"].dataType
    # NULLs take the side of their entry through ``_z``, which leads the order.
    pairs = pairs.withColumns({"_z": F.when(F.col("_v").isNull(), sides).otherwise(0), "_w": F.lit(1).cast("long")})
    parts = in_ranges(pairs, "_m", "_z", "_v", "_t")
    wanted = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(t).alias("t"))
        for m, (_, (_, slots, _, _)) in enumerate(specs) for t in range(1, slots + 1)
    ])
    rank = F.coalesce(*[
        F.when(F.col("slot.m") == m, F.expr(sql) + m * F.col("n"))
        for m, (_, (_, _, sql, _)) in enumerate(specs)
    ])
    ranks = (
        parts.agg((F.count(F.lit(1)) / len(specs)).cast("long").alias("n"))
        .select("n", F.explode(wanted).alias("slot"))
        .select("n", "slot", F.col("slot.t").alias("t"))
        .withColumn("rank", rank.cast("long"))
        .filter(F.col("rank") > F.col("slot.m") * F.col("n"))  # rank 0 cuts nothing
        .select("slot", "rank")
    )
    found = rows_at_ranks(parts, ["_m", "_z", "_v", "_t"], ranks)

    def cut_of(m: int, t: int) -> Column:
        hit = (F.col("slot.m") == m) & (F.col("slot.t") == t)
        return F.max(F.when(hit, F.struct("_z", "_v", "_t"))).alias(f"_cut_{m}_{t}")

    cuts = found.agg(*[
        cut_of(m, t) for m, (_, (_, slots, _, _)) in enumerate(specs) for t in range(1, slots + 1)
    ])

    def tile(m: int, value: Column, slots: int, side: int) -> Column:
        # Structs compare field by field with NULL equal to NULL, so no comparison is unknown.
        own = F.struct(F.when(value.isNull(), side).otherwise(0).alias("_z"), value.cast(kind).alias("_v"),
                       F.col(tie).alias("_t"))
        number = F.lit(1)
        for t in range(1, slots + 1):
            cut = F.col(f"_cut_{m}_{t}")  # NULL for a cut at rank 0: every row lies after it
            number = number + F.when(own <= cut, 0).otherwise(1)
        return number

    numbers = {out: tile(m, value, slots, side) for m, (out, (value, slots, _, side)) in enumerate(specs)}
    return df.crossJoin(F.broadcast(cuts)).withColumns(numbers).drop(*cuts.columns)  # one row


def _histogram(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows per distinct value; hot values collapse in the map-side combine."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )


def _group_starts(hist: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and rows in all earlier groups; one row per group."""
    sizes = hist.groupBy(*by).agg(F.sum("_w").alias("n"))
    if not by:
        return sizes.withColumn("start", F.lit(0).cast("long"))
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def percentiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] = (),
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles: one row per group, one double column per entry.

    ``also`` adds aggregates over the distinct values (``_v``) and their row counts (``_w``), which
    spares a second scan for means and ranges.

    ``by`` keys must be few (months, channels): there is one result row per group. The values may
    be as many as the rows of ``df``.
    """
    by, names = list(by), list(probs)
    parts = in_ranges(_histogram(df, value, by), *by, "_v")
    groups = _group_starts(parts, by)
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(probs[p])).alias("p"))
                  for i, p in enumerate(names)])
    )
    position = F.col("w.p") * (F.col("n") - 1)
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("end"), (F.floor("pos") + 1).alias("rank")),
            F.struct(F.lit(1).alias("end"), (F.ceil("pos") + 1).alias("rank")),
        )
    )
    slots = (
        groups.select(*by, "n", "start", wanted.alias("w"))
        .select(*by, "start", "w.i", position.alias("pos"))
        .select(*by, "start", "i", "pos", ends.alias("e"))
        .select(
            F.struct(
                *[F.col(b).alias(b) for b in by],
                F.col("i"),
                F.col("e.end").alias("end"),
                (F.col("pos") - F.floor("pos")).alias("frac"),
            ).alias("slot"),
            (F.col("start") + F.col("e.rank")).cast("long").alias("rank"),
        )
    )
    found = rows_at_ranks(parts, [*by, "_v"], slots).select(
        *[F.col(f"slot.{b}").alias(b) for b in by],
        "slot.i", "slot.end", "slot.frac", F.col("_v").cast("double").alias("v"),
    )

    def at(i: int, end: int) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("end") == end), F.col("v")))

    def interpolated(i: int) -> Column:
        frac = F.max(F.when(F.col("i") == i, F.col("frac")))
        return at(i, 0) + (at(i, 1) - at(i, 0)) * frac

    cut = found.groupBy(*by).agg(*[interpolated(i).alias(p) for i, p in enumerate(names)])
    if not also:
        return cut
    more = parts.groupBy(*by).agg(*[c.alias(n) for n, c in also.items()])
    return more.join(cut, by) if by else more.crossJoin(F.broadcast(cut))  # one row each


def kth_values(df: DataFrame, columns: list[str], probs: dict[str, str]) -> DataFrame:
    """One row: per column and entry the value found after skipping floor(n * p) rows in ascending
    order, named ``column_entry``. All columns share one pass."""
    cells = df.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_m", "v"))
    parts = in_ranges(_histogram(cells, "v", ["_m"]), "_m", "_v")
    wanted = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), F.expr(f"{p}BD").alias("p"))
                  for name, p in probs.items()])
    )
    rank = F.col("start") + F.floor(F.col("n") * F.col("w.p")) + 1
    ranks = (
        _group_starts(parts, ["_m"])
        .select("_m", "n", "start", wanted.alias("w"))
        .select(F.struct(F.col("_m").alias("m"), "w.name").alias("slot"), rank.cast("long").alias("rank"))
    )
    found = rows_at_ranks(parts, ["_m", "_v"], ranks)
    return found.agg(*[
        F.max(F.when((F.col("slot.m") == m) & (F.col("slot.name") == name), F.col("_v"))).alias(
            f"{c}_{name}"
        )
        for m, c in enumerate(columns) for name in probs
    ])
