"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with u
hashed from the row's key and the child's label, and the smallest draw wins, so a child is chosen in
proportion to its weight. Changing a weight moves rows only between that child and its siblings;
inside all other subtrees every row stays where it was.

Defined results: null keys draw like a key of their own; repeated keys share a shard; a null text
counts 16 bytes and has the checksum of the empty text; texts may be of any length; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.llm.common import stored


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` lists the (shard, weight) leaves of rack k in region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]


def topology(shards: int, base: int = 40, rack: int = 5, racks: int = 4) -> Tree:
    """Equal-weight tree of ``shards`` leaves.

    The first ``base`` shards fill regions of ``racks`` racks with ``rack`` shards each. A shard
    added later opens a region of its own. No weight of an older subtree changes, so a new shard takes
    rows only into itself, for every count from ``base`` on. Below ``base`` the layout is cut short.
    """
    fixed = list(range(min(shards, base)))
    rack_list = [tuple((s, 1.0) for s in fixed[i:i + rack]) for i in range(0, len(fixed), rack)]
    regions = [tuple(rack_list[i:i + racks]) for i in range(0, len(rack_list), racks)]
    return Tree(tuple(regions) + tuple((((s, 1.0),),) for s in range(base, shards)))


def _draw(key: Column, label: str, weight: float) -> Column:
    """Exponential draw of one child; 53 hashed bits give u in (0, 1)."""
    h = F.xxhash64(key, F.lit(label))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / F.lit(weight)


def _winner(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; equal draws go to the smaller value."""
    if len(draws) == 1:
        return draws[0][1]
    return F.array_min(F.array(*[F.struct(d.alias("d"), v.alias("v")) for d, v in draws]))["v"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of ``key`` under ``tree``: three nested draws, all in one expression."""

    def in_rack(r: int, k: int) -> Column:
        return _winner([(_draw(key, f"shard {s}", w), F.lit(s)) for s, w in tree.regions[r][k]])

    def in_region(r: int) -> Column:
        racks = tree.regions[r]
        chosen = _winner([(_draw(key, f"rack {r}.{k}", sum(w for _, w in leaves)), F.lit(k))
                          for k, leaves in enumerate(racks)])
        return _choose(chosen, [in_rack(r, k) for k in range(len(racks))])

    region = _winner([
        (_draw(key, f"region {r}", sum(w for leaves in racks for _, w in leaves)), F.lit(r))
        for r, racks in enumerate(tree.regions)])
    return _choose(region, [in_region(r) for r in range(len(tree.regions))])


def _choose(index: Column, values: list[Column]) -> Column:
    if len(values) == 1:
        return values[0]
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    rows_per_run: int = 50_000, base: int = 40) -> DataFrame:
    """Shard, slot and the shard under one more leaf for every row.

    Slots number a shard's rows from 0 without gaps. A shard is split by a hash of its rows into runs
    of about ``rows_per_run`` rows, each run is numbered by itself and starts where the earlier runs of
    its shard end, so no task holds a shard. Texts never leave the scan.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = rows.withColumns({"shard": shard_of(F.col("_key"), topology(shards, base)).cast("int"),
                               "grown_shard": shard_of(F.col("_key"), topology(shards + 1, base)).cast("int")})
    placed = stored(placed)
    runs = max(1, -(-placed.count() // (shards * rows_per_run)))
    placed = placed.withColumn("_run", F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(runs)))
    counts = placed.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_run").orderBy("_key", "text_crc32", "size")
    return (placed.withColumn("_i", F.row_number().over(within))
            .join(starts, ["shard", "_run"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_start") + F.col("_i") - 1).cast("long").alias("slot"), "grown_shard"))
