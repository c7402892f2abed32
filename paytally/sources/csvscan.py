"""CSV scan that keeps going: good rows typed, bad lines kept as they are, both from one pass.

A line is bad if a field does not convert to its type or the number of fields is wrong. Spark judges a
line by the columns a query reads of it; ``split_csv`` reads and stores them all, so that later queries
agree on which lines are bad and prune columns of the stored rows instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

LINE = "_bad_line"
BAD = "_bad"


@dataclass(frozen=True)
class Split:
    """``good`` has the schema asked for; ``bad`` has the line and what is wrong with it; the counts are
    those of the scan."""

    good: DataFrame
    bad: DataFrame
    lines: int
    bad_lines: int


def _scan(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """Typed columns and ``_bad_line``: the text of a bad line, NULL for a good one.

    With a header, its names must be those of the schema, in order.
    """
    marked = StructType([*schema.fields, StructField(LINE, StringType())])
    return spark.read.schema(marked).options(
        header=header, enforceSchema=not header, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE,
        dateFormat="yyyy-MM-dd", escape='"').csv(path)


def problems(line: Column, schema: StructType) -> Column:
    """Names of the columns whose text does not convert; ``fields`` if there are too many or too few of them."""
    text = ", ".join(f"`{c}` string" for c in [*schema.names, "_more"])
    cells = F.from_csv(line, text, {"mode": "PERMISSIVE", "escape": '"'})
    wrong = [F.when(cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull(), F.lit(f.name))
             for f in schema]
    many = F.when(cells["_more"].isNotNull(), F.lit("fields"))
    found = F.filter(F.array(*wrong, many), lambda x: x.isNotNull())
    # A short line has its last columns empty; nothing else about it need be wrong.
    return F.when(F.size(found) == 0, F.array(F.lit("fields"))).otherwise(found)


def split_csv(spark: SparkSession, path: str, schema: StructType, out: str, header: bool = True) -> Split:
    """Scan ``path`` once, store good and bad rows apart below ``out`` as Parquet, and compare the counts.

    The lines are counted by the job that writes them. Fewer or more stored rows raise an error, so a
    load never loses a line without a word.
    """
    seen = Observation()
    marked = _scan(spark, path, schema, header).withColumn(BAD, F.col(LINE).isNotNull())
    marked.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.col(BAD)).alias("bad")).write.mode(
        "overwrite").partitionBy(BAD).parquet(out, compression="zstd")
    stored = spark.read.schema(StructType([*schema.fields, StructField(LINE, StringType()),
                                           StructField(BAD, BooleanType())])).parquet(out)
    good = stored.filter(~F.col(BAD)).select(*schema.names)
    bad = stored.filter(BAD).select(F.col(LINE).alias("line"), problems(F.col(LINE), schema).alias("problems"))
    lines, bad_lines = seen.get["lines"], seen.get["bad"]
    kept = {r[BAD]: r["count"] for r in stored.groupBy(BAD).count().collect()}  # two rows
    if (kept.get(False, 0), kept.get(True, 0)) != (lines - bad_lines, bad_lines):
        raise RuntimeError(f"{path}: {lines} lines and {bad_lines} bad ones read, {kept} stored")
    return Split(good, bad, lines, bad_lines)
