"""Sources and sinks of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from paytally.sources.schemas import STAR


def read_star(
    spark: SparkSession, path: str, fmt: str = "parquet", suffix: str = ""
) -> dict[str, DataFrame]:
    """Read the six star tables below ``path``.

    ``fmt`` is ``parquet`` or ``csv`` (header, ISO dates, bad rows fail the job).
    Each table is ``path/name+suffix``; Spark reads a file or a directory of parts alike.
    """
    star = {}
    for name, schema in STAR.items():
        source = f"{path}/{name}{suffix}"
        if fmt != "csv":
            star[name] = spark.read.schema(schema).format(fmt).load(source)
            continue
        # Flags arrive as "True"/"False" text; read them as text and cast explicitly.
        flags = [f.name for f in schema if isinstance(f.dataType, BooleanType)]
        raw = StructType(
            [StructField(f.name, StringType()) if f.name in flags else f for f in schema]
        )
        frame = (
            spark.read.schema(raw)
            .options(header=True, mode="FAILFAST", dateFormat="yyyy-MM-dd", escape='"')
            .csv(source)
        )
        star[name] = normalize_bool(frame, flags)
    return star


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short literal table, planned as a local relation so that joins can broadcast it."""
    kinds = StructType.fromDDL(schema)
    cells = F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kinds, row)])
        for row in rows
    ])
    return spark.range(0, 1, 1, 1).select(F.explode(cells).alias("r")).select("r.*")


def normalize_bool(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn "True"/"False" text columns into booleans."""
    return df.withColumns({c: F.col(c).cast("boolean") for c in columns}) if columns else df


def calendar(spark: SparkSession, start: str, end: str, holidays: list[str] = ()) -> DataFrame:
    """Calendar dimension for ``start``..``end``; ``holidays`` are ``MM-dd`` or ``yyyy-MM-dd``."""
    day = F.col("date")
    marks = [F.lit(h) for h in holidays] or [F.lit("")]
    return (
        spark.sql(
            "SELECT explode(sequence(to_date(:a), to_date(:b))) AS date", {"a": start, "b": end}
        )
        .withColumns(
            {
                "year": F.year(day),
                "month": F.month(day),
                "day": F.dayofmonth(day),
                "week_of_year": F.weekofyear(day),
                "is_weekend": F.dayofweek(day).isin(1, 7),
                "holiday_flag": F.date_format(day, "MM-dd").isin(*marks)
                | F.date_format(day, "yyyy-MM-dd").isin(*marks),
            }
        )
    )


def save_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
               partition_by: list[str] = (), **options) -> None:
    """Replace (or append to) the table stored at ``path``; ``options`` are those of the writer."""
    writer = df.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
