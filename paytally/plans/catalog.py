"""Every query: a Spark callable over the star and its SQL counterpart (None where SQL has none).

Keys start with the inventory id. Results are handed out in plain types (text dates, 64-bit
integers, doubles), so that both engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, FloatType, IntegerType, ShortType, TimestampNTZType,
    TimestampType,
)

from paytally.sources.testdata import star as testdata_star

Star = dict[str, DataFrame]
Query = Callable[[Star], DataFrame]

_QUERIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, query: Query, statement: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"duplicate query {name}")
    _QUERIES[name] = (query, statement)


def plain(df: DataFrame) -> DataFrame:
    def cast(field):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (IntegerType, ShortType)):
            c = c.cast("bigint")
        elif isinstance(kind, (DecimalType, FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (DateType, BooleanType, TimestampType, TimestampNTZType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[cast(f) for f in df.schema])


@cache
def load() -> dict[str, tuple[Query, str | None]]:
    from paytally.plans import (
        catalog_customers, catalog_layout, catalog_loading, catalog_platform, catalog_primitives,
        catalog_stats,
    )

    for module in (catalog_platform, catalog_customers, catalog_stats, catalog_primitives, catalog_loading,
                   catalog_layout):
        module.register()
    return _QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, sf_dir: plain(query(testdata_star(spark, sf_dir)))

    return {name: bind(query) for name, (query, _) in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: statement for name, (_, statement) in load().items() if statement}
