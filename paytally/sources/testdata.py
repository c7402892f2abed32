"""Star schema derived from order-management tables (lineitem, orders, customer, part, nation).

One payment attempt is one order line. Money columns are built from decimal factors, so that sums
do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.sources.readers import calendar, values

# Fixed values of the mapping view.
CHANNELS = [(1, "UPI"), (2, "CARD"), (3, "WALLET"), (4, "NETBANKING"), (5, "EMI")]
CALENDAR = ("1992-01-01", "2002-12-31")
HOLIDAYS = ["01-26", "08-15", "10-02", "12-25"]


# Columns used, with their stored types; naming them spares a schema-inference job per table.
INPUT = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(INPUT[table]).parquet(f"{sf_dir}/{table}.parquet")


def _dec(c, precision: int, scale: int):
    return F.col(c).cast(f"decimal({precision},{scale})")


def fact_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order, customer = (_read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    tenth = F.lit("0.1").cast("decimal(2,1)")
    amount = _dec("l_extendedprice", 12, 2)
    returned = F.col("l_returnflag") == "R"
    seconds = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 1171) % 86400
    # Orders meet their customers first, so that the fact is shuffled once, on the even order key.
    placed = order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=seconds)).alias("txn_ts"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("merchant_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("channel_id"),
        amount.alias("amount"),
        (F.col("l_tax") * 100).cast("decimal(6,4)").alias("mdr_pct"),
        (amount * _dec("l_discount", 4, 2) * tenth).cast("decimal(14,5)").alias("cashback_amt"),
        (_dec("l_quantity", 6, 2) * tenth).cast("decimal(10,3)").alias("processing_fee_amt"),
        F.when(returned & (F.col("o_orderstatus") == "P"), "PENDING")
        .when(returned & (F.col("l_linestatus") == "F"), "FAILED")
        .otherwise("SUCCESS")
        .alias("status"),
        (F.col("l_linenumber") % 4).alias("retry_count"),
        F.col("l_shipdate").cast("date").alias("settlement_date"),
        F.when(returned, amount).otherwise(F.lit(0).cast("decimal(12,2)")).alias("refunded_amt"),
        F.when(F.col("l_linestatus") == "O", "Android").otherwise("iOS").alias("device_os"),
        F.col("c_nationkey").alias("city_id"),
        (F.col("l_suppkey") % 10).cast("int").alias("acquirer_id"),
    )


def dim_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, CHANNELS, "channel_id int, channel_name string")


def dim_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("state"),
        F.concat(F.lit("Tier-"), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("tier"),
    )


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    signup = F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    return _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        signup.alias("signup_date"),
        signup.alias("first_txn_date"),
        F.col("c_nationkey").alias("city_id"),
        F.col("c_mktsegment").alias("segment_tag"),
    )


def dim_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("merchant_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("merchant_name"),
        (F.col("p_size") % 25).alias("city_id"),
    )


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, *CALENDAR, HOLIDAYS)


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    t.__name__: t
    for t in (dim_date, dim_channel, dim_city, dim_customer, dim_merchant, fact_transactions)
}


class Star(Mapping):
    """The six star tables by name; a table is defined when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir, self._frames = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = TABLES[name](self._spark, self._sf_dir)
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def star(spark: SparkSession, sf_dir: str) -> Star:
    """All star tables over the Parquet files in ``sf_dir``."""
    return Star(spark, sf_dir)
