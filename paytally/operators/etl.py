"""Loading patterns: rollup, incremental append and late refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paytally.functions.expr import SUCCESS, net_revenue
from paytally.functions.ordered import checkpointed, stored


def daily_rollup(f: DataFrame) -> DataFrame:
    """Daily totals by channel and city. Save it partitioned by ``txn_date``."""
    ok = F.col("status") == SUCCESS

    def if_success(c, name):
        return F.sum(F.when(ok, c).otherwise(0)).alias(name)

    return f.groupBy("txn_date", "channel_id", "city_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.count_if(ok).alias("success_count"),
        if_success(F.col("amount"), "gmv"),
        if_success(net_revenue(), "net_revenue"),
        if_success(F.col("cashback_amt"), "total_cashback"),
        if_success(F.col("processing_fee_amt"), "total_processing_cost"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def one_per_id(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row per ``transaction_id``: the last by ``order`` (a column of the batch), ties and a missing order
    by the other columns from left to right. Rows with a NULL id are dropped: nothing can match them."""
    known = batch.filter("transaction_id is not null")
    rest = [c for c in batch.columns if c != "transaction_id"]
    if not rest:
        return known.distinct()
    lead = [order] if order else []
    rank = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*lead, *rest])])
    last = F.max_by(F.struct(*rest), rank).alias("_row")
    return known.groupBy("transaction_id").agg(last).select(
        *[F.col("transaction_id" if c == "transaction_id" else f"_row.{c}").alias(c) for c in batch.columns])


def _loaded_ids(f: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of ``keys`` that the fact holds, as often as it holds them, for an anti join. A batch is small
    against the fact, so Spark broadcasts its ids into the scan below the broadcast threshold and shuffles only
    beyond it."""
    return f.select("transaction_id").join(keys.select("transaction_id"), "transaction_id", "left_semi")


def new_rows(f: DataFrame, staging: DataFrame, order: str | None = None) -> DataFrame:
    """Staging rows after the last loaded date whose id is not loaded yet, one per id (see one_per_id)."""
    mark = f.agg(F.max("txn_date").alias("_mark"))
    newer = staging.crossJoin(F.broadcast(mark)).filter(  # one row
        F.col("_mark").isNull() | (F.col("txn_date") > F.col("_mark"))
    ).select(*staging.columns)
    newer = one_per_id(newer, order)
    return newer.join(_loaded_ids(f, newer), "transaction_id", "left_anti").select(*staging.columns)


def incremental_append(f: DataFrame, staging: DataFrame, order: str | None = None) -> DataFrame:
    return f.unionByName(new_rows(f, staging, order))


def upsert_refunds(f: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Set ``refunded_amt`` and ``settlement_date`` of known ids and add unknown ids.

    ``updates`` carries any subset of the fact columns; of rows with one id the last counts (see
    one_per_id). A left join and a union instead of a full outer join leave the fact unshuffled while the
    updates can be broadcast.
    """
    updates = one_per_id(updates, order)
    return _upsert(f, updates, _loaded_ids(f, updates))


def _upsert(f: DataFrame, updates: DataFrame, loaded: DataFrame) -> DataFrame:
    """``upsert_refunds`` of updates with one row per id; ``loaded`` has those of their ids that ``f`` holds."""
    changed = [c for c in ("refunded_amt", "settlement_date") if c in updates.columns]
    new = updates.select(
        "transaction_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )

    def value(c: str) -> Column:
        if c not in changed:
            return F.col(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    kept = f.join(new, "transaction_id", "left").select(*[value(c) for c in f.columns])
    fresh = updates.join(loaded, "transaction_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).select(*f.columns)


# --- stored fact -------------------------------------------------------------------------------

PERIOD = "period"
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def with_period(f: DataFrame, grain: str = "day") -> DataFrame:
    """Add ``period``, the text of the payment's day, month or year by which a stored fact is partitioned."""
    return f.withColumn(PERIOD, F.date_format("txn_date", GRAINS[grain]))


def _placed(f: DataFrame, grain: str) -> DataFrame:
    """Rows with their period, in the tasks that write them.

    Months and years are few, so each task writes the rows it has, without a shuffle of the fact. Days are
    many: their rows are dealt by day and id first, so that files stay few and a day that holds a third of
    all rows is written by all tasks.
    """
    placed = with_period(f, grain)
    if grain != "day":
        return placed
    n = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, F.col(PERIOD), F.pmod(F.xxhash64("transaction_id"), F.lit(max(1, n // 8))))


def save_by_period(f: DataFrame, path: str, grain: str = "day") -> None:
    """Store the fact as Parquet, one folder per period and at most one file per period and task."""
    _placed(f, grain).write.mode("overwrite").partitionBy(PERIOD).parquet(path)


def _within(periods: list[str | None], column: str = PERIOD) -> Column:
    """Literal condition on the partition column, so that the scan lists those folders only."""
    known = F.col(column).isin(*[p for p in periods if p is not None])
    return known | F.col(column).isNull() if None in periods else known


def stored_fact(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with ``period`` as text (a period such as 2025 would be read as a number)."""
    table = spark.read.parquet(path)
    return table.withColumn(PERIOD, F.col(PERIOD).cast("string"))


def merge_refunds(spark: SparkSession, path: str, updates: DataFrame, grain: str = "day",
                  order: str | None = None) -> DataFrame:
    """Merge a batch of late refunds (see upsert_refunds) into the fact stored at ``path``.

    Only the periods of the batch are read, and of those only the ones where a value differs or an id is
    new are replaced, so a batch that is merged again changes no file. The batch is computed once and
    meets the ids and values of the fact once; whole rows are read and moved only where periods are
    replaced. A batch without ``txn_date`` has it looked up by id in the same join. The writer puts new
    files beside the old ones and swaps them when all are written. Returns period, updated and inserted
    rows.
    """
    fact = stored_fact(spark, path)
    kinds = {f.name: f.dataType for f in fact.schema}
    updates = one_per_id(updates, order)
    updates = updates.withColumns({c: F.col(c).cast(kinds[c]) for c, k in updates.dtypes if k == "void" and c in kinds})
    values = [c for c in ("refunded_amt", "settlement_date") if c in updates.columns]
    dated, old = "txn_date" in updates.columns, fact
    if dated:
        updates = stored(with_period(updates, grain), "batch")
        # Periods are days, months or years of the calendar: few by nature.
        old = fact.filter(_within([r[0] for r in updates.select(PERIOD).distinct().collect()]))
    held = old.select("transaction_id", F.col("txn_date").alias("_date"), F.col(PERIOD).alias("_held"),
                      F.lit(1).alias("_hit"), *[F.col(c).alias(f"_old_{c}") for c in values])
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"_old_{c}").eqNullSafe(F.col(c).cast(kinds[c]))
    # A row per id and period that holds it, or per id that no period holds; grouped where they were joined.
    met = updates.join(held, "transaction_id", "left").groupBy(*updates.columns, "_held").agg(
        F.max("_date").alias("_date"), F.count("_hit").alias("_rows"),
        F.count_if(F.col("_hit").isNotNull() & differs).alias("_differ"))
    if not dated:
        by_id = Window.partitionBy("transaction_id")
        met = with_period(met.withColumns({
            "txn_date": F.max("_date").over(by_id), "_first": F.row_number().over(by_id.orderBy("_held"))}), grain)
    met = stored(met, "met")
    if not dated:
        updates = met.filter("_first = 1").drop("_first", "_held", "_date", "_rows", "_differ")
        covered = [r[0] for r in met.select(PERIOD).distinct().collect()]
        met = met.filter((F.col("_rows") == 0) | _within(covered, "_held"))
    report = checkpointed(met.select(
        F.when(F.col("_rows") > 0, F.col("_held")).otherwise(F.col(PERIOD)).alias(PERIOD),
        F.col("_differ").alias("updated"), (F.col("_rows") == 0).cast("long").alias("inserted"),
    ).groupBy(PERIOD).agg(F.sum("updated").alias("updated"), F.sum("inserted").alias("inserted")).filter(
        "updated + inserted > 0"))
    touched = [r[0] for r in report.select(PERIOD).collect()]
    if touched:
        loaded = met.filter((F.col("_rows") > 0) & _within(touched, "_held")).select("transaction_id")
        merged = _upsert(fact.filter(_within(touched)), updates.filter(_within(touched)), loaded)
        merged.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
        spark.catalog.refreshByPath(path)
    return report


def save_by_customer(f: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Store the fact bucketed and sorted by customer and return the table.

    RFM, lifetime value, churn and cohorts then group by customer without moving the fact. Choose the
    buckets for files of some hundred megabytes. Rows of one customer share a bucket.
    """
    dealt = f.repartition(buckets, "customer_id")  # one file per bucket
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(table)
    return f.sparkSession.table(table)
