"""Loading, merging, rollups and publishing through stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paytally.functions.expr import lookup, month_key, month_start
from paytally.functions.ordered import scratch, stored
from paytally.operators import etl, rollup
from paytally.plans import export
from paytally.plans.catalog import _QUERIES, add
from paytally.plans.catalog_platform import FACT, LATE_REFUNDS, LOADED, late_refunds
from paytally.plans.sqltext import JOIN_CH, JOIN_CI, MONTH, N, SCB, SFEE, SMDR, GMV, USERS, big, dbl, sql, text
from paytally.sources.csvscan import split_csv
from paytally.sources.readers import save_table

# Lines damaged for the test: one id in 50, in one of three ways.
DAMAGED = "transaction_id % 50 = 7"
# Lines are several times the size of the rows they hold, so they are compressed; such a file is scanned by one task,
# so it is kept short.
LINES = {"compression": "lz4", "maxRecordsPerFile": 250_000}


def _csv(st, name: str):
    """A star table written as CSV with a header, scanned and split."""
    spark, path = st[name].sparkSession, scratch(st[name].sparkSession, "csv")
    save_table(st[name], f"{path}/lines", fmt="csv", **LINES)
    return split_csv(spark, f"{path}/lines", st[name].schema, f"{path}/rows")


def _damaged(st):
    """Fact lines of which some are damaged: a text amount, a cut line, a field too many."""
    fact = st[FACT]
    spark, path = fact.sparkSession, scratch(fact.sparkSession, "csv")
    kind = F.when(F.expr(DAMAGED), F.col("transaction_id") % 3)
    line = F.to_csv(F.struct(*fact.columns))
    wrong = F.to_csv(F.struct(*[F.lit("n/a").alias(c) if c == "amount" else F.col(c) for c in fact.columns]))
    cut = F.to_csv(F.struct(*fact.columns[:3]))
    lines = fact.select(F.when(kind == 0, wrong).when(kind == 1, cut).when(kind == 2, F.concat(line, F.lit(",9")))
                        .otherwise(line).alias("value"))
    lines.write.options(**LINES).text(f"{path}/lines")
    return split_csv(spark, f"{path}/lines", StructType(fact.schema.fields), f"{path}/rows", header=False)


def _bad_lines(st) -> DataFrame:
    return _damaged(st).bad.select(
        F.split("line", ",")[0].cast("long").alias("transaction_id"), F.array_join("problems", ",").alias("problems"))


def _csv_counts(st) -> DataFrame:
    """Lines, good and bad rows of each star table, and of the damaged fact; the fact is computed once."""
    st = {**st, FACT: stored(st[FACT], "fact")}
    found = [(name, _csv(st, name)) for name in st] + [("damaged", _damaged(st))]
    rows = [f.good.agg(F.lit(name).alias("table_name"), F.lit(f.lines).cast("long").alias("lines"),
                       F.lit(f.bad_lines).cast("long").alias("bad_lines"), F.count(F.lit(1)).alias("good_rows"))
            for name, f in found]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def _sources():
    fact = f"""SELECT transaction_id, {text('txn_ts')} AS txn_ts, {text('txn_date')} AS txn_date,
        {big('customer_id')} AS customer_id, merchant_id, {big('channel_id')} AS channel_id,
        {dbl('amount')} AS amount, {dbl('mdr_pct')} AS mdr_pct, {dbl('cashback_amt')} AS cashback_amt,
        {dbl('processing_fee_amt')} AS processing_fee_amt, status, {big('retry_count')} AS retry_count,
        {text('settlement_date')} AS settlement_date, {dbl('refunded_amt')} AS refunded_amt, device_os,
        {big('city_id')} AS city_id, {big('acquirer_id')} AS acquirer_id FROM fact_transactions"""
    add("src_01_csv_fact", lambda st: _csv(st, FACT).good, sql(fact))
    add("src_01_csv_dates", lambda st: _csv(st, "dim_date").good, sql(
        f"""SELECT {text('date')} AS date, year, month, day, week_of_year, {text('is_weekend')} AS is_weekend,
        {text('holiday_flag')} AS holiday_flag FROM dim_date"""))
    add("src_01_csv_good_rows", lambda st: _damaged(st).good, sql(f"{fact} WHERE NOT ({DAMAGED})"))
    add("src_01_csv_bad_lines", _bad_lines, sql(
        f"""SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 THEN 'amount' ELSE 'fields' END AS problems
        FROM fact_transactions WHERE {DAMAGED}"""))
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS lines, 0 AS bad_lines, count(*) AS good_rows FROM {t}"
        for t in ("dim_date", "dim_channel", "dim_city", "dim_customer", "dim_merchant", FACT))
    add("src_01_csv_counts", _csv_counts, sql(
        f"""SELECT table_name, {big('lines')} AS lines, {big('bad_lines')} AS bad_lines, {big('good_rows')} AS good_rows
        FROM ({counts} UNION ALL SELECT 'damaged', count(*), count(CASE WHEN {DAMAGED} THEN 1 END),
          count(CASE WHEN NOT ({DAMAGED}) THEN 1 END) FROM fact_transactions)"""))


def _merged(st, again: bool) -> tuple[DataFrame, DataFrame]:
    """The stored fact after a batch of late refunds, and the report of its (last) merge."""
    spark = st[FACT].sparkSession
    path = f"{scratch(spark, 'fact')}/fact"
    etl.save_by_period(st[FACT], path, "month")
    batch = stored(late_refunds(etl.stored_fact(spark, path)), "late")
    report = etl.merge_refunds(spark, path, batch, "month")
    if again:
        report = etl.merge_refunds(spark, path, batch, "month")
    return etl.stored_fact(spark, path), report


def _merge(upsert_sql: str):
    shown = ["transaction_id", "refunded_amt", "settlement_date", "status", "amount"]
    add("etl_03_merge_stored", lambda st: _merged(st, False)[0].select(*shown), upsert_sql)
    add("etl_03_merge_twice", lambda st: _merged(st, True)[0].select(*shown), upsert_sql)
    add("etl_03_merge_report", lambda st: _merged(st, False)[1], sql(
        f"""SELECT strftime(f.txn_date, '%Y-%m') AS period,
        count(CASE WHEN f.transaction_id IS NOT NULL AND (f.refunded_amt IS DISTINCT FROM u.refunded_amt
          OR f.settlement_date IS DISTINCT FROM u.settlement_date) THEN 1 END) AS updated,
        count(CASE WHEN f.transaction_id IS NULL THEN 1 END) AS inserted
        FROM u LEFT JOIN fact_transactions f USING (transaction_id) GROUP BY 1 HAVING updated + inserted > 0""",
        u=LATE_REFUNDS))
    add("etl_03_merge_again_report", lambda st: _merged(st, True)[1], sql(
        "SELECT '' AS period, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS inserted WHERE false"))


def _rollups():
    def month():
        return month_start().alias("month")

    def days(st):
        return rollup.user_state(st[FACT], "txn_date", "channel_id")

    def mau(st):
        return rollup.count_users(days(st), by=[month()]).select(
            month_key("month").alias("month"), F.col("unique_customers").alias("mau"))

    def channels(st):
        found = rollup.count_users(days(st), by=["channel_id"])
        return lookup(found, st["dim_channel"], "channel_id", "channel_name").select("channel_name", "unique_customers")

    def tiers(st):
        cities = rollup.user_state(st[FACT], month(), "city_id")
        placed = lookup(cities, st["dim_city"], "city_id", "tier")
        return rollup.count_users(placed, by=["tier"])

    def folded(st):
        """State and sums of the loaded days, with those of the days after them added."""
        f = st[FACT]
        old, new = f.filter(F.col("txn_date") < LOADED), f.filter(F.col("txn_date") >= LOADED)
        state = rollup.fold(rollup.user_state(old, month(), "channel_id"), rollup.user_state(new, month(), "channel_id"),
                            by=["month", "channel_id"])
        sums = rollup.add_sums(rollup.sums(old, month(), "channel_id"), rollup.sums(new, month(), "channel_id"),
                               by=["month", "channel_id"])
        return sums.join(rollup.count_users(state, by=["month", "channel_id"]), ["month", "channel_id"]).select(
            month_key("month").alias("month"), "channel_id", "txn_count", *rollup.SUMS[1:], "unique_customers")

    add("etl_01_rollup_mau", mau, sql(f"SELECT {MONTH} AS month, {USERS} AS mau FROM s GROUP BY 1"))
    add("etl_01_rollup_channels", channels, sql(
        f"SELECT channel_name, {USERS} AS unique_customers FROM s {JOIN_CH} GROUP BY 1"))
    add("etl_01_rollup_tiers", tiers, sql(f"SELECT tier, {USERS} AS unique_customers FROM s {JOIN_CI} GROUP BY 1"))
    add("etl_01_rollup_folded", folded, sql(
        f"""SELECT {MONTH} AS month, {big('channel_id')} AS channel_id, {N} AS txn_count, {dbl(GMV)} AS gmv,
        {dbl(SMDR)} AS mdr, {dbl(SCB)} AS cashback, {dbl(SFEE)} AS fee, {USERS} AS unique_customers
        FROM s GROUP BY 1, 2"""))


def _published(st, names: list[str], show: Callable) -> DataFrame:
    """What ``show`` reads of a published run. The fact is computed once, and the sets scan the stored columns."""
    spark = st[FACT].sparkSession
    out = scratch(spark, "published")
    export.publish({**st, FACT: stored(st[FACT], "fact")}, out, names=names)
    return show(spark, out)


def _publishing(statements: dict[str, str]):
    names = [n for n in export.EXTRACTS if n[:2].isdigit()]
    queries = {n: next(q for q in statements if q.startswith(f"exp_{n[:2]}_")) for n in names}
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n_rows FROM ({statements[q]}) x{n[:2]}" for n, q in queries.items())
    add("snk_01_publish_manifest", lambda st: _published(
        st, names, lambda spark, out: export.manifest(spark, out).select("name", "n_rows")), counts)
    add("snk_01_published_kpis", lambda st: _published(
        st, names, lambda spark, out: export.read_published(spark, out, "01_monthly_kpi")), statements[queries["01_monthly_kpi"]])


def register():
    known = {name: statement for name, (_, statement) in _QUERIES.items()}
    _sources()
    _merge(known["etl_03_upsert_refunds"])
    _rollups()
    _publishing(known)
