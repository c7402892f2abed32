"""Dashboard extracts and result packs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paytally.functions.expr import (
    by_month, dbl, growth, lookup, money, previous, successful,
)
from paytally.operators import (
    behavior, cashback, channel, churn, clv, cohort, geo, kpi, merchant, rfm, whatif,
)
from paytally.sources.readers import save_table, values

Star = Mapping[str, DataFrame]


def channel_trend(star: Star) -> DataFrame:
    named = lookup(
        successful(star["fact_transactions"]), star["dim_channel"], "channel_id", "channel_name"
    )
    return by_month(named, "channel_name").select(
        F.col("month").alias("txn_month"), "channel_name", "txn_count", dbl("gmv").alias("gmv"),
        dbl("net").alias("net_revenue"),
    ).orderBy("txn_month", "channel_name")


def stickiness(star: Star) -> DataFrame:
    return behavior.stickiness(star["fact_transactions"], 10).select(
        F.col("month").alias("txn_month"), "avg_dau", "mau", "stickiness_pct"
    )


def cohort_retention(star: Star) -> DataFrame:
    return cohort.retention(star["fact_transactions"], 11, digits=10).select(
        "cohort_month", F.col("months_since_cohort").alias("months_since_start"),
        F.col("retained_users").alias("active_users"), "cohort_size", "retention_pct",
    )


def clv_table(star: Star) -> DataFrame:
    return clv.tiers(star["fact_transactions"], star["dim_customer"], labels="shifted")


def churn_table(star: Star) -> DataFrame:
    return churn.label(star["fact_transactions"], scheme="D").select(
        "customer_id", "last_txn_date", "txn_last_90d", "txn_last_30d", "total_txns",
        dbl("total_gmv").alias("total_gmv"), dbl("lifetime_value").alias("lifetime_value"),
        "days_inactive", "churn_risk",
    )


def churn_funnel(star: Star) -> DataFrame:
    return churn.funnel(star["fact_transactions"], scheme="D").select(
        "churn_risk", "customer_count", "avg_days_inactive", "at_risk_gmv", "sort_order"
    )


FACT = "fact_transactions"

# Extracts by file name; each is defined when it is asked for.
EXTRACTS: dict[str, Callable[[Star], DataFrame]] = {
    "01_monthly_kpi": lambda st: kpi.monthly_kpi(st[FACT]),
    "02_channel_performance": lambda st: channel.performance(st[FACT], st["dim_channel"]),
    "03_monthly_channel_trend": channel_trend,
    "04_geo_gmv": lambda st: geo.extract(st[FACT], st["dim_city"]),
    "05_dau_mau_stickiness": stickiness,
    "06_cohort_retention": cohort_retention,
    "07_rfm_segments": lambda st: rfm.extract(st[FACT], st["dim_customer"]),
    "08_clv_table": clv_table,
    "09_churn_risk": churn_table,
    "10_merchant_category": lambda st: merchant.extract(st[FACT], st["dim_merchant"]),
    "11_cashback_roi": lambda st: cashback.roi_extract(st[FACT]),
    "12_whatif_scenarios": lambda st: whatif.elasticity_grid(st[FACT]),
    "rfm_segments": lambda st: rfm.extract(st[FACT], st["dim_customer"]),
    "clv_table": clv_table,
    "churn_risk_funnel": churn_funnel,
    "cashback_scenario_results": lambda st: whatif.sensitivity(st[FACT]),
    "mdr_scenario_results": lambda st: whatif.mdr_ladder(st[FACT]),
}


def export_all(star: Star, out: str, fmt: str = "csv") -> list[str]:
    """Write every extract to ``out/name``. Each one scans only the columns it needs."""
    for name, extract in EXTRACTS.items():
        save_table(extract(star), f"{out}/{name}", fmt=fmt)
    return list(EXTRACTS)


# --- publishing --------------------------------------------------------------------------------

CURRENT = "CURRENT"


def _point(spark: SparkSession, out: str, run: str) -> None:
    """Write a small file and rename it to ``out/CURRENT``; an old one is replaced in the same step."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    draft, current = hadoop.Path(f"{out}/.{CURRENT}-{run}"), hadoop.Path(f"{out}/{CURRENT}")
    where = draft.getFileSystem(conf)
    stream = where.create(draft, True)
    stream.write(bytearray(run.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(where.makeQualified(draft).toUri(), conf).rename(draft, current, options)


def publish(star: Star, out: str, fmt: str = "parquet", names: list[str] | None = None,
            sets: Mapping[str, Callable[[Star], DataFrame]] = EXTRACTS, parallel: int = 4) -> str:
    """Write a whole run of extracts and only then make it the current one; returns the run's name.

    Sets go to ``out/runs/<run>/<name>``, a few at a time; rows are counted by the job that writes
    them. The manifest follows, and last the file ``out/CURRENT`` that names the run is replaced by a
    rename. If anything fails before that, readers keep the old run whole.
    """
    spark, run = star[FACT].sparkSession, uuid.uuid4().hex
    base = f"{out}/runs/{run}"

    def write(name: str) -> tuple[str, str, int]:
        seen = Observation()
        save_table(sets[name](star).observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/{name}", fmt=fmt)
        return name, fmt, seen.get["n"]

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(write, list(sets) if names is None else names))
    values(spark, rows, "name string, format string, n_rows bigint").coalesce(1).write.json(f"{base}/_manifest")
    _point(spark, out, run)
    return run


def _run(spark: SparkSession, out: str) -> str:
    return f"{out}/runs/{spark.read.text(f'{out}/{CURRENT}').first()[0]}"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """name, format, n_rows of the sets of the current run."""
    return spark.read.schema("name string, format string, n_rows bigint").json(f"{_run(spark, out)}/_manifest")


def read_published(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One set of the current run."""
    known = manifest(spark, out).filter(F.col("name") == name).first()
    reader = spark.read.option("header", True) if known["format"] == "csv" else spark.read
    return reader.format(known["format"]).load(f"{_run(spark, out)}/{name}")


def monthly_kpis(f: DataFrame) -> DataFrame:
    """Monthly growth with payments, cashback and the previous month's GMV."""
    m = by_month(successful(f)).select("month", "gmv", "net", "users", "txn_count", "cashback")
    return m.select(
        "month", money("gmv").alias("gmv"), money("net").alias("net_revenue"),
        F.col("users").alias("mau"), "txn_count", money("cashback").alias("cashback_spent"),
        money(previous("gmv", "month")).alias("prev_gmv"),
        growth("gmv", previous("gmv", "month")).alias("gmv_mom_pct"),
        growth("net", previous("net", "month")).alias("rev_mom_pct"),
        growth("users", previous("users", "month")).alias("mau_mom_pct"),
    ).orderBy("month")


# The eight headline result sets.
PACK: dict[str, Callable[[Star], DataFrame]] = {
    "gmv_summary": lambda st: kpi.gmv_summary(st[FACT]),
    "revenue_summary": lambda st: kpi.revenue_summary(st[FACT]),
    "monthly_kpis": lambda st: monthly_kpis(st[FACT]),
    "channel_efficiency": lambda st: channel.efficiency(st[FACT], st["dim_channel"]),
    "geo_gmv": lambda st: geo.state_tier(st[FACT], st["dim_city"]),
    "rfm_segments": lambda st: rfm.summary(rfm.segment(rfm.base(st[FACT]), "kth4")),
    "whatif_scenarios": lambda st: whatif.scenarios(
        st[FACT], whatif.scenario_frame(st[FACT].sparkSession, whatif.PACK)
    ),
    "churn_risk": lambda st: churn.funnel(st[FACT], scheme="B"),
}


def kpi_pack(star: Star) -> dict[str, DataFrame]:
    return {name: result(star) for name, result in PACK.items()}


def write_pack(pack: dict[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    for name, df in pack.items():
        save_table(df, f"{out}/{name}", fmt=fmt)
