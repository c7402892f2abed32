"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores. Each query runs cold once and warm once; the
warm time is reported, the cold time is listed beside it. Results go to the no-op sink, so that the
whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paytally.plans.catalog import queries  # noqa: E402
from paytally.plans.session import local_session  # noqa: E402

HEADLINE = [
    "etl_01_daily_rollup",
    "dq_04_orphans",
    "dq_15_18_rule_violations",
    "kpi_03_revenue_summary",
    "kpi_09_mom_growth",
    "kpi_12_monthly_aov",
    "ch_01_mix",
    "ch_05_efficiency",
    "geo_03_tier",
    "geo_04_category_tier",
    "mer_01_category",
    "rt_01_by_count",
    "cb_02_by_channel",
    "ub_03_stickiness",
    "ub_04_new_returning_users",
    "ub_07_deciles",
    "wn_16_trailing_30_day_users",
    "co_04_retention",
    "rf_02_ntile4",
    "rf_04_kth4",
    "cl_01_historical",
    "cl_06_tiers",
    "cr_03_funnel_d",
    "wi_01_full",
    "wi_08_elasticity_grid",
    "sx_01_bootstrap_margin",
    "sx_06_mann_whitney",
    "ms_02_users",
]


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    every["kpi_01_gmv_summary"](spark, sf_dir).collect()  # start the JVM's compiler and file caches
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(run(every[name], spark, sf_dir), 3)
        warm[name] = round(run(every[name], spark, sf_dir), 3)
    print(json.dumps({
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
        "settings": {k: spark.conf.get(k) for k in (
            "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
            "spark.sql.autoBroadcastJoinThreshold")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
