"""Bands, radix percentiles, hot keys, bucketed facts, measure lattices and activity masks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paytally.functions import select
from paytally.functions.expr import month_key, rnd, successful, totals
from paytally.functions.ordered import scratch
from paytally.functions.skew import skewed_join
from paytally.operators import bands, clv, cohort, etl, measures, rfm, stats, whatif
from paytally.plans.catalog import _QUERIES, add
from paytally.plans.catalog_platform import FACT, fact
from paytally.plans.catalog_stats import _upper
from paytally.plans.sqltext import JOIN_CH, MONTH, N, SNET, big, dbl, sql

Z = repr(bands._z(0.95))


def _band_sql(num: str, den: str, scale: str, source: str, by: str = "", having: str = "") -> str:
    """Row-wise: the residual of every row, squared and added up."""
    keys, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    r = f"SELECT {keys}count(*) AS n, {dbl(f'sum({num})')}/NULLIF({dbl(f'sum({den})')},0) AS r, {dbl(f'sum({den})')} AS sy FROM {source} {group} {having}"
    w = f"{Z}*sqrt(sum(pow({dbl(num)} - r*{dbl(den)}, 2)))/abs(max(sy))"
    return f"""SELECT {keys}max(n) AS n, round(max(r)*{scale},4) AS observed,
        round((max(r) - {w})*{scale},4) AS ci_low, round((max(r) + {w})*{scale},4) AS ci_high
        FROM {source} JOIN ({r}) q {join} {group}"""


def _bands():
    add("sx_01_band_margin", fact(bands.margin_band), sql(_band_sql("net", "amount", "100", "s")))
    add("sx_02_band_mean", fact(bands.mean_band), sql(_band_sql("amount", "1", "1", "s")))
    add("sx_03_band_channels", lambda st: bands.channel_margin_band(st[FACT], st["dim_channel"]), sql(
        _band_sql("net", "amount", "100", "sc", "channel_name", f"HAVING {N} >= 100"),
        sc=f"SELECT * FROM s {JOIN_CH}"))
    keys = "mdr_delta, cashback_cut_pct, fee_cut_pct"
    for grid, cells in whatif.GRIDS.items():
        rows = ", ".join(f"({float(m)!r}::DOUBLE, {c}::BIGINT, {p}::BIGINT)" for m, c, p in cells)
        cut, fee = f"({dbl('cashback_cut_pct')}/100)", f"({dbl('fee_cut_pct')}/100)"
        react = f"({whatif.CASHBACK_ELASTICITY}::DOUBLE*{cut}/100)" if grid == "cashback" else "0.0::DOUBLE"
        move = (f"mdr_delta/100*{dbl('amount')} + {dbl('mdr')}*(1 + {react}) + {react}*tm/tg*{dbl('amount')}"
                f" - {dbl('cashback_amt')}*(1 - {cut}) - {dbl('processing_fee_amt')}*(1 - {fee})")
        noise = f"pow({whatif.MDR_NOISE}::DOUBLE/100, 2)*sum(pow({dbl('amount')}, 2))" if grid == "mdr" else "0.0::DOUBLE"
        mean = (f"sum({move}) - {react}*max(tm)").replace("sum(", "sum(", 1)
        half = f"{Z}*sqrt(sum(pow({move}, 2)) + {noise})"
        base = "(max(tm) - max(tc) - max(tf))"
        add(f"wi_11_band_{grid}", fact(lambda f, g=grid: bands.scenario_bands(f, g)), sql(
            f"""SELECT {keys}, round({mean},2) AS rev_mean, round({mean} - {half},2) AS rev_ci_low,
            round({mean} + {half},2) AS rev_ci_high, round(({mean} - {base})/{base}*100,4) AS rev_change_pct
            FROM s, t, (VALUES {rows}) g({keys}) GROUP BY {keys}""",
            t=f"""SELECT {dbl('sum(mdr)')} AS tm, {dbl('sum(amount)')} AS tg, {dbl('sum(cashback_amt)')} AS tc,
            {dbl('sum(processing_fee_amt)')} AS tf FROM s"""))


def _percentiles():
    x = dbl("amount")
    add("ag_10_radix_percentiles", fact(lambda f: select.percentiles(
        successful(f), "amount", {f"p{p}": p / 100 for p in stats.PERCENTS}).select(
        *[rnd(f"p{p}", 2).alias(f"p{p}") for p in stats.PERCENTS])), sql(
        "SELECT " + ", ".join(f"round(quantile_cont({x},{p / 100}),2) AS p{p}" for p in stats.PERCENTS) + " FROM s"))
    add("kpi_12_radix_medians", fact(lambda f: select.percentiles(
        successful(f).select(month_key("txn_date").alias("month"), "amount"), "amount",
        {"median_amount": 0.5, "p95_amount": 0.95}, by=["month"]).select(
        "month", *[rnd(c, 2).alias(c) for c in ("median_amount", "p95_amount")])), sql(
        f"""SELECT {MONTH} AS month, round(quantile_cont({x},0.5),2) AS median_amount,
        round(quantile_cont({x},0.95),2) AS p95_amount
        FROM s GROUP BY 1"""))
    add("wn_10_radix_customer_net", fact(lambda f: select.percentiles(
        totals(successful(f), "customer_id").select(F.col("net").cast("double").alias("net")), "net",
        {"p25": 0.25, "p50": 0.5, "p90": 0.9}).select(*[rnd(c, 4).alias(c) for c in ("p25", "p50", "p90")])), sql(
        "SELECT " + ", ".join(f"round(quantile_cont(net,{p}),4) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9)))
        + f" FROM (SELECT {dbl(SNET)} AS net FROM s GROUP BY customer_id)"))


def _normality():
    # The normal's distribution function at sorted values: Simpson's rule from each value to the next, added up.
    x = dbl("amount")
    density = "exp(-({0})*({0})/2)/sqrt(2*pi())".format
    add("sx_13_anderson_darling", fact(stats.anderson_darling), sql(
        f"""SELECT n, round(a2,4) AS anderson_darling, round(adj,4) AS adjusted,
        CAST(adj > {stats.AD_LIMIT} AS VARCHAR) AS rejected FROM (SELECT n, a2, a2*(1 + 0.75/n + 2.25/(n*n)) AS adj FROM (
        SELECT max(n) AS n, -max(n) - sum((r*r - (r - w)*(r - w))*ln(1 - u) + ((n - r + w)*(n - r + w) - (n - r)*(n - r))*ln(u))
          /max(n) AS a2 FROM p))""",
        v=f"SELECT {x} AS x, count(*) AS w FROM s GROUP BY 1",
        m="SELECT sum(w) AS n, sum(x*w)/sum(w) AS mean FROM v",
        d="SELECT max(n) AS n, max(mean) AS mean, sqrt(sum((x - mean)*(x - mean)*w)/(max(n) - 1)) AS sd FROM v, m",
        z="""SELECT (x - mean)/sd AS z, CAST(w AS DOUBLE) AS w, CAST(n AS BIGINT) AS n,
          CAST(sum(w) OVER (ORDER BY x) AS DOUBLE) AS r FROM v, d""",
        g="SELECT *, lag(z) OVER (ORDER BY z) AS y FROM z",
        q=f"""SELECT *, CASE WHEN y IS NULL THEN 0 ELSE (z - y)/6*({density('y')} + 4*{density('(y + z)/2')} + {density('z')}) END AS part
          FROM g""",
        t=f"SELECT {_upper('z')} AS top FROM (SELECT min(z) AS z FROM z)",
        p="SELECT n, w, r, top - sum(part) OVER (ORDER BY z) AS u FROM q, t"))


def _hot_keys():
    def hot(st):
        """A third of the payments belongs to one merchant."""
        key = F.when(F.col("transaction_id") % 3 == 0, 1).otherwise(F.col("merchant_id"))
        rows = st[FACT].withColumn("merchant_id", key.cast(st[FACT].schema["merchant_id"].dataType))
        named = skewed_join(rows.select("merchant_id", "transaction_id", "amount", "status"),
                            st["dim_merchant"].select("merchant_id", "category"), ["merchant_id"], "left",
                            spread=["transaction_id"])
        return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))

    add("jn_01_hot_key", hot, sql(
        f"""SELECT category, count(*) AS n, {dbl('sum(amount)')} AS amount FROM (
        SELECT CASE WHEN transaction_id % 3 = 0 THEN 1 ELSE merchant_id END AS merchant_id, amount FROM fact_transactions)
        LEFT JOIN (SELECT merchant_id, category FROM dim_merchant) USING (merchant_id) GROUP BY 1"""))


def by_customer(st):
    """The fact stored in buckets by customer, in a scratch folder."""
    spark = st[FACT].sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return etl.save_by_customer(st[FACT], f"fact_by_customer_{uuid.uuid4().hex}", f"{scratch(spark, 'buckets')}/fact", n)


def _buckets(known: dict[str, str]):
    add("etl_06_bucketed_rfm", lambda st: rfm.base(by_customer(st)), known["rf_01_base"])
    add("etl_06_bucketed_clv", lambda st: clv.historical(by_customer(st)), known["cl_01_historical"])
    add("jn_12_bucketed_enrich", lambda st: _enriched(by_customer(st)), sql(
        f"""SELECT transaction_id, customer_id, {dbl('amount')} AS amount, {dbl('total')} AS total, n
        FROM s JOIN (SELECT customer_id, sum(amount) AS total, count(*) AS n FROM s GROUP BY 1) USING (customer_id)"""))


def _enriched(f):
    s = successful(f).select("transaction_id", "customer_id", "amount")
    per = s.groupBy("customer_id").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    return s.join(per, "customer_id")


DIMS = ["month", "channel_id", "city_id", "device_os"]
SLICES = {
    "all": ({}, []),
    "channel": ({"channel_id": [1, 2]}, []),
    "month_channel": ({"month": ["1995-03", "1996-07"]}, ["channel_id"]),
    "city_device": ({"city_id": [0, 3, 7], "device_os": ["iOS"]}, ["month"]),
    "all_four": ({"month": ["1997-01"], "channel_id": [1, 3, 5], "device_os": ["Android"]}, ["city_id"]),
}


def _lattice(known: dict[str, str]):
    head = known["ms_01_base"].rstrip()
    assert head.endswith("FROM s")
    core = head[head.rindex("SELECT") + len("SELECT"):-len("FROM s")]

    def sliced(st, filters, by):
        f = st[FACT].withColumn("month", month_key("txn_date"))
        return measures.answer(measures.lattice(f, DIMS), DIMS, filters, by)

    column = {"month": MONTH}
    for name, (filters, by) in SLICES.items():
        where = " AND ".join(f"{column.get(c, c)} IN ({', '.join(map(repr, v))})" for c, v in filters.items()) or "true"
        shown = "".join(f"{MONTH} AS month, " if b == "month" else f"{big(b)} AS {b}, " for b in by)
        group = f"GROUP BY {', '.join(str(i + 1) for i in range(len(by)))}" if by else ""
        add(f"ms_01_slice_{name}", lambda st, f=filters, b=by: sliced(st, f, b),
            sql(f"SELECT {shown}{core} FROM s WHERE {where} {group}"))


def _masks(known: dict[str, str]):
    add("co_04_retention_masks", fact(cohort.retention_by_masks), known["co_04_retention"])
    add("co_02_activity_masks", fact(cohort.activity_by_masks), known["co_02_activity"])


def register():
    known = {name: statement for name, (_, statement) in _QUERIES.items()}
    _bands()
    _percentiles()
    _normality()
    _hot_keys()
    _buckets(known)
    _lattice(known)
    _masks(known)
