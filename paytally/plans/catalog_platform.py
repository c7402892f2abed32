"""Sources, quality, KPIs, channels, geography, merchants, cost, cashback, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytally.functions.ordered import stored
from paytally.operators import (
    cashback, channel, cost, etl, geo, kpi, merchant, quality, retry,
)
from paytally.plans.catalog import add
from paytally.plans.sqltext import (
    GMV, JOIN_CH, JOIN_CI, MDR, MONTH, N, NET, OK, SCB, SCOST, SFEE, SMDR, SNET, USERS, big, dbl,
    div, growth, money, pct, ratio, share, sql, text,
)
from paytally.sources.readers import normalize_bool

FACT = "fact_transactions"
LOADED = "2000-01-01"


LATE_REFUNDS = """SELECT transaction_id, max(amount) AS refunded_amt,
    CAST(max(settlement_date) + 7 AS DATE) AS settlement_date, 'REFUND' AS status
    FROM fact_transactions WHERE status <> 'SUCCESS' GROUP BY 1
    UNION ALL SELECT -city_id-1, max(amount), max(settlement_date), 'REFUND'
    FROM fact_transactions GROUP BY city_id"""


def late_refunds(f):
    """A batch: refunds of unsuccessful payments, and one unseen payment per city."""
    late = f.filter("status <> 'SUCCESS'").groupBy("transaction_id").agg(
        F.max("amount").alias("refunded_amt"),
        F.date_add(F.max("settlement_date"), 7).alias("settlement_date"),
    ).withColumn("status", F.lit("REFUND"))
    fresh = f.groupBy("city_id").agg(
        F.max("amount").alias("refunded_amt"), F.max("settlement_date").alias("settlement_date")
    ).select((-F.col("city_id") - 1).cast("long").alias("transaction_id"), "refunded_amt",
             "settlement_date", F.lit("REFUND").alias("status"))
    return late.unionByName(fresh)


def upserted(st):
    """The fact with the late refunds. The columns of the fact are computed once, for batch and merge, and so is the
    batch.

    The batch is a quarter of the fact, so both are dealt by id in any case. The number of parts is given here: ids
    pack so well that parts sized by their bytes hold millions of rows a task.
    """
    shown = ["transaction_id", "refunded_amt", "settlement_date", "status", "amount"]
    f = stored(st[FACT].select(*shown, "city_id"), "fact")
    batch = stored(late_refunds(f), "late")
    dealt = f.repartition(int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")), "transaction_id")
    return etl.upsert_refunds(dealt, batch).select(*shown)


def fact(query):
    return lambda st: query(st[FACT])


def with_dims(query, *dims):
    return lambda st: query(st[FACT], *[st[d] for d in dims])


def _sources():
    add("src_01_star_fact", lambda st: st[FACT], sql(
        f"""SELECT transaction_id, {text('txn_ts')} AS txn_ts, {text('txn_date')} AS txn_date,
        {big('customer_id')} AS customer_id, merchant_id, {big('channel_id')} AS channel_id,
        {dbl('amount')} AS amount, {dbl('mdr_pct')} AS mdr_pct, {dbl('cashback_amt')} AS cashback_amt,
        {dbl('processing_fee_amt')} AS processing_fee_amt, status, {big('retry_count')} AS retry_count,
        {text('settlement_date')} AS settlement_date, {dbl('refunded_amt')} AS refunded_amt, device_os,
        {big('city_id')} AS city_id, {big('acquirer_id')} AS acquirer_id FROM fact_transactions"""))
    add("src_02_typed_dates", lambda st: st["dim_customer"], sql(
        f"""SELECT customer_id, {text('signup_date')} AS signup_date,
        {text('first_txn_date')} AS first_txn_date, {big('city_id')} AS city_id, segment_tag
        FROM dim_customer"""))

    def flags(st):
        as_text = st["dim_date"].select(
            "date", F.initcap(F.col("is_weekend").cast("string")).alias("is_weekend")
        )
        fixed = normalize_bool(as_text, ["is_weekend"])
        joined = st[FACT].join(fixed, st[FACT]["txn_date"] == fixed["date"])
        return joined.groupBy("is_weekend").agg(F.count(F.lit(1)).alias("n"))

    add("src_03_normalize_bool", flags, sql(
        f"""SELECT {text('is_weekend')} AS is_weekend, count(*) AS n FROM fact_transactions
        JOIN dim_date ON txn_date = date GROUP BY is_weekend"""))
    add("src_04_schema_dims",
        lambda st: st["dim_merchant"].join(st["dim_city"], "city_id").select(
            "merchant_id", "category", "merchant_name", "city_id", "city_name", "state", "tier"),
        sql(f"""SELECT merchant_id, category, merchant_name, {big('city_id')} AS city_id, city_name,
        state, tier FROM dim_merchant JOIN dim_city USING (city_id)"""))

    def days_of_calendar(st):
        n = st[FACT].groupBy("txn_date").agg(F.count(F.lit(1)).alias("txns"))
        return st["dim_date"].join(n, st["dim_date"]["date"] == n["txn_date"], "left").drop(
            "txn_date").na.fill(0, ["txns"])

    add("src_05_calendar", days_of_calendar, sql(
        f"""SELECT {text('date')} AS date, year, month, day, week_of_year,
        {text('is_weekend')} AS is_weekend, {text('holiday_flag')} AS holiday_flag,
        coalesce(n.txns,0) AS txns FROM dim_date
        LEFT JOIN (SELECT txn_date, count(*) AS txns FROM fact_transactions GROUP BY 1) n
        ON n.txn_date = date"""))


def _etl():
    ok = "status='SUCCESS'"
    rollup = f"""SELECT {text('txn_date')} AS txn_date, {big('channel_id')} AS channel_id,
        {big('city_id')} AS city_id, count(*) AS txn_count,
        count(CASE WHEN {ok} THEN 1 END) AS success_count,
        {dbl(f"sum(CASE WHEN {ok} THEN amount ELSE 0 END)")} AS gmv,
        {dbl(f"sum(CASE WHEN {ok} THEN {NET} ELSE 0 END)")} AS net_revenue,
        {dbl(f"sum(CASE WHEN {ok} THEN cashback_amt ELSE 0 END)")} AS total_cashback,
        {dbl(f"sum(CASE WHEN {ok} THEN processing_fee_amt ELSE 0 END)")} AS total_processing_cost,
        count(DISTINCT customer_id) AS unique_customers
        FROM fact_transactions GROUP BY txn_date, channel_id, city_id"""
    add("etl_01_daily_rollup", fact(etl.daily_rollup), sql(rollup))

    def loaded(st):
        return st[FACT].filter(F.col("txn_date") < LOADED)

    cols = ["transaction_id", "txn_date", "customer_id", "amount", "status"]
    shown = f"""transaction_id, {text('txn_date')} AS txn_date, customer_id,
        {dbl('amount')} AS amount, status"""
    add("etl_02_incremental_append",
        lambda st: etl.incremental_append(loaded(st), st[FACT]).select(*cols),
        sql(f"""SELECT {shown} FROM old UNION ALL SELECT {shown} FROM (
        SELECT n.* FROM fact_transactions n WHERE n.txn_date > (SELECT max(txn_date) FROM old)
        AND NOT EXISTS (SELECT 1 FROM old o WHERE o.transaction_id = n.transaction_id)
        QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY txn_ts DESC, txn_date DESC,
          customer_id DESC, merchant_id DESC, channel_id DESC, amount DESC, mdr_pct DESC, cashback_amt DESC,
          processing_fee_amt DESC, status DESC, retry_count DESC, settlement_date DESC, refunded_amt DESC,
          device_os DESC, city_id DESC, acquirer_id DESC) = 1)""",
            old=f"SELECT * FROM fact_transactions WHERE txn_date < DATE '{LOADED}'"))

    add("etl_03_upsert_refunds",
        upserted,
        sql(f"""SELECT coalesce(f.transaction_id, u.transaction_id) AS transaction_id,
        {dbl('CASE WHEN u.transaction_id IS NOT NULL THEN u.refunded_amt ELSE f.refunded_amt END')}
          AS refunded_amt,
        {text('CASE WHEN u.transaction_id IS NOT NULL THEN u.settlement_date ELSE f.settlement_date END')}
          AS settlement_date,
        CASE WHEN f.transaction_id IS NOT NULL THEN f.status ELSE u.status END AS status,
        {dbl('f.amount')} AS amount
        FROM fact_transactions f FULL JOIN u ON f.transaction_id = u.transaction_id""",
            u=LATE_REFUNDS))
    counts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS total_rows FROM {t}"
        for t in ("dim_date", "dim_channel", "dim_city", "dim_customer", "dim_merchant", FACT))
    add("etl_05_row_counts", quality.row_counts, sql(counts))
    add("dq_01_row_counts", quality.row_counts, sql(counts))


def _quality():
    nulls = ", ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END) AS null_{c}"
                      for c in quality.CRITICAL)
    add("dq_02_null_counts", fact(quality.null_counts),
        sql(f"SELECT count(*) AS total_rows, {nulls} FROM fact_transactions"))

    def checks(key, value, tests):
        return sql(" UNION ALL ".join(
            f"SELECT '{k}' AS {key}, count(*) AS {value} FROM fact_transactions WHERE {w}"
            for k, w in tests))

    add("dq_03_invalid_amounts", fact(quality.invalid_amounts), checks("issue", '"count"', [
        ("negative_amount", "amount < 0"), ("zero_amount", "amount = 0"),
        ("negative_cashback", "cashback_amt < 0"), ("negative_processing", "processing_fee_amt < 0"),
        ("cashback_exceeds_mdr", f"cashback_amt > {MDR}")]))
    orphans = " UNION ALL ".join(
        f"""SELECT 'missing_{n}' AS issue, count(*) AS orphan_count FROM fact_transactions t
        LEFT JOIN {d} d ON t.{k} = d.{dk} WHERE d.{dk} IS NULL"""
        for n, d, k, dk in (("customer", "dim_customer", "customer_id", "customer_id"),
                            ("merchant", "dim_merchant", "merchant_id", "merchant_id"),
                            ("channel", "few_channels", "channel_id", "channel_id"),
                            ("city", "dim_city", "city_id", "city_id"),
                            ("date", "short_calendar", "txn_date", "date")))

    def gaps(st):
        # The star has no orphans, so these checks leave out a channel and the last days.
        return {t: st[t] for t in ("dim_customer", "dim_merchant", "dim_city")} | {
            "dim_channel": st["dim_channel"].filter("channel_id < 5"),
            "dim_date": st["dim_date"].filter("date <= DATE '2001-06-30'")}

    short = "SELECT * FROM dim_date WHERE date <= DATE '2001-06-30'"
    add("dq_04_orphans", lambda st: quality.orphans(st[FACT], gaps(st)), sql(
        orphans, few_channels="SELECT * FROM dim_channel WHERE channel_id < 5", short_calendar=short))
    add("dq_05_duplicate_ids", fact(quality.duplicate_ids), sql(
        """SELECT transaction_id, count(*) AS dup_count FROM fact_transactions GROUP BY 1
        HAVING count(*) > 1 ORDER BY dup_count DESC, transaction_id LIMIT 10"""))
    add("dq_06_duplicate_total", fact(quality.duplicate_total), sql(
        "SELECT count(*) - count(DISTINCT transaction_id) AS duplicate_txn_ids FROM fact_transactions"))
    add("dq_07_potential_duplicates", fact(quality.potential_duplicates), sql(
        f"""SELECT customer_id, {text('txn_date')} AS txn_date, {dbl('amount')} AS amount,
        {big('channel_id')} AS channel_id, potential_dups FROM (
        SELECT customer_id, txn_date, amount, channel_id, count(*) AS potential_dups FROM s
        GROUP BY 1,2,3,4 HAVING count(*) > 1
        ORDER BY potential_dups DESC, customer_id, txn_date, amount, channel_id LIMIT 20)"""))
    add("dq_08_status_distribution", fact(quality.status_distribution), sql(
        f"SELECT status, {N} AS txn_count, {share(N)} AS pct FROM fact_transactions GROUP BY status"))
    add("dq_09_date_coverage", fact(quality.date_coverage), sql(
        f"""SELECT {text('min(txn_date)')} AS earliest_txn, {text('max(txn_date)')} AS latest_txn,
        count(DISTINCT txn_date) AS distinct_dates, count(DISTINCT {MONTH}) AS distinct_months
        FROM fact_transactions"""))
    add("dq_10_dates_not_in_dim", lambda st: quality.dates_not_in_dim(st[FACT], gaps(st)["dim_date"]), sql(
        """SELECT count(DISTINCT txn_date) AS fact_dates_not_in_dim FROM fact_transactions f
        LEFT JOIN short_calendar d ON f.txn_date = d.date WHERE d.date IS NULL""", short_calendar=short))
    for name, dim, key in (("channels", "dim_channel", "channel_id"), ("dates", "dim_date", "date")):
        # Nothing may fall out of an inner join with a dimension.
        def lossless(st, dim=dim, key=key):
            keys = st[dim].select(F.col(key).alias("_key"))
            fact_key = F.col("txn_date" if key == "date" else key)
            return st[FACT].groupBy(fact_key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).join(
                keys, "_key", "left").agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(  # one row each
                    st[FACT].join(keys.withColumnRenamed("_key", "_k"), fact_key == F.col("_k")).agg(
                        F.count(F.lit(1)).alias("joined"))))

        add(f"src_06_lossless_{name}", lossless, sql(
            f"""SELECT (SELECT count(*) FROM fact_transactions) AS rows, count(*) AS joined
            FROM fact_transactions f JOIN {dim} d ON f.{'txn_date' if key == 'date' else key} = d.{key}"""))
    add("dq_11_mdr_range", fact(quality.mdr_range), sql(
        f"""SELECT {dbl('min(mdr_pct)')} AS min_mdr, {dbl('max(mdr_pct)')} AS max_mdr,
        {ratio('sum(mdr_pct)', N, 6)} AS avg_mdr,
        round(quantile_cont({dbl('mdr_pct')},0.5),6) AS median_mdr FROM s"""))
    add("dq_12_mdr_out_of_range", fact(quality.mdr_out_of_range), sql(
        f"""SELECT {dbl('min(mdr_pct)')} AS min_mdr, {dbl('max(mdr_pct)')} AS max_mdr,
        {ratio('sum(mdr_pct)', N, 6)} AS avg_mdr,
        count(*) FILTER (WHERE mdr_pct < 0 OR mdr_pct > 5) AS invalid_mdr FROM fact_transactions"""))
    for key, fn, pop in (("dq_13_outliers_sample", "stddev_samp", False),
                         ("dq_14_outliers_population", "stddev_pop", True)):
        for k, suffix in ((3, ""), (1.5, "_wide")):
            add(key + suffix, fact(lambda f, k=k, pop=pop: quality.outliers(f, k, pop)), sql(
                f"""SELECT count(*) AS outlier_count FROM s, (SELECT avg({dbl('amount')}) AS m,
                {fn}({dbl('amount')}) AS sd FROM s) WHERE abs({dbl('amount')} - m) > {k} * sd"""))
    add("dq_15_18_rule_violations", fact(quality.rule_violations), checks("rule", "n", [
        ("invalid_amounts", "amount <= 0"), ("cashback_exceeds_amount", "cashback_amt > amount"),
        ("high_processing_fee", "processing_fee_amt > amount*0.10"),
        ("invalid_settlement", "settlement_date < txn_date"),
        ("refunded_success_txns", "status='SUCCESS' AND refunded_amt > 0")]))
    add("dq_19_amount_summary", fact(quality.amount_summary), sql(
        f"""SELECT {money('min(amount)')} AS min_amount, {money('max(amount)')} AS max_amount,
        {ratio(GMV, N)} AS avg_amount, count(*) AS total_txns FROM s"""))
    for key, asc, word in (("dq_20_daily_lows", True, "ASC"), ("dq_20_daily_highs", False, "DESC")):
        add(key, fact(lambda f, a=asc: quality.daily_extremes(f, asc=a)), sql(
            f"""SELECT {text('d')} AS txn_date, txn_count, {money('gmv')} AS daily_gmv FROM (
            SELECT txn_date AS d, {N} AS txn_count, {GMV} AS gmv FROM s GROUP BY 1
            ORDER BY gmv {word}, d LIMIT 10)"""))
    add("dq_21_monthly_counts", fact(quality.monthly_counts), sql(
        f"SELECT {MONTH} AS month, {N} AS txn_count, {money(GMV)} AS monthly_gmv FROM s GROUP BY 1"))
    add("dq_22_channel_counts", with_dims(quality.channel_counts, "dim_channel"), sql(
        f"SELECT channel_name, {N} AS txn_count FROM fact_transactions {JOIN_CH} GROUP BY 1"))
    add("dq_23_device_share", fact(quality.device_share), sql(
        f"SELECT device_os, {N} AS txn_count, {share(N)} AS pct FROM fact_transactions GROUP BY 1"))
    add("dq_24_health_report", fact(quality.health_report), sql(
        f"""SELECT {N} AS total_txns, {OK} AS success_txns,
        count(*) FILTER (WHERE status='FAILED') AS failed_txns,
        count(*) FILTER (WHERE status='PENDING') AS pending_txns, {pct(OK, N)} AS success_rate_pct,
        {money("sum(amount) FILTER (WHERE status='SUCCESS')")} AS total_gmv,
        {ratio("sum(amount) FILTER (WHERE status='SUCCESS')", OK)} AS avg_txn_value,
        {USERS} AS unique_customers FROM fact_transactions"""))


def _kpi():
    add("kpi_01_gmv_summary", fact(kpi.gmv_summary), sql(
        f"""SELECT {money(GMV)} AS total_gmv, {N} AS total_txn_count, {USERS} AS unique_customers,
        count(DISTINCT merchant_id) AS unique_merchants, {ratio(GMV, N)} AS avg_txn_value FROM s"""))
    add("kpi_02_monthly_gmv", fact(kpi.monthly_gmv), sql(
        f"""SELECT {MONTH} AS month, {money(GMV)} AS gmv, {N} AS txn_count,
        {USERS} AS unique_customers FROM s GROUP BY 1"""))
    add("kpi_03_revenue_summary", fact(kpi.revenue_summary), sql(
        f"""SELECT {money(GMV)} AS total_gmv, {money(SMDR)} AS gross_mdr_revenue,
        {money(SCB)} AS total_cashback, {money(SFEE)} AS total_processing_cost,
        {money(SNET)} AS net_revenue, {pct(SNET, GMV, 4)} AS margin_pct FROM s"""))
    add("kpi_04_monthly_revenue", fact(kpi.monthly_revenue), sql(
        f"""SELECT {MONTH} AS month, {money(GMV)} AS gmv, {money(SMDR)} AS gross_mdr,
        {money(SCB)} AS cashback, {money(SFEE)} AS processing_cost, {money(SNET)} AS net_revenue
        FROM s GROUP BY 1"""))
    add("kpi_05_margin", fact(kpi.margin), sql(f"SELECT {pct(SNET, GMV, 4)} AS margin_pct FROM s"))
    add("kpi_06_monthly_margin", fact(kpi.monthly_margin), sql(
        f"""SELECT {MONTH} AS month, {N} AS txn_count, {USERS} AS mau, {money(GMV)} AS gmv,
        {money(SNET)} AS net_revenue, {pct(SNET, GMV, 4)} AS margin_pct FROM s GROUP BY 1"""))
    add("kpi_07_mau", fact(kpi.mau), sql(f"SELECT {MONTH} AS month, {USERS} AS mau FROM s GROUP BY 1"))
    add("kpi_08_mau_activity", fact(kpi.mau_activity), sql(
        f"""SELECT {MONTH} AS month, {USERS} AS mau, {N} AS txn_count,
        {ratio(N, USERS)} AS avg_txns_per_user FROM s GROUP BY 1"""))
    months = f"""SELECT {MONTH} AS month, {GMV} AS gmv, {SNET} AS net, {USERS} AS users,
        {N} AS n, {SMDR} AS mdr, {SCB} AS cb, {SFEE} AS fee FROM s GROUP BY 1"""
    lag = "lag({0}) OVER (ORDER BY month)".format
    add("kpi_09_mom_growth", fact(kpi.mom_growth), sql(
        f"""SELECT month, {money('gmv')} AS gmv, {money('net')} AS net_revenue, users AS mau,
        {growth('gmv', lag('gmv'))} AS gmv_mom_pct, {growth('net', lag('net'))} AS rev_mom_pct,
        {growth('users', lag('users'))} AS mau_mom_pct FROM m""", m=months))
    add("kpi_10_status_share", fact(kpi.status_share), sql(
        f"""SELECT status, {N} AS txn_count, {share(N)} AS pct, {money(GMV)} AS total_amount
        FROM fact_transactions GROUP BY 1"""))
    add("kpi_11_monthly_success", fact(kpi.monthly_success), sql(
        f"""SELECT {MONTH} AS month, {N} AS total_txns, {OK} AS success_txns,
        {pct(OK, N)} AS success_rate_pct FROM fact_transactions GROUP BY 1"""))
    add("kpi_12_monthly_aov", fact(kpi.monthly_aov), sql(
        f"""SELECT {MONTH} AS month, {ratio(GMV, N)} AS avg_order_value,
        {money('min(amount)')} AS min_amount, {money('max(amount)')} AS max_amount,
        round(quantile_cont({dbl('amount')},0.5),2) AS median_amount FROM s GROUP BY 1"""))
    add("kpi_13_revenue_per_user", fact(kpi.revenue_per_user), sql(
        f"""SELECT {ratio('sum(u)', N, 4)} AS avg_revenue_per_user,
        {money('min(u)', 4)} AS min_rev_per_user, {money('max(u)', 4)} AS max_rev_per_user
        FROM (SELECT {SNET} AS u FROM s GROUP BY customer_id)"""))
    add("kpi_14_platform_summary", fact(kpi.platform_summary), sql(
        f"""SELECT {money(GMV)} AS total_gmv, {money(SNET)} AS net_revenue,
        {pct(SNET, GMV, 4)} AS margin_pct, {N} AS total_txns, {USERS} AS unique_customers,
        {ratio(GMV, N)} AS avg_txn_value, {pct(SCB, GMV, 4)} AS cashback_rate_pct,
        {ratio(SFEE, N, 4)} AS avg_proc_fee FROM s"""))
    add("kpi_14_executive_summary", with_dims(kpi.executive_summary, "dim_channel"), sql(
        f"""SELECT {text('min(txn_date)')} AS period_start, {text('max(txn_date)')} AS period_end,
        {money(GMV)} AS total_gmv, {money(SNET)} AS net_revenue, {pct(SNET, GMV, 4)} AS margin_pct,
        {USERS} AS total_customers,
        {pct(N, '(SELECT count(*) FROM fact_transactions)')} AS success_rate_pct,
        {ratio(GMV, SCB)} AS gmv_per_cashback,
        {pct("sum(CASE WHEN channel_name='UPI' THEN amount END)", GMV, 1)} AS channel_gmv_share_pct
        FROM s LEFT JOIN dim_channel USING (channel_id)"""))
    full = f"""SELECT month AS txn_month, n AS txn_count, {dbl('gmv')} AS gmv,
        {dbl('mdr')} AS gross_mdr_rev, {dbl('cb')} AS cashback_cost, {dbl('fee')} AS processing_cost,
        {dbl('net')} AS net_revenue, users AS mau, {pct('net', 'gmv', 10)} AS margin_pct,
        {growth('gmv', lag('gmv'), 10)} AS gmv_mom_growth_pct,
        {growth('net', lag('net'), 10)} AS rev_mom_growth_pct,
        {growth('users', lag('users'), 10)} AS mau_mom_growth_pct FROM m"""
    add("kpi_15_monthly_kpi", fact(kpi.monthly_kpi), sql(full, m=months))
    add("kpi_16_device_breakdown", fact(kpi.device_breakdown), sql(
        f"""SELECT device_os, {N} AS txn_count, {money(GMV)} AS gmv, {share(N)} AS pct_of_total,
        {share(GMV)} AS gmv_share_pct, {ratio(GMV, N)} AS avg_txn_value FROM s GROUP BY 1"""))
    for key, flags in (("kpi_17_daytype", ("is_weekend", "holiday_flag")),
                       ("kpi_17_weekend", ("is_weekend",)), ("kpi_17_holiday", ("holiday_flag",))):
        shown = ", ".join(f"{text(x)} AS {x}" for x in flags)
        add(key, lambda st, fl=flags: kpi.daytype(st[FACT], st["dim_date"], *fl), sql(
            f"""SELECT {shown}, {N} AS txn_count, {USERS} AS unique_users,
            {money(GMV)} AS total_gmv, {ratio(GMV, N)} AS avg_txn_amount,
            {pct(SNET, GMV, 4)} AS margin_pct FROM s JOIN dim_date ON txn_date = date
            GROUP BY {', '.join(flags)}"""))


def _channels():
    ch = f"FROM s {JOIN_CH} GROUP BY channel_name"
    dim = "dim_channel"

    def by_channel(key, query, columns, source=ch):
        add(key, with_dims(query, dim), sql(f"SELECT channel_name, {columns} {source}"))

    by_channel("ch_01_mix", channel.mix,
               f"""{N} AS txn_count, {money(GMV)} AS gmv, {share(N)} AS txn_share_pct,
               {share(GMV)} AS gmv_share_pct, {ratio(GMV, N)} AS avg_txn_value,
               {USERS} AS unique_users""")
    by_channel("ch_02_monthly", channel.monthly,
               f"""{MONTH} AS month, {N} AS txn_count, {money(GMV)} AS gmv,
               {money(SNET)} AS net_revenue""", f"FROM s {JOIN_CH} GROUP BY channel_name, {MONTH}")
    by_channel("ch_03_margin", channel.margin,
               f"""{money(GMV)} AS gmv, {money(SMDR)} AS gross_mdr, {money(SCB)} AS total_cashback,
               {money(SFEE)} AS processing_cost, {money(SNET)} AS net_revenue,
               {pct(SNET, GMV, 4)} AS margin_pct""")
    by_channel("ch_04_rates", channel.rates,
               f"""{ratio('sum(mdr_pct)', N, 4)} AS avg_mdr_pct,
               {ratio(SCB, N, 4)} AS avg_cashback_per_txn,
               {ratio(SFEE, N, 4)} AS avg_processing_per_txn, {pct(SNET, GMV, 4)} AS net_margin_pct""")
    by_channel("ch_05_efficiency", channel.efficiency,
               f"""{N} AS txn_count, {money(GMV)} AS gmv, {money(SMDR)} AS gross_mdr_income,
               {money(SCB)} AS cashback_cost, {money(SFEE)} AS processing_cost,
               {money(SNET)} AS net_revenue, {money(SCOST)} AS total_cost,
               {ratio(SNET, SCOST, 4)} AS efficiency_ratio, {pct(SNET, GMV, 4)} AS margin_pct""")
    by_channel("ch_06_fees", channel.fees,
               f"""{ratio(SFEE, N, 4)} AS avg_processing_fee,
               {money('min(processing_fee_amt)', 4)} AS min_processing_fee,
               {money('max(processing_fee_amt)', 4)} AS max_processing_fee, {N} AS txn_count""")
    every = f"FROM fact_transactions {JOIN_CH} GROUP BY channel_name"
    retries = "sum(CASE WHEN status='SUCCESS' THEN retry_count END)"
    by_channel("ch_07_success", channel.success,
               f"""{N} AS total_txns, {OK} AS success_txns, {pct(OK, N)} AS success_rate_pct,
               {ratio(retries, OK)} AS avg_retries_on_success""", every)
    failed = "count(*) FILTER (WHERE status='FAILED')"
    by_channel("ch_08_failures", channel.failures,
               f"""{N} AS total_txns, {failed} AS failed_txns,
               {pct(failed, N)} AS failure_rate_pct""", every)
    lag = "lag(gmv) OVER (PARTITION BY channel_name ORDER BY month)"
    add("ch_09_mom", with_dims(channel.mom, dim), sql(
        f"""SELECT month, channel_name, {money('gmv')} AS gmv, {money(f'gmv - {lag}')} AS mom_change,
        {growth('gmv', lag)} AS mom_pct FROM m""",
        m=f"SELECT {MONTH} AS month, channel_name, {GMV} AS gmv FROM s {JOIN_CH} GROUP BY 1,2"))
    by_channel("ch_10_device", channel.device,
               f"""device_os, {N} AS txn_count, {money(GMV)} AS gmv,
               {share(N, 'PARTITION BY channel_name')} AS pct_of_channel""",
               f"FROM s {JOIN_CH} GROUP BY channel_name, device_os")
    ok_fee = "sum(processing_fee_amt) FILTER (WHERE status='SUCCESS')"
    add("ch_11_acquirer", fact(channel.acquirer), sql(
        f"""SELECT {big('acquirer_id')} AS acquirer_id, {N} AS total_txns, {OK} AS success_txns,
        {failed} AS failed_txns, {pct(OK, N)} AS success_rate_pct,
        {ratio(ok_fee, OK, 4)} AS avg_processing_fee,
        {money("sum(amount) FILTER (WHERE status='SUCCESS')")} AS total_gmv_processed
        FROM fact_transactions GROUP BY acquirer_id"""))
    add("ch_11_acquirer_cost", fact(channel.acquirer_cost), sql(
        f"""SELECT {big('acquirer_id')} AS acquirer_id, {N} AS txn_count,
        {ratio(SFEE, N, 4)} AS avg_fee, {money(SFEE)} AS total_cost, {money(GMV)} AS gmv,
        {pct(OK, N)} AS success_rate FROM fact_transactions GROUP BY acquirer_id"""))
    add("ch_12_above_mean", with_dims(channel.above_mean, dim), sql(
        f"""SELECT channel_name, margin_pct, round(avg(margin_pct) OVER (),4) AS mean_margin_pct,
        {text('margin_pct > avg(margin_pct) OVER ()')} AS above_mean FROM m""",
        m=f"SELECT channel_name, {pct(SNET, GMV, 4)} AS margin_pct {ch}"))
    add("so_06_best_efficiency_channel", with_dims(channel.best_efficiency, dim), sql(
        """SELECT max_by(channel_name, e) AS best_channel, round(max(e),4) AS efficiency_ratio FROM m""",
        m=f"SELECT channel_name, {div(SNET, SCOST)} AS e {ch}"))


def _geo():
    city = "city_name, state, tier"

    def located(columns, by, tail=""):
        return f"SELECT {by}, {columns} FROM s {JOIN_CI} GROUP BY {by} {tail}"

    add("geo_01_state", with_dims(geo.state, "dim_city"), sql(located(
        f"""{N} AS txn_count, {money(GMV)} AS gmv, {money(SNET)} AS net_revenue,
        {USERS} AS unique_customers, {ratio(GMV, N)} AS avg_txn_value, {share(GMV)} AS gmv_share_pct,
        rank() OVER (ORDER BY {GMV} DESC) AS gmv_rank""", "state")))
    for key, n in (("geo_02_top_cities_20", 20), ("geo_02_top_cities_15", 15)):
        add(key, lambda st, n=n: geo.top_cities(st[FACT], st["dim_city"], n), sql(located(
            f"""{N} AS txn_count, {money(GMV)} AS gmv, {USERS} AS unique_customers,
            {ratio(GMV, N)} AS avg_txn_value""", city, f"ORDER BY {GMV} DESC, {city} LIMIT {n}")))
    add("geo_03_tier", with_dims(geo.tier, "dim_city"), sql(located(
        f"""count(DISTINCT city_id) AS city_count, {N} AS txn_count, {money(GMV)} AS gmv,
        {money(SNET)} AS net_revenue, {USERS} AS unique_customers, {ratio(GMV, N)} AS avg_txn_value,
        {share(GMV)} AS gmv_share_pct, {pct(SNET, GMV, 4)} AS margin_pct""", "tier")))
    add("geo_04_category_tier", with_dims(geo.category_tier, "dim_city", "dim_merchant"), sql(
        f"""SELECT tier, category, {N} AS txn_count, {money(GMV)} AS gmv,
        {ratio(GMV, N)} AS avg_txn_value FROM s {JOIN_CI}
        JOIN (SELECT merchant_id, category FROM dim_merchant) USING (merchant_id) GROUP BY 1,2"""))
    add("geo_05_channel_tier", with_dims(geo.channel_tier, "dim_city", "dim_channel"), sql(
        f"""SELECT tier, channel_name, {N} AS txn_count, {money(GMV)} AS gmv,
        {share(N, 'PARTITION BY tier')} AS channel_pct_within_tier FROM s {JOIN_CI} {JOIN_CH}
        GROUP BY tier, channel_name"""))
    lag = "lag(gmv) OVER (PARTITION BY state ORDER BY month)"
    add("geo_06_state_mom", with_dims(geo.state_mom, "dim_city"), sql(
        f"SELECT state, month, {money('gmv')} AS gmv, {growth('gmv', lag)} AS mom_pct FROM m",
        m=f"SELECT state, {MONTH} AS month, {GMV} AS gmv FROM s {JOIN_CI} GROUP BY 1,2"))
    add("geo_07_opportunities", with_dims(geo.opportunities, "dim_city"), sql(
        f"""SELECT * FROM m ORDER BY margin_pct, {city} LIMIT 15""",
        m=located(f"{money(GMV)} AS gmv, {pct(SNET, GMV, 4)} AS margin_pct", city,
                  f"HAVING {GMV} > 50000")))
    add("geo_08_state_tier", with_dims(geo.state_tier, "dim_city"), sql(located(
        f"""{N} AS txn_count, {USERS} AS unique_customers, {money(GMV)} AS gmv,
        {money(SNET)} AS net_revenue""", "state, tier")))
    add("geo_09_tier_of_top", with_dims(geo.tier_of_top, "dim_city"), sql(
        f"SELECT tier, {money('sum(gmv)')} AS gmv FROM m GROUP BY tier",
        m=located(f"{GMV} AS gmv", "state, tier", "ORDER BY gmv DESC, state, tier LIMIT 15")))


def _merchants_and_costs():
    cat = """FROM s JOIN (SELECT merchant_id, category FROM dim_merchant) USING (merchant_id)
        GROUP BY category"""
    add("mer_01_category", with_dims(merchant.category, "dim_merchant"), sql(
        f"""SELECT category, {N} AS txn_count, {USERS} AS unique_customers, {money(GMV)} AS gmv,
        {share(GMV)} AS gmv_share_pct, {ratio(GMV, N)} AS avg_txn_value, {money(SNET)} AS net_revenue,
        {pct(SNET, GMV, 4)} AS margin_pct {cat}"""))
    add("mer_02_top", with_dims(merchant.top, "dim_merchant", "dim_city"), sql(
        f"""SELECT merchant_name, category, city_name, {N} AS txn_count, {money(GMV)} AS gmv,
        {money(SNET)} AS net_revenue, {ratio(GMV, N)} AS avg_ticket_size FROM s
        JOIN dim_merchant m ON s.merchant_id = m.merchant_id JOIN dim_city c ON m.city_id = c.city_id
        GROUP BY 1,2,3 ORDER BY {GMV} DESC, 1, 2, 3 LIMIT 20"""))
    add("cost_01_summary", fact(cost.summary), sql(
        f"""SELECT {money(SFEE)} AS total_processing_cost, {ratio(SFEE, N, 4)} AS avg_cost_per_txn,
        {money('min(processing_fee_amt)', 4)} AS min_cost,
        {money('max(processing_fee_amt)', 4)} AS max_cost, {N} AS txn_count,
        {pct(SFEE, GMV, 4)} AS cost_as_pct_of_gmv FROM s"""))
    add("cost_02_by_channel", with_dims(cost.by_channel, "dim_channel"), sql(
        f"""SELECT channel_name, {ratio(SFEE, N, 4)} AS avg_processing_cost,
        {money(SFEE)} AS total_processing_cost, {N} AS txn_count,
        {pct(SFEE, GMV, 4)} AS cost_pct_gmv FROM s {JOIN_CH} GROUP BY 1"""))
    ok_fee = "sum(CASE WHEN status='SUCCESS' THEN processing_fee_amt END)"
    add("rt_01_by_count", fact(retry.by_count), sql(
        f"""SELECT {big('retry_count')} AS retry_count, {N} AS txn_count, {share(N)} AS pct_of_total,
        {OK} AS success_count, {pct(OK, N)} AS success_rate_pct,
        {ratio(SFEE, N, 4)} AS avg_processing_fee, {ratio(ok_fee, OK, 4)} AS avg_processing_cost
        FROM fact_transactions GROUP BY retry_count"""))
    bad_fee = "sum(CASE WHEN status<>'SUCCESS' THEN processing_fee_amt ELSE 0 END)"
    add("rt_02_wasted_cost", fact(retry.wasted_cost), sql(
        f"""SELECT {money(bad_fee)} AS failed_processing_cost,
        {money(ok_fee)} AS success_processing_cost, {pct(bad_fee, SFEE)} AS wasted_cost_pct
        FROM fact_transactions"""))
    add("rt_03_by_channel", with_dims(retry.by_channel, "dim_channel"), sql(
        f"""SELECT channel_name, {big('retry_count')} AS retry_count, {N} AS txn_count,
        {ratio(GMV, N)} AS avg_amount FROM fact_transactions {JOIN_CH}
        GROUP BY channel_name, retry_count"""))


def _cashback():
    have = "count(CASE WHEN cashback_amt > 0 THEN 1 END)"
    gmv_cb = "sum(CASE WHEN cashback_amt > 0 THEN amount ELSE 0 END)"
    gmv_no = "sum(CASE WHEN cashback_amt = 0 THEN amount ELSE 0 END)"
    add("cb_01_summary", fact(cashback.summary), sql(
        f"""SELECT {N} AS total_txns, {have} AS cashback_txns,
        count(CASE WHEN cashback_amt = 0 THEN 1 END) AS txns_without_cashback,
        {pct(have, N)} AS cashback_txn_pct, {money(SCB)} AS total_cashback_cost,
        {money(GMV)} AS total_gmv, {money(gmv_cb)} AS cashback_gmv, {money(gmv_no)} AS no_cashback_gmv,
        {pct(SCB, GMV, 4)} AS cashback_as_pct_of_gmv, {ratio(GMV, SCB)} AS gmv_per_cashback_rupee,
        {ratio(SMDR, SCB)} AS mdr_revenue_per_cashback_rupee,
        {ratio(SNET, SCB)} AS net_return_per_cashback_rupee FROM s"""))
    add("cb_02_by_channel", with_dims(cashback.by_channel, "dim_channel"), sql(
        f"""SELECT channel_name, {N} AS total_txns, {have} AS cashback_txns,
        {pct(have, N)} AS cashback_txn_pct, {money(GMV)} AS gmv, {money(SCB)} AS total_cashback,
        {money(gmv_cb)} AS cashback_gmv, {ratio(GMV, SCB)} AS gmv_per_cashback_rupee,
        {pct(SCB, GMV, 4)} AS cashback_rate_pct, {ratio(gmv_cb, SCB)} AS cashback_gmv_per_rupee,
        {pct(SCB, gmv_cb, 4)} AS cashback_gmv_rate_pct, {money(SNET)} AS net_revenue
        FROM s {JOIN_CH} GROUP BY 1"""))
    add("cb_03_monthly", fact(cashback.monthly), sql(
        f"""SELECT {MONTH} AS month, {money(SCB)} AS total_cashback, {money(GMV)} AS gmv,
        {pct(SCB, GMV, 4)} AS cashback_rate_pct, {money(SFEE)} AS processing_cost,
        {money(SMDR)} AS mdr_income, {money(SNET)} AS net_revenue, {pct(SNET, GMV, 4)} AS margin_pct,
        {ratio(GMV, SCB)} AS gmv_per_cashback_rupee FROM s GROUP BY 1"""))
    add("cb_04_txn_groups", fact(cashback.txn_groups), sql(
        f"""SELECT CASE WHEN cashback_amt > 0 THEN 'With Cashback' ELSE 'Without Cashback' END
          AS cashback_group, {USERS} AS unique_users, {N} AS txn_count, {money(GMV)} AS total_gmv,
        {ratio(GMV, N)} AS avg_txn_value, {ratio(GMV, USERS)} AS gmv_per_customer,
        {ratio(N, USERS)} AS avg_txns_per_user FROM s GROUP BY 1"""))
    add("cb_05_customer_groups", fact(cashback.customer_groups), sql(
        f"""SELECT CASE WHEN cb > 0 THEN 'Received Cashback' ELSE 'No Cashback' END AS cashback_group,
        {N} AS customer_count, {ratio('sum(spend)', N)} AS avg_spend_per_customer,
        {ratio('sum(n)', N)} AS avg_txns_per_customer, {ratio('sum(cb)', N, 4)} AS avg_cashback_received
        FROM (SELECT {N} AS n, {GMV} AS spend, {SCB} AS cb FROM s GROUP BY customer_id) GROUP BY 1"""))


def register():
    _sources()
    _etl()
    _quality()
    _kpi()
    _channels()
    _geo()
    _merchants_and_costs()
    _cashback()
