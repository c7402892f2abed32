"""Projections, predicates, joins, aggregations and set operations as the reports write them inline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paytally.functions.expr import (
    amount_at_most, between_dates, days_since, dbl, hour_key, lookup, money, month_key, month_num,
    month_start, months_since, net_revenue, pct, ratio, rnd, successful, with_revenue, with_success_flag,
    within_last,
)
from paytally.operators import churn, clv, kpi, stats
from paytally.plans.catalog import add
from paytally.plans.catalog_customers import U, _labelled
from paytally.plans.catalog_platform import FACT, fact
from paytally.plans.sqltext import (
    GMV, JOIN_CH, MONTH, N, SNET, USERS, big, dbl as sdbl, growth, money as smoney, pct as spct,
    ratio as sratio, sql, text,
)

CAP = 20000


def _projections():
    ident = ["transaction_id", "merchant_id"]
    add("prj_01_02_revenue_columns",
        fact(lambda f: with_revenue(successful(f)).select(*ident, "mdr_revenue", "net_revenue")),
        sql(f"""SELECT transaction_id, merchant_id, {sdbl('mdr')} AS mdr_revenue,
        {sdbl('net')} AS net_revenue FROM s"""))
    add("prj_03_success_flag",
        fact(lambda f: with_success_flag(f).select(*ident, "status", "is_success")),
        sql("""SELECT transaction_id, merchant_id, status,
        CASE WHEN status='SUCCESS' THEN 1 ELSE 0 END::BIGINT AS is_success FROM fact_transactions"""))
    add("prj_04_07_date_keys", fact(lambda f: f.select(
        *ident, month_key().alias("month"), month_start().alias("month_start"),
        hour_key().alias("hour"), month_num().alias("month_num"))),
        sql(f"""SELECT transaction_id, merchant_id, {MONTH} AS month,
        {text("CAST(date_trunc('month', txn_date) AS DATE)")} AS month_start, hour(txn_ts) AS hour,
        month(txn_date) AS month_num FROM fact_transactions"""))
    add("prj_08_09_date_distances", fact(lambda f: f.select(
        *ident, months_since("settlement_date", "txn_date").alias("months"),
        days_since(F.col("settlement_date"), "txn_date").alias("days"))),
        sql("""SELECT transaction_id, merchant_id,
        datediff('month', txn_date, settlement_date) AS months,
        datediff('day', txn_date, settlement_date) AS days FROM fact_transactions"""))

    def recent(f):
        last = f.agg(F.max("txn_date").alias("last"))
        return f.crossJoin(F.broadcast(last)).agg(  # one row
            F.count_if(within_last("txn_date", 90, F.col("last"))).alias("last_90_days"),
            F.count_if(between_dates("txn_date", "1997-06-01", "1997-09-30")).alias("in_window"))

    add("prj_10_11_date_windows", fact(recent), sql(
        """SELECT count(*) FILTER (WHERE txn_date >= (SELECT max(txn_date) FROM fact_transactions)
          - INTERVAL 90 DAY) AS last_90_days,
        count(*) FILTER (WHERE txn_date BETWEEN DATE '1997-06-01' AND DATE '1997-09-30') AS in_window
        FROM fact_transactions"""))
    add("prj_12_amount_cap", fact(lambda f: amount_at_most(successful(f), CAP).agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("gmv"))), sql(
        f"SELECT {N} AS n, {smoney(GMV)} AS gmv FROM s WHERE amount <= {CAP}"))
    add("prj_14_predicates", fact(lambda f: f.agg(
        F.count_if(F.col("device_os").isin("Android", "iOS")).alias("in_list"),
        F.count_if(F.col("retry_count").between(1, 2)).alias("in_range"),
        F.count_if(F.col("settlement_date").isNull()).alias("unsettled"),
        F.count_if(F.col("status") != "SUCCESS").alias("not_success"),
        F.count_if((F.col("mdr_pct") < 1) | (F.col("mdr_pct") > 5)).alias("either"))), sql(
        """SELECT count(CASE WHEN device_os IN ('Android','iOS') THEN 1 END) AS in_list,
        count(CASE WHEN retry_count BETWEEN 1 AND 2 THEN 1 END) AS in_range,
        count(CASE WHEN settlement_date IS NULL THEN 1 END) AS unsettled,
        count(CASE WHEN status != 'SUCCESS' THEN 1 END) AS not_success,
        count(CASE WHEN mdr_pct < 1 OR mdr_pct > 5 THEN 1 END) AS either FROM fact_transactions"""))
    x = sdbl("net")
    add("prj_15_clip_at_percentile",
        fact(lambda f: stats.clip_at(clv.per_customer(f).select("customer_id", "net"), "net", 0.95)
             .select("customer_id", rnd("net", 4).alias("net"))),
        sql(f"""SELECT customer_id,
        round(least({x}, (SELECT quantile_cont({x},0.95) FROM u)),4) AS net FROM u""", u=U))
    add("prj_16_trim_above_percentile",
        fact(lambda f: stats.trim_above(stats.ab_frame(f), "total_spend", 0.99)
             .select("customer_id", "group_label", "total_spend")),
        sql(f"""SELECT customer_id, 'Cashback' AS group_label, {sdbl('gmv')} AS total_spend FROM u
        WHERE {sdbl('gmv')} < (SELECT quantile_cont({sdbl('gmv')},0.99) FROM u)
        AND customer_id IN (SELECT customer_id FROM s GROUP BY 1 HAVING sum(cashback_amt) > 0)
        UNION ALL SELECT customer_id, 'No Cashback', {sdbl('gmv')} FROM u
        WHERE {sdbl('gmv')} < (SELECT quantile_cont({sdbl('gmv')},0.99) FROM u)
        AND customer_id IN (SELECT customer_id FROM s GROUP BY 1 HAVING sum(cashback_amt) <= 0)""", u=U))
    add("prj_17_drop_incomplete",
        fact(lambda f: kpi.mom_growth(f).dropna().select("month", "gmv_mom_pct", "mau_mom_pct")),
        sql(f"""SELECT month, {growth('g', 'lag(g) OVER (ORDER BY month)')} AS gmv_mom_pct,
        {growth('u', 'lag(u) OVER (ORDER BY month)')} AS mau_mom_pct FROM m
        QUALIFY lag(g) OVER (ORDER BY month) IS NOT NULL""",
            m=f"SELECT {MONTH} AS month, {GMV} AS g, {USERS} AS u FROM s GROUP BY 1"))


def _joins():
    def enriched(st):
        both = lookup(lookup(st[FACT], st["dim_channel"], "channel_id", "channel_name", how="left"),
                      st["dim_city"], "city_id", "tier", how="left")
        return both.groupBy("channel_name", "tier").agg(F.count(F.lit(1)).alias("n"))

    add("jn_04_left_enrich", enriched, sql(
        f"""SELECT channel_name, tier, {N} AS n FROM fact_transactions
        LEFT JOIN dim_channel USING (channel_id) LEFT JOIN dim_city USING (city_id) GROUP BY 1, 2"""))

    def homes(st):
        # Payments made in the customer's home state: fact -> customer -> city.
        per_customer = successful(st[FACT]).groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("gmv"))
        home = lookup(per_customer, st["dim_customer"], "customer_id", "city_id")
        return lookup(home, st["dim_city"], "city_id", "state", "tier").groupBy("state", "tier").agg(
            F.sum("n").alias("txns"), money(F.sum("gmv")).alias("gmv"))

    add("jn_03_snowflake_hop", homes, sql(
        f"""SELECT c.state, c.tier, {N} AS txns, {smoney(GMV)} AS gmv FROM s
        JOIN dim_customer d ON s.customer_id = d.customer_id JOIN dim_city c ON d.city_id = c.city_id
        GROUP BY 1, 2"""))

    def semi(st):
        # The fact comes down to one row per customer and device before anything is joined.
        cells = st[FACT].groupBy("customer_id", "device_os").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"))
        total = F.sum("n").over(Window.partitionBy("customer_id"))
        return cells.withColumn("total", total).filter("total >= 40 and ok > 0").groupBy("device_os").agg(
            F.sum("ok").alias("txns"), F.count(F.lit(1)).alias("customers"))

    add("jn_07_semi_join", semi, sql(
        f"""SELECT device_os, {N} AS txns, {USERS} AS customers FROM s WHERE customer_id IN (
        SELECT customer_id FROM fact_transactions GROUP BY 1 HAVING count(*) >= 40) GROUP BY 1"""))

    def self_enriched(f):
        # One row per customer and month, so the window never holds a customer's raw payments.
        months = successful(f).groupBy("customer_id", month_start().alias("m")).agg(
            F.count(F.lit(1)).alias("n"))
        first = F.min("m").over(Window.partitionBy("customer_id"))
        return months.select("customer_id", "m", "n", months_since("m", first).alias("age"))

    add("jn_12_self_enrich", fact(self_enriched), sql(
        f"""SELECT customer_id, {text("CAST(date_trunc('month', txn_date) AS DATE)")} AS m, {N} AS n,
        datediff('month', any_value(f), any_value(txn_date)) AS age FROM s
        JOIN (SELECT customer_id, min(txn_date) AS f FROM s GROUP BY 1) USING (customer_id)
        GROUP BY 1, 2"""))


def _aggregations():
    def conditional(f):
        paid = F.col("cashback_amt") > 0
        return f.groupBy("city_id").agg(
            F.countDistinct(F.when(paid, F.col("customer_id"))).alias("cashback_users"),
            ratio(F.sum(F.when(paid, F.col("amount"))), F.count_if(paid)).alias("avg_cashback_amount"),
            F.count(F.lit(1)).alias("n"),
        ).filter(F.col("n") > 100)

    add("ag_05_06_07_conditional", fact(conditional), sql(
        f"""SELECT {big('city_id')} AS city_id,
        count(DISTINCT CASE WHEN cashback_amt > 0 THEN customer_id END) AS cashback_users,
        {sratio('sum(amount) FILTER (WHERE cashback_amt > 0)', 'count(*) FILTER (WHERE cashback_amt > 0)')}
          AS avg_cashback_amount, {N} AS n
        FROM fact_transactions GROUP BY city_id HAVING count(*) > 100"""))
    add("ag_14_crosstab", fact(lambda f: stats.crosstab(
        f, "retry_count", "status", ["SUCCESS", "FAILED", "PENDING"])), sql(
        f"""SELECT {big('retry_count')} AS retry_count,
        count(*) FILTER (WHERE status='SUCCESS') AS "SUCCESS",
        count(*) FILTER (WHERE status='FAILED') AS "FAILED",
        count(*) FILTER (WHERE status='PENDING') AS "PENDING" FROM fact_transactions GROUP BY 1"""))

    def above_average(f):
        users = successful(f).groupBy("customer_id").agg(F.sum("amount").alias("gmv"))
        mean = users.agg((dbl(F.sum("gmv")) / F.count(F.lit(1))).alias("mean"))
        return users.crossJoin(F.broadcast(mean)).agg(  # one row
            F.count_if(dbl("gmv") > F.col("mean")).alias("above"), F.count(F.lit(1)).alias("users"))

    add("ag_16_scalar_subquery", fact(above_average), sql(
        f"""SELECT count(*) FILTER (WHERE {sdbl('gmv')} > (SELECT {sdbl('sum(gmv)')}/count(*) FROM u))
        AS above, {N} AS users FROM u""", u=U))
    add("ag_17_distinct_keys", fact(lambda f: successful(f).select(
        "customer_id", month_key().alias("month")).distinct()), sql(
        f"SELECT customer_id, {MONTH} AS month FROM s GROUP BY 1, 2"))
    listed = " UNION ALL ".join(
        f"SELECT '{x}' AS churn_risk, {i} AS o" for i, x in enumerate(churn.labels("E")))
    add("ag_18_value_counts_reindexed", fact(lambda f: churn.funnel(
        f, scheme="E", reindex=True).select("churn_risk", "customer_count")), sql(
        f"""SELECT l.churn_risk, count(lab.customer_id) AS customer_count FROM ({listed}) l
        LEFT JOIN lab USING (churn_risk) GROUP BY 1""", **_labelled("E")))
    bins = 50

    def histogram(source: str, x: str) -> str:
        w = f"((SELECT max({x}) - min({x}) FROM {source})/{bins})"
        lo = f"(SELECT min({x}) FROM {source})"
        return sql(f"""SELECT b AS bin, round({lo} + b*{w},4) AS bin_low,
            round({lo} + (b + 1)*{w},4) AS bin_high, coalesce(n,0) AS count FROM range({bins}) r(b)
            LEFT JOIN (SELECT {big(f'least(floor(({x} - {lo})/{w}),{bins - 1})')} AS b, {N} AS n
            FROM {source} GROUP BY 1) USING (b)""", u=U)

    add("ag_19_amount_histogram", fact(lambda f: stats.histogram(successful(f), "amount", bins)),
        histogram("s", sdbl("amount")))
    add("ag_19_value_histogram", fact(lambda f: stats.histogram(clv.per_customer(f), "net", bins)),
        histogram("u", sdbl("net")))
    five = ", ".join(f"round(quantile_cont({sdbl('amount')},{p}),4) AS {k}_amount"
                     for k, p in stats.FIVE.items())
    add("ag_20_box_by_channel", lambda st: stats.box_stats(lookup(
        amount_at_most(successful(st[FACT]), CAP), st["dim_channel"], "channel_id", "channel_name"),
        "amount", "channel_name"), sql(
        f"SELECT channel_name, {five} FROM s {JOIN_CH} WHERE amount <= {CAP} GROUP BY 1"))


def _windows_and_sets():
    def lagged(f):
        months = successful(f).groupBy(month_start().alias("m")).agg(F.sum("amount").alias("gmv"))
        before = F.lag("gmv").over(Window.orderBy("m"))  # one row per month
        return months.select(
            month_key("m").alias("month"), money(before).alias("prev_gmv"),
            rnd(dbl("gmv") / dbl(before) - 1, 6).alias("pct_change"))

    add("wn_04_06_lag_pct_change", fact(lagged), sql(
        f"""SELECT month, {smoney('lag(g) OVER (ORDER BY month)')} AS prev_gmv,
        round({sdbl('g')}/{sdbl('lag(g) OVER (ORDER BY month)')} - 1,6) AS pct_change FROM m""",
        m=f"SELECT {MONTH} AS month, {GMV} AS g FROM s GROUP BY 1"))

    def labelled_union(f):
        s = successful(f)

        def part(name, test):
            return s.filter(test).agg(
                F.count(F.lit(1)).alias("n"), F.sum("amount").alias("g"),
                F.sum(net_revenue()).alias("r")).select(
                F.lit(name).alias("grp"), "n", money("g").alias("gmv"), pct("r", "g", 4).alias("margin_pct"))

        paid = F.col("cashback_amt") > 0
        return part("cashback", paid).unionByName(part("none", ~paid))

    add("st_01_union_of_aggregates", fact(labelled_union), sql(" UNION ALL ".join(
        f"""SELECT '{g}' AS grp, {N} AS n, {smoney(GMV)} AS gmv, {spct(SNET, GMV, 4)} AS margin_pct
        FROM s WHERE cashback_amt {op} 0""" for g, op in (("cashback", ">"), ("none", "<=")))))

    def both_groups(f):
        # One row per customer after the map-side combine; no join of raw payments.
        return successful(f).groupBy("customer_id").agg(
            F.max(F.col("cashback_amt") > 0).alias("_with"), F.max(F.col("cashback_amt") == 0).alias("_without")
        ).filter("_with and _without").select("customer_id")

    add("st_02_customers_in_both_groups", fact(both_groups), sql(
        """SELECT customer_id FROM s WHERE cashback_amt > 0 INTERSECT
        SELECT customer_id FROM s WHERE cashback_amt = 0"""))
    order = {"Churned": 1, "High Churn Risk": 2, "Medium Churn Risk": 3, "Active": 4}

    def ranked_labels(f):
        rank = F.coalesce(*[F.when(F.col("churn_risk") == k, v) for k, v in order.items()])
        return churn.funnel(f, scheme="A-summary").select(
            "churn_risk", "customer_count", rank.alias("position")).orderBy("position")

    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in order.items())
    add("so_02_custom_label_order", fact(ranked_labels), sql(
        f"""SELECT churn_risk, {N} AS customer_count, {big(f'CASE churn_risk {arms} END')} AS position
        FROM lab GROUP BY 1""", **_labelled("A-summary")))


def register():
    _projections()
    _joins()
    _aggregations()
    _windows_and_sets()
