"""Behaviour, cohorts, RFM, lifetime value and churn."""

from __future__ import annotations

from paytally.operators import behavior, churn, clv, cohort, rfm
from paytally.plans.catalog import add
from paytally.plans.catalog_platform import FACT, fact, with_dims
from paytally.plans.sqltext import (
    GMV, MIDX, MONTH, N, SNET, USERS, big, dbl, money, pct, ratio, share, sql, text,
)

REF = "2001-12-31"


def month_text(m: str) -> str:
    return f"strftime(make_date({m}//12, {m}%12+1, 1),'%Y-%m')"


def case(rules: list[tuple[str, list[str]]], default: str) -> str:
    """CASE text from (label, conditions) pairs; first match wins."""
    arms = " ".join(f"WHEN {' AND '.join(tests) or 'true'} THEN '{label}'" for label, tests in rules)
    return f"CASE {arms} ELSE '{default}' END"


def ranges(columns: tuple[str, ...], bounds) -> list[str]:
    tests = []
    for column, (low, high) in zip(columns, bounds):
        tests += [f"{column} >= {low}"] if low is not None else []
        tests += [f"{column} <= {high}"] if high is not None else []
    return tests


def _behavior():
    dau = f"SELECT txn_date, {USERS} AS dau FROM s GROUP BY 1"
    shown = f"SELECT {text('txn_date')} AS txn_date, dau FROM d"
    add("ub_01_dau", fact(behavior.dau), sql(shown, d=dau))
    add("ub_01_dau_last_days", fact(lambda f: behavior.dau(f, last_days=30)), sql(
        shown + """ WHERE txn_date >= (SELECT max(txn_date) - INTERVAL 30 DAY
        FROM fact_transactions)""", d=dau))
    add("ub_01_dau_limit", fact(lambda f: behavior.dau(f, limit=60)), sql(
        shown + " ORDER BY d.txn_date DESC LIMIT 60", d=dau))
    add("ub_02_avg_dau", fact(behavior.avg_dau), sql(
        f"SELECT {MONTH} AS month, {ratio('sum(dau)', N, 0)} AS avg_dau FROM d GROUP BY 1", d=dau))
    add("ub_03_stickiness", fact(behavior.stickiness), sql(
        f"""SELECT month, mau, avg_dau, {pct('avg_dau', 'mau')} AS stickiness_pct
        FROM (SELECT {MONTH} AS month, {ratio('sum(dau)', N)} AS avg_dau FROM d GROUP BY 1)
        JOIN (SELECT {MONTH} AS month, {USERS} AS mau FROM s GROUP BY 1) USING (month)""", d=dau))
    monthly = f"""SELECT customer_id, {MIDX} AS m, f, count(*) AS n FROM s
        JOIN (SELECT customer_id, min({MIDX}) AS f FROM s GROUP BY 1) USING (customer_id)
        GROUP BY ALL"""
    new, old = ("count(CASE WHEN m = f THEN 1 END)", "count(CASE WHEN m <> f THEN 1 END)")
    add("ub_04_new_returning_users", fact(behavior.new_returning), sql(
        f"""SELECT {month_text('m')} AS month, {N} AS total_active, {new} AS new_users,
        {old} AS returning_users, {pct(old, N)} AS returning_pct FROM um GROUP BY m""", um=monthly))
    add("ub_05_new_returning_txns", fact(lambda f: behavior.new_returning(f, "txns")), sql(
        f"""SELECT {month_text('m')} AS month, {N} AS total_active,
        {big('sum(CASE WHEN m = f THEN n ELSE 0 END)')} AS new_txns,
        {big('sum(CASE WHEN m <> f THEN n ELSE 0 END)')} AS returning_txns
        FROM um GROUP BY m""", um=monthly))
    buckets = case(
        [(label, [f"n <= {edge}"]) for edge, label in behavior.FREQUENCY[:-1]],
        behavior.FREQUENCY[-1][1])
    add("ub_06_frequency_buckets", fact(behavior.frequency_buckets), sql(
        f"""SELECT {buckets} AS frequency_bucket, {N} AS user_count, {share(N)} AS pct
        FROM (SELECT count(*) AS n FROM s GROUP BY customer_id) GROUP BY 1"""))
    add("ub_07_deciles", fact(behavior.deciles), sql(
        f"""SELECT decile, {N} AS user_count, {money('sum(x)')} AS total_gmv,
        {ratio('sum(x)', N)} AS avg_gmv_per_user, {share('sum(x)')} AS gmv_share_pct
        FROM (SELECT x, ntile(10) OVER (ORDER BY x DESC, customer_id) AS decile
        FROM (SELECT customer_id, {GMV} AS x FROM s GROUP BY 1)) GROUP BY 1"""))
    add("ub_08_hourly", fact(behavior.hourly), sql(
        f"""SELECT hour(txn_ts) AS hour_of_day, {N} AS txn_count, {money(GMV)} AS gmv,
        {USERS} AS unique_users FROM s GROUP BY 1"""))
    cells = ", ".join(f"count(CASE WHEN month(txn_date) = {m} THEN 1 END) AS m{m}" for m in range(1, 13))
    add("ub_09_hour_month_matrix", fact(behavior.hour_month_matrix), sql(
        f"SELECT hour(txn_ts) AS hour, {cells} FROM s GROUP BY 1"))
    add("wn_16_trailing_30_day_users", fact(behavior.trailing_users), sql(
        f"""SELECT {text('CAST(d AS DATE)')} AS date, count(DISTINCT customer_id) AS users
        FROM (SELECT unnest(generate_series(min(txn_date), last_day(max(txn_date)),
          INTERVAL 1 DAY)) AS d FROM s)
        LEFT JOIN (SELECT DISTINCT customer_id, txn_date FROM s) x
        ON x.txn_date BETWEEN d - INTERVAL 29 DAY AND d GROUP BY d"""))


FIRST = f"SELECT customer_id, min(txn_date) AS first_date, min({MIDX}) AS f FROM s GROUP BY 1"
ACTIVE = f"""SELECT DISTINCT customer_id, f, {MIDX} AS m, {MIDX} - f AS k
    FROM s JOIN first USING (customer_id)"""
CELLS = """SELECT f, k, count(DISTINCT customer_id) AS users, size FROM active
    JOIN (SELECT f, count(*) AS size FROM first GROUP BY 1) USING (f) GROUP BY ALL"""
COHORT = {"first": FIRST, "active": ACTIVE, "cells": CELLS}


def _cohorts():
    at = month_text("f")
    add("co_01_assign", fact(cohort.assign), sql(
        f"""SELECT customer_id, {at} AS cohort_month, {text('first_date')} AS first_txn_date
        FROM first""", **COHORT))
    add("co_02_activity", fact(cohort.activity), sql(
        f"""SELECT customer_id, {at} AS cohort_month, {month_text('m')} AS activity_month,
        k AS months_since_cohort FROM active""", **COHORT))
    add("co_03_sizes", fact(cohort.sizes), sql(
        f"SELECT {at} AS cohort_month, {N} AS cohort_size FROM first GROUP BY f", **COHORT))
    table = f"""SELECT {at} AS cohort_month, size AS cohort_size, k AS months_since_cohort,
        users AS retained_users, {pct('users', 'size')} AS retention_pct FROM cells WHERE k """
    add("co_04_retention", fact(cohort.retention), sql(table + "BETWEEN 0 AND 11", **COHORT))
    add("co_04_retention_listed",
        fact(lambda f: cohort.retention(f, months=[0, 1, 2, 3, 6, 11])),
        sql(table + "IN (0,1,2,3,6,11)", **COHORT))

    def milestone(name, k, fill):
        p = pct(f"max(CASE WHEN k = {k} THEN users END)", "size")
        return f"{p if fill is None else f'coalesce({p},{fill})'} AS {name}_retention_pct"

    early = {"month0": 0, "month1": 1, "month3": 3, "month6": 6}
    for key, spec, fill in (("co_05_milestones", cohort.MILESTONES, None),
                            ("co_06_milestones_month0", early, 0)):
        columns = ", ".join(milestone(n, k, fill) for n, k in spec.items())
        add(key, fact(lambda f, sp=spec, fi=fill: cohort.milestones(f, sp, fi)), sql(
            f"SELECT {at} AS cohort_month, size AS cohort_size, {columns} FROM cells GROUP BY f, size",
            **COHORT))
    add("co_07_average", fact(cohort.average), sql(
        f"""SELECT k AS months_since_cohort, round(avg({dbl('users')}/{dbl('size')}*100),2)
          AS avg_retention_pct, {big('sum(users)')} AS total_retained,
        {big('sum(size)')} AS total_cohort_size FROM cells WHERE k BETWEEN 0 AND 11 GROUP BY k""",
        **COHORT))
    add("co_08_revenue", fact(cohort.revenue), sql(
        f"""SELECT {at} AS cohort_month, {money(SNET)} AS cohort_lifetime_revenue,
        {USERS} AS cohort_size, {ratio(SNET, USERS, 4)} AS revenue_per_user
        FROM s JOIN first USING (customer_id) GROUP BY f""", **COHORT))
    wide = ", ".join(
        f"coalesce({pct(f'max(CASE WHEN k = {k} THEN users END)', 'size')},0) AS month_{k}"
        for k in range(12))
    add("co_09_matrix", fact(cohort.matrix), sql(
        f"SELECT {at} AS cohort_month, {wide} FROM cells GROUP BY f, size", **COHORT))


def _rfm_base(ref: str | None) -> str:
    day = f"DATE '{ref}'" if ref else "(SELECT max(txn_date) FROM s)"
    return f"""SELECT customer_id, max(txn_date) AS last_txn_date,
        datediff('day', max(txn_date), {day}) AS recency_days, count(*) AS frequency,
        {GMV} AS monetary, {ratio(GMV, N)} AS avg_order_value, min(txn_date) AS first_txn_date,
        count(DISTINCT {MONTH}) AS active_months, {SNET} AS net_revenue FROM s GROUP BY customer_id"""


def _ranked_bin(x: str, k: int) -> str:
    r = f"row_number() OVER (ORDER BY {x}, customer_id)"
    n = "count(*) OVER ()"
    return "1 + " + " + ".join(
        f"CAST({r} > 1 + (({n} - 1)*{t})//{k} AS INT)" for t in range(1, k))


def _kth(x: str, p: str) -> str:
    return f"""(SELECT {x} FROM b ORDER BY {x}
        LIMIT 1 OFFSET (SELECT CAST(floor(count(*)*{p}) AS BIGINT) FROM b))"""


def _quarters(x: str, low_is_good: bool) -> str:
    steps = [("0.25", 4), ("0.50", 3), ("0.75", 2)] if low_is_good else [
        ("0.75", 4), ("0.50", 3), ("0.25", 2)]
    sign = "<=" if low_is_good else ">="
    arms = " ".join(f"WHEN {x} {sign} {_kth(x, p)} THEN {v}" for p, v in steps)
    return f"CASE {arms} ELSE 1 END"


def _tile(x: str, k: int, desc: bool = False) -> str:
    return f"ntile({k}) OVER (ORDER BY {x}{' DESC' if desc else ''}, customer_id)"


def _scores(scheme: str) -> tuple[str, str, str]:
    r, f, m = "recency_days", "frequency", "monetary"
    if scheme == "ntile4":
        return f"5 - {_tile(r, 4)}", _tile(f, 4), _tile(m, 4)
    if scheme == "ntile5":
        return _tile(r, 5, True), _tile(f, 5), _tile(m, 5)
    if scheme == "qcut4":
        return f"5 - ({_ranked_bin(r, 4)})", _ranked_bin(f, 4), _ranked_bin(m, 4)
    if scheme == "qcut5":
        edges = " + ".join(
            f"CAST({r} > (SELECT quantile_cont({dbl(r)},{t / 5}) FROM b) AS INT)" for t in range(1, 5))
        return f"5 - ({edges})", _ranked_bin(f, 5), _ranked_bin(m, 5)
    kth = _quarters(r, True)
    if scheme == "kth4":
        return kth, _quarters(f, False), _quarters(m, False)
    return kth, _tile(f, 4), _tile(m, 4)


def _segment_ctes(scheme: str, ref: str | None = None) -> dict[str, str]:
    r, f, m = _scores(scheme)
    ctes = {
        "b": _rfm_base(ref),
        "scored": f"SELECT *, {r} AS r_score, {f} AS f_score, {m} AS m_score FROM b",
    }
    if scheme == "mixed4":
        ctes["seg"] = "SELECT * FROM scored"
        return ctes
    rules, default = rfm.SEGMENTS[scheme]
    columns = ("r_score", "f_score", "m_score")
    label = case([(name, ranges(columns, bounds)) for name, *bounds in rules], default)
    ctes["seg"] = f"SELECT *, {label} AS segment FROM scored"
    return ctes


def _segments(scheme: str, ref: str | None = None):
    return lambda st: rfm.segment(rfm.base(st[FACT], ref), scheme)


def _rfm():
    base = f"""SELECT customer_id, {text('last_txn_date')} AS last_txn_date, recency_days, frequency,
        {dbl('monetary')} AS monetary, avg_order_value, {text('first_txn_date')} AS first_txn_date,
        active_months, {dbl('net_revenue')} AS net_revenue FROM b"""
    add("rf_01_base", fact(rfm.base), sql(base, b=_rfm_base(None)))
    add("rf_01_base_fixed_ref", fact(lambda f: rfm.base(f, REF)), sql(base, b=_rfm_base(REF)))
    add("rf_11_preview", fact(lambda f: rfm.preview(rfm.base(f))), sql(
        base + " ORDER BY b.monetary DESC, customer_id LIMIT 20", b=_rfm_base(None)))
    keys = [("rf_02_ntile4", "ntile4", REF), ("rf_02_qcut4", "qcut4", REF),
            ("rf_03_ntile5", "ntile5", None), ("rf_03_qcut5", "qcut5", None),
            ("rf_04_kth4", "kth4", REF), ("rf_10_mixed4", "mixed4", REF)]
    for key, scheme, ref in keys:
        label = "" if scheme == "mixed4" else ", segment"
        add(key, _segments(scheme, ref), sql(
            f"""SELECT customer_id, {text('last_txn_date')} AS last_txn_date, recency_days, frequency,
            {dbl('monetary')} AS monetary, avg_order_value, {dbl('net_revenue')} AS net_revenue,
            {big('r_score')} AS r_score, {big('f_score')} AS f_score, {big('m_score')} AS m_score,
            concat(r_score, f_score, m_score) AS rfm_score,
            {big('r_score + f_score + m_score')} AS rfm_total{label} FROM seg""",
            **_segment_ctes(scheme, ref)))
    for scheme in ("ntile4", "ntile5", "kth4", "qcut4"):
        add(f"rf_05_summary_{scheme}",
            lambda st, sc=scheme: rfm.summary(_segments(sc)(st)), sql(
            f"""SELECT segment, {N} AS customer_count, {share(N)} AS pct_customers,
            {money('sum(monetary)')} AS total_gmv, {ratio('sum(monetary)', N)} AS avg_gmv,
            {share('sum(monetary)')} AS pct_gmv, {ratio('sum(recency_days)', N, 1)} AS avg_recency_days,
            {ratio('sum(frequency)', N, 1)} AS avg_frequency,
            round(avg(avg_order_value),2) AS avg_order_value,
            {money('sum(net_revenue)')} AS total_revenue FROM seg GROUP BY 1""",
            **_segment_ctes(scheme)))
    four = _segments("ntile4")
    ctes = _segment_ctes("ntile4")
    add("rf_06_score_cells", lambda st: rfm.score_cells(four(st)), sql(
        f"""SELECT {big('r_score')} AS r_score, {big('f_score')} AS f_score,
        {big('m_score')} AS m_score, {N} AS customer_count,
        {ratio('sum(monetary)', N)} AS avg_monetary FROM seg GROUP BY r_score, f_score, m_score""",
        **ctes))
    add("rf_07_top_champions", lambda st: rfm.top_segment(four(st)), sql(
        f"""SELECT customer_id, segment, recency_days, frequency, {money('monetary')} AS monetary,
        avg_order_value AS aov FROM seg WHERE segment='Champions'
        ORDER BY seg.monetary DESC, customer_id LIMIT 50""", **ctes))
    add("rf_08_priority", lambda st: rfm.priority(four(st), st["dim_customer"]), sql(
        f"""SELECT customer_id, segment, recency_days, frequency, {money('monetary')} AS lifetime_spend,
        {big('city_id')} AS city_id FROM seg JOIN dim_customer USING (customer_id)
        WHERE segment IN ('Cannot Lose Them','At Risk')
        ORDER BY seg.monetary DESC, customer_id LIMIT 100""", **ctes))
    add("rf_09_snapshot", lambda st: rfm.snapshot(four(st)), sql(
        f"SELECT segment, {N} AS user_count FROM seg GROUP BY 1", **ctes))

    def transition(st):
        cut = st[FACT].filter("txn_date < '2000-01-01'")
        before = rfm.snapshot(rfm.segment(rfm.base(cut), "ntile4"))
        return rfm.compare_snapshots(before, rfm.snapshot(four(st)))

    old = {f"o{k}": v.replace("FROM s ", "FROM s0 ").replace("FROM s)", "FROM s0)")
           .replace("FROM b", "FROM ob").replace("FROM scored", "FROM oscored")
           for k, v in ctes.items()}
    add("rf_09_snapshot_transition", transition, sql(
        f"""SELECT segment, coalesce(a.n,0) AS users_before, coalesce(z.n,0) AS users_after,
        coalesce(z.n,0) - coalesce(a.n,0) AS change
        FROM (SELECT segment, {N} AS n FROM oseg GROUP BY 1) a
        FULL JOIN (SELECT segment, {N} AS n FROM seg GROUP BY 1) z USING (segment)""",
        s0="SELECT * FROM s WHERE txn_date < DATE '2000-01-01'", **old, **ctes))


U = f"""SELECT customer_id, {N} AS n, {GMV} AS gmv, {SNET} AS net, min(txn_date) AS a,
    max(txn_date) AS z FROM s GROUP BY 1"""


def _bucket_sql(scheme: str) -> str:
    closed, edges, last = clv.BUCKETS[scheme]
    return case([(name, [f"net {'<=' if closed else '<'} {e}"]) for e, name in edges], last)


def _value():
    add("cl_01_historical", fact(clv.historical), sql(
        f"""SELECT customer_id, n AS total_txns, {money('gmv')} AS lifetime_gmv,
        {money('net')} AS lifetime_net_revenue, {ratio('gmv', 'n')} AS avg_order_value,
        {text('a')} AS first_txn_date, {text('z')} AS last_txn_date,
        datediff('day', a, z) AS active_days,
        datediff('day', a, (SELECT max(txn_date) FROM s)) AS tenure_days FROM u""", u=U))
    for scheme in clv.BUCKETS:
        add(f"cl_02_buckets_{scheme}", fact(lambda f, sc=scheme: clv.buckets(f, sc)), sql(
            f"""SELECT {_bucket_sql(scheme)} AS clv_bucket, {N} AS customer_count, {share(N)} AS pct,
            {money('sum(net)')} AS total_revenue, {ratio('sum(net)', N, 4)} AS avg_clv
            FROM u GROUP BY 1""", u=U))
    add("cl_03_quintiles", fact(clv.quintiles), sql(
        f"""SELECT quintile, {N} AS users, {money('sum(net)')} AS revenue,
        {share('sum(net)')} AS revenue_pct
        FROM (SELECT net, ntile(5) OVER (ORDER BY net DESC, customer_id) AS quintile FROM u)
        GROUP BY 1""", u=U))
    ranked = """SELECT net, row_number() OVER (ORDER BY net DESC, customer_id) AS r,
        count(*) OVER () AS n, sum(net) OVER () AS total FROM u"""
    tier = case([(name, [f"r <= n*{p}"]) for p, name in clv.TIERS], clv.LAST_TIER)
    add("cl_04_rank_tiers", fact(clv.rank_tiers), sql(
        f"""SELECT {tier} AS customer_tier, {N} AS customer_count, {money('sum(net)')} AS segment_revenue,
        {pct('sum(net)', 'max(total)')} AS pct_of_total_revenue, {ratio('sum(net)', N)} AS avg_clv
        FROM ranked GROUP BY 1""", u=U, ranked=ranked))
    add("cl_05_projected", fact(clv.projected), sql(
        f"""SELECT round(avg(rev),4) AS avg_monthly_rev_per_user,
        round(avg(months),2) AS avg_active_months,
        round(avg(rev)*round(avg(months),12),4) AS projected_clv_avg FROM (
        SELECT {dbl(SNET)}/count(DISTINCT {MONTH}) AS rev, count(DISTINCT {MONTH}) AS months
        FROM s GROUP BY customer_id)"""))
    value = "SELECT *, CAST(round(net,2) AS DOUBLE) AS v FROM u"

    def limit(p, x="v", t="w"):
        return f"(SELECT quantile_cont({x},{p}) FROM {t})"

    def tiers(sign, names, join):
        arms = " ".join(f"WHEN v {sign} {limit(p)} THEN '{n}'" for p, n in zip((.9, .75, .5), names))
        return f"""SELECT customer_id, n AS total_txns, {dbl('gmv')} AS total_gmv,
            v AS lifetime_value, {text('a')} AS first_txn, {text('z')} AS last_txn,
            datediff('day', a, z) AS active_days, CASE {arms} ELSE '{names[3]}' END AS clv_bucket,
            segment_tag FROM w {join} JOIN dim_customer USING (customer_id)"""

    add("cl_06_tiers", with_dims(clv.tiers, "dim_customer"), sql(
        tiers(">=", clv.VALUE_TIERS["sql"], ""), u=U, w=value))
    shifted = sql(tiers(">", clv.VALUE_TIERS["shifted"], "LEFT"), u=U,
                  w=f"SELECT *, {dbl('net')} AS v FROM u")
    add("cl_06_tiers_shifted",
        lambda st: clv.tiers(st[FACT], st["dim_customer"], "shifted"), shifted)
    x = dbl("net")
    add("cl_07_percentiles", fact(clv.percentiles), sql(
        f"""SELECT round(quantile_cont({x},0.25),2) AS p25_ltv,
        round(quantile_cont({x},0.5),2) AS median_ltv, round(quantile_cont({x},0.75),2) AS p75_ltv,
        round(quantile_cont({x},0.9),2) AS p90_ltv, {ratio('sum(net)', N)} AS avg_ltv,
        {money('sum(net)')} AS total_net_revenue FROM u""", u=U))
    add("cl_08_by_segment", with_dims(clv.by_segment, "dim_customer"), sql(
        f"""SELECT segment_tag, {USERS} AS customer_count, {ratio(SNET, N, 4)} AS avg_net_revenue_per_txn,
        {money(GMV)} AS total_gmv, {money(SNET)} AS total_net_revenue,
        {ratio(SNET, USERS)} AS avg_clv_per_customer FROM s
        JOIN (SELECT customer_id, segment_tag FROM dim_customer) USING (customer_id) GROUP BY 1"""))
    add("cl_09_top", with_dims(clv.top, "dim_customer", "dim_city"), sql(
        f"""SELECT customer_id, segment_tag, city_name, tier, n AS total_txns,
        {money('gmv')} AS total_spend, {money('net')} AS lifetime_value,
        {text('a')} AS first_txn_date, {text('z')} AS last_txn_date FROM u
        JOIN dim_customer USING (customer_id) JOIN dim_city USING (city_id)
        ORDER BY net DESC, customer_id LIMIT 100""", u=U))
    add("cl_10_top_share", fact(clv.top_share), sql(
        f"""SELECT {dbl('100*p')} AS top_pct, {N} AS customers, {money('sum(net)')} AS revenue,
        {pct('sum(net)', 'max(total)')} AS revenue_share_pct
        FROM ranked, (VALUES (0.10), (0.20)) t(p) WHERE r <= floor(n*p) GROUP BY p""",
        u=U, ranked=ranked))
    p90 = f"(SELECT quantile_cont({x},0.9) FROM u)"
    top = f"sum(CASE WHEN {x} >= {p90} THEN net END)"
    add("cl_10_share_above", fact(clv.share_above), sql(
        f"""SELECT round({p90},2) AS threshold, count(CASE WHEN {x} >= {p90} THEN 1 END) AS customers,
        {money(top)} AS revenue, {pct(top, 'sum(net)')} AS revenue_share_pct FROM u""", u=U))
    for key, desc in (("cl_11_lorenz", False), ("cl_11_pareto", True)):
        word = "DESC" if desc else "ASC"
        add(key, fact(lambda f, d=desc: clv.lorenz(f, desc=d)), sql(
            f"""SELECT r AS customers, {pct('r', 'n', 4)} AS cumulative_customers_pct,
            {pct('upto', 'total', 4)} AS cumulative_revenue_pct FROM (
            SELECT row_number() OVER (ORDER BY net {word}, customer_id) AS r, count(*) OVER () AS n,
            sum(net) OVER (ORDER BY net {word}, customer_id ROWS UNBOUNDED PRECEDING) AS upto,
            sum(net) OVER () AS total FROM u) WHERE (r*100)//n > ((r-1)*100)//n""", u=U))
    add("cl_12_tenure_fixed_ref",
        fact(lambda f: clv.historical(f, REF).select("customer_id", "tenure_days")), sql(
        f"SELECT customer_id, datediff('day', a, DATE '{REF}') AS tenure_days FROM u", u=U))


def _activity_sql(ref: str | None, counters: str) -> str:
    day = f"DATE '{ref}'" if ref else "(SELECT max(txn_date) FROM s)"
    count_day = "(SELECT max(txn_date) FROM fact_transactions)" if counters == "all" else day

    def within(n):
        return f"count(CASE WHEN txn_date >= {count_day} - INTERVAL {n} DAY THEN 1 END)"

    return f"""SELECT customer_id, max(txn_date) AS last_txn_date, {N} AS total_txns,
        {within(90)} AS txn_last_90d, {within(30)} AS txn_last_30d, {GMV} AS total_gmv,
        {SNET} AS lifetime_value, datediff('day', max(txn_date), {day}) AS days_inactive
        FROM s GROUP BY 1"""


def _labelled(scheme: str, ref: str | None = None, counters: str = "success") -> dict[str, str]:
    rules, default = churn.SCHEMES[scheme]
    columns = ("days_inactive", "txn_last_90d", "txn_last_30d")
    label = case([(name, ranges(columns, bounds)) for name, *bounds in rules], default)
    return {"act": _activity_sql(ref, counters),
            "lab": f"SELECT *, {label} AS churn_risk FROM act"}


ACT = f"""customer_id, {text('last_txn_date')} AS last_txn_date, total_txns, txn_last_90d, txn_last_30d,
    {dbl('total_gmv')} AS total_gmv, {dbl('lifetime_value')} AS lifetime_value, days_inactive"""


def _churn():
    add("cr_01_activity", fact(churn.activity), sql(
        f"SELECT {ACT} FROM act", act=_activity_sql(None, "success")))
    add("cr_01_activity_all_status", fact(lambda f: churn.activity(f, counters="all")), sql(
        f"SELECT {ACT} FROM act", act=_activity_sql(None, "all")))
    for scheme in churn.SCHEMES:
        counters = "all" if scheme == "C" else "success"
        name = scheme.lower().replace("-", "_")
        ctes = _labelled(scheme, None, counters)
        add(f"cr_02_label_{name}",
            fact(lambda f, sc=scheme, c=counters: churn.label(f, scheme=sc, counters=c)),
            sql(f"SELECT {ACT}, churn_risk FROM lab", **ctes))
        order = case([(str(i), [f"churn_risk = '{x}'"]) for i, x in enumerate(churn.labels(scheme))], "9")
        add(f"cr_03_funnel_{name}",
            fact(lambda f, sc=scheme, c=counters: churn.funnel(f, scheme=sc, counters=c)), sql(
            f"""SELECT churn_risk, {big(order)} AS sort_order, {N} AS customer_count, {share(N)} AS pct,
            {ratio('sum(days_inactive)', N)} AS avg_days_inactive,
            {ratio('sum(total_txns)', N)} AS avg_lifetime_txns,
            {money('sum(total_gmv)')} AS at_risk_gmv FROM lab GROUP BY churn_risk""", **ctes))
    risk = f"""SELECT churn_risk, {N} AS users, {money('sum(total_gmv)')} AS historical_gmv_at_risk
        FROM lab WHERE churn_risk IN """
    add("cr_04_gmv_at_risk", fact(churn.gmv_at_risk), sql(
        risk + "('Churned','High Churn Risk') GROUP BY 1", **_labelled("A-risk")))
    add("cr_04_high_risk_measures",
        fact(lambda f: churn.gmv_at_risk(f, scheme="D", risky=["High Risk"])), sql(
        risk + "('High Risk') GROUP BY 1", **_labelled("D")))


def register():
    _behavior()
    _cohorts()
    _rfm()
    _value()
    _churn()
