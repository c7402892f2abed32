"""What-if scenarios, statistics, dashboard measures and extracts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from paytally.functions.expr import successful
from paytally.operators import measures, stats, whatif
from paytally.plans import catalog_customers as customers
from paytally.plans import export
from paytally.plans.catalog import add
from paytally.plans.catalog_platform import FACT, fact, with_dims
from paytally.plans.sqltext import (
    GMV, JOIN_CH, JOIN_CI, MIDX, MONTH, N, OK, SCB, SCOST, SFEE, SMDR, SNET, USERS, big, dbl, growth,
    money, pct, ratio, share, sql, text,
)

BASE = f"""SELECT CAST({GMV} AS DECIMAL(24,2)) AS gmv, CAST({SMDR} AS DECIMAL(26,8)) AS mdr,
    CAST({SCB} AS DECIMAL(24,5)) AS cb, CAST({SFEE} AS DECIMAL(24,3)) AS fee,
    CAST({SNET} AS DECIMAL(26,8)) AS net FROM s"""
B = {"gmv": dbl("gmv"), "mdr": dbl("mdr"), "cb": dbl("cb"), "fee": dbl("fee"), "net": dbl("net")}


def _list(name: str, items) -> str:
    return f"(VALUES {', '.join(f'({i})' for i in items)}) t({name})"


def _whatif():
    add("wi_12_base", fact(whatif.base_report), sql(
        f"""SELECT {money('gmv')} AS gmv, {money('mdr')} AS mdr_income, {money('cb')} AS cashback,
        {money('fee')} AS cost, {money('net')} AS net_revenue, {pct('net', 'gmv', 4)} AS margin_pct,
        {pct('mdr', 'gmv', 4)} AS avg_mdr_rate_pct FROM b""", b=BASE))
    # Each scenario is summed row by row here, independently of the one-pass rewrite.
    sets = {"wi_01_mdr": whatif.MDR_STEPS, "wi_01_cashback": whatif.CASHBACK_STEPS,
            "wi_01_fee": whatif.FEE_STEPS, "wi_01_pack": whatif.PACK, "wi_01_full": whatif.FULL,
            "ms_07_sliders": [("MDR +0.25, cashback -15%", "0.25", "0.85", "1")]}
    for key, rows in sets.items():
        parts = []
        for name, m, c, p in rows:
            mdr = f"sum((mdr_pct + {m})*amount*0.01)"
            cash, fee = f"sum(cashback_amt*{c})", f"sum(processing_fee_amt*{p})"
            net = f"({mdr} - {cash} - {fee})"
            parts.append(
                f"""SELECT '{name}' AS scenario, {money(GMV)} AS gmv, {money(mdr)} AS mdr_income,
                {money(cash)} AS cashback_cost, {money(fee)} AS processing_cost,
                {money(net)} AS net_revenue, {pct(net, GMV, 4)} AS margin_pct,
                {money(f'{net} - {SNET}')} AS revenue_uplift FROM s""")
        add(key, lambda st, r=rows: whatif.scenarios(
            st[FACT], whatif.scenario_frame(st[FACT].sparkSession, r)), sql(" UNION ALL ".join(parts)))
    add("wi_02_mdr_step", fact(whatif.mdr_step), sql(
        f"""SELECT {money('gmv')} AS gmv, {money('net')} AS current_net_revenue,
        {money('net + gmv*0.005')} AS projected_revenue, {money('gmv*0.005')} AS incremental_revenue,
        {pct('net', 'gmv', 4)} AS current_margin_pct,
        {pct('net + gmv*0.005', 'gmv', 4)} AS new_margin_pct FROM b""", b=BASE))
    new = "(mdr - cb*(1 - CAST(r AS DECIMAL(5,2))*0.01) - fee)"
    add("wi_03_cashback_ladder", fact(whatif.cashback_ladder), sql(
        f"""SELECT {big('r')} AS reduction_pct, {money('gmv')} AS gmv, {money('cb')} AS current_cashback,
        {money('cb*(1 - CAST(r AS DECIMAL(5,2))*0.01)')} AS new_cashback,
        {money('net')} AS current_net_revenue, {money(new)} AS new_net_revenue,
        {pct(new, 'gmv', 4)} AS new_margin_pct, {money(f'{new} - net')} AS revenue_uplift
        FROM b, {_list('r', (0, 10, 20, 30, 40, 50))}""", b=BASE))
    users = f"({dbl('mau')}*(1.0::DOUBLE + {dbl('g')}/100))"
    revenue = f"({users}*({dbl('net')}/NULLIF({dbl('mau')},0)))"
    add("wi_04_user_growth", fact(whatif.user_growth), sql(
        f"""SELECT {big('g')} AS growth_pct, mau AS current_mau, round({users},0) AS projected_mau,
        {money('net')} AS current_revenue, round({revenue},2) AS projected_revenue,
        round({revenue} - {dbl('net')},2) AS incremental_revenue
        FROM (SELECT {USERS} AS mau, {SNET} AS net FROM s
          WHERE date_trunc('month', txn_date) = (SELECT date_trunc('month', max(txn_date)) FROM s)),
        {_list('g', (0, 10, 20, 30, 50))}"""))
    both = "(mdr + gmv*0.005 - cb*0.80 - fee)"
    add("wi_05_combined", fact(whatif.combined), sql(
        f"""SELECT {money('gmv')} AS gmv, {money('net')} AS current_net_revenue,
        {pct('net', 'gmv', 4)} AS current_margin_pct, {money(both)} AS scenario_net_revenue,
        {pct(both, 'gmv', 4)} AS scenario_margin_pct, {money(f'{both} - net')} AS revenue_uplift
        FROM b""", b=BASE))
    m = f"""SELECT channel_name, {dbl(GMV)} AS gmv, {dbl(SNET)} AS net, {dbl(N)} AS n,
        {dbl(SFEE)}/{N} AS fee, {dbl(SCB)}/{N} AS cb, {dbl('sum(mdr_pct)')}/{N} AS mdr
        FROM s {JOIN_CH} GROUP BY 1"""
    part = "0.1::DOUBLE"
    g = f"(u.gmv + c.gmv*{part})"
    asis = f"c.net*(1 - {part}) + {g}*(u.mdr/100) - {g}*u.cb/u.gmv - {g}*u.fee/u.gmv"
    load = f"(u.n + c.n*{part})"
    fixed = f"c.net*(1 - {part}) + ({g}*u.mdr/100 - ({load}*u.cb + {load}*u.fee))"
    for key, formula, per_txn in (("wi_06_channel_shift", asis, False),
                                  ("wi_06_channel_shift_per_txn", fixed, True)):
        add(key, lambda st, p=per_txn: whatif.channel_shift(st[FACT], st["dim_channel"], per_txn=p), sql(
            f"""SELECT 'Current State' AS scenario, round(c.gmv,2) AS source_gmv,
            round(u.gmv,2) AS target_gmv, round(c.net + u.net,2) AS combined_net_revenue
            FROM m c, m u WHERE c.channel_name='CARD' AND u.channel_name='UPI' UNION ALL
            SELECT '10% CARD -> UPI Shift', round(c.gmv*(1 - {part}),2), round({g},2), round({formula},2)
            FROM m c, m u WHERE c.channel_name='CARD' AND u.channel_name='UPI'""", m=m))
    monthly = f"{dbl('sum(lifetime_value)')}/12"
    add("wi_07_churn_prevention", fact(whatif.churn_prevention), sql(
        f"""SELECT {N} AS high_risk_count, round({dbl('sum(total_gmv)')}/12,2) AS at_risk_monthly_gmv,
        round({monthly},2) AS at_risk_monthly_revenue,
        round({monthly}*0.2,2) AS recoverable_revenue_20pct,
        round({monthly}*0.3,2) AS recoverable_revenue_30pct
        FROM act WHERE days_inactive > 60 AND txn_last_90d < 2""",
        act=customers._activity_sql(None, "success")))
    ng = f"({B['gmv']}*(1 + (-0.003::DOUBLE)*c))"
    nn = (f"(({B['mdr']}/{B['gmv']})*{ng} + {ng}*(m/100) - {B['cb']}*(1 - {dbl('c')}/100)"
          f" - ({B['fee']}/{B['gmv']})*{ng})")
    grid = f"""SELECT {big('c')} AS cashback_reduction_pct, m AS mdr_increase_pct,
        round({ng},2) AS projected_gmv, round({nn},2) AS projected_net_revenue,
        round({nn}/{ng}*100,4) AS projected_margin_pct, round({nn} - {B['net']},2) AS revenue_uplift
        FROM b, {_list('c', range(0, 55, 5))},
        (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) u(m)"""
    add("wi_08_elasticity_grid", fact(whatif.elasticity_grid), sql(grid, b=BASE))
    extra = f"({B['gmv']}*(i*0.1::DOUBLE/100))"
    ladder = f"""SELECT round(i*0.1::DOUBLE,1) AS mdr_increase_pct,
        round({B['net']} + {extra},4) AS new_net_revenue,
        round(({B['net']} + {extra})/{B['gmv']}*100,6) AS new_margin_pct, round({extra},4) AS uplift
        FROM b, {_list('i', range(11))}"""
    add("wi_09_mdr_ladder", fact(whatif.mdr_ladder), sql(ladder, b=BASE))
    for dist in ("uniform", "normal"):
        mean = whatif.ELASTICITY[dist]["mean"]
        spread = 0.003 * 0.3 * 0.9 if dist == "uniform" else 0.0001 * 1.959963984540054

        def net(e):
            return (f"(({B['mdr']} - {B['fee']})*(1 + ({e!r}::DOUBLE)*{dbl('r')})"
                    f" - {B['cb']}*(1 - {dbl('r')}/100))")

        tip = f"(-{B['cb']}/100/({B['mdr']} - {B['fee']}))"
        if dist == "uniform":
            above = f"least(greatest(({mean + 0.0009!r}::DOUBLE - {tip})/0.0018,0),1)"
        else:
            z = f"(({tip} - {mean!r})/0.0001)"
            above = f"(CASE WHEN {z} < 0 THEN 1 - {_upper(f'(-{z})')} ELSE {_upper(z)} END)"
        g = f"({B['gmv']}*(1 + ({mean!r}::DOUBLE)*{dbl('r')}))"
        table = f"""SELECT {big('r')} AS reduction_pct, round({g},2) AS proj_gmv,
            round({net(mean)},2) AS proj_net_revenue,
            round({net(mean)}/{g}*100,4) AS new_margin_pct,
            round({net(mean)} - {B['net']},2) AS revenue_uplift,
            round(least({net(mean - spread)},{net(mean + spread)}),2) AS ci_lower,
            round(greatest({net(mean - spread)},{net(mean + spread)}),2) AS ci_upper,
            round(CASE WHEN r = 0 THEN 0 ELSE {above} END,6) AS p_better_than_base
            FROM b, {_list('r', range(0, 55, 5))}"""
        add(f"wi_10_sensitivity_{dist}", fact(lambda f, d=dist: whatif.sensitivity(f, dist=d)),
            sql(table, b=BASE))
        add(f"so_05_best_cut_{dist}",
            fact(lambda f, d=dist: whatif.best_cut(whatif.sensitivity(f, dist=d))), sql(
            """SELECT max_by(reduction_pct, proj_net_revenue) AS best_reduction_pct,
            max(proj_net_revenue) AS proj_net_revenue,
            max_by(revenue_uplift, proj_net_revenue) AS revenue_uplift FROM w""", b=BASE, w=table))
    v = "(CASE WHEN d > 0 THEN -0.5::DOUBLE*d ELSE 0.3::DOUBLE*abs(d) END)"
    sc = f"(1 + {v}/100)"
    nr = f"(({B['mdr']}/{B['gmv']} + d/100)*{B['gmv']}*{sc} - {B['cb']} - {B['fee']}*{sc})"
    add("wi_10_mdr_sensitivity", fact(whatif.mdr_sensitivity), sql(
        f"""SELECT d AS mdr_delta, round({v},4) AS volume_change_pct, round({nr},2) AS mean_net_revenue,
        round(({nr} - {B['net']})/{B['net']}*100,4) AS change_pct
        FROM b, (VALUES (-0.5::DOUBLE), (-0.25), (0.0), (0.25), (0.5)) t(d)""", b=BASE))


# --- resampling --------------------------------------------------------------------------------

UNITS = 1024


def _unit():
    """A resampling unit both engines can compute."""
    return F.pmod(F.col("transaction_id") * 31 + F.col("merchant_id") * 7, F.lit(UNITS))


UNIT_SQL = f"((transaction_id*31 + merchant_id*7) % {UNITS})"


def _draw(*parts: str) -> str:
    key = "||':'||".join(parts)
    return f"('0x'||substr(md5({key}),1,8))::BIGINT"


def _weights(replicates: int) -> dict[str, str]:
    cdf, term, cuts = 0.0, math.exp(-1), []
    for k in range(12):
        cdf += term
        term /= k + 1
        cuts.append(int(cdf * 2**32))
    weight = " + ".join(f"CAST(u >= {c} AS INT)" for c in cuts)
    return {
        "digests": f"""SELECT unit, block, md5('42:'||unit||':'||block) AS d
            FROM range({UNITS}) a(unit), range({(replicates + 3) // 4}) b(block)""",
        "draws": f"""SELECT unit, block*4 + place + 1 AS replicate,
            ('0x'||substr(d, place*8 + 1, 8))::BIGINT AS u FROM digests, range(4) p(place)
            WHERE block*4 + place < {replicates}""",
        "weights": f"SELECT unit, replicate, {weight} AS w FROM draws",
    }


def _replicates(sums: dict[str, str], by: str = "", source: str = "s") -> dict[str, str]:
    keys = f"{by}, " if by else ""
    units = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {n}" for n, x in sums.items())
    totals = ", ".join(f"sum({n}*w) AS {n}" for n in sums)
    return {
        "units": f"SELECT {keys}{UNIT_SQL} AS unit, count(*) AS n, {units} FROM {source} GROUP BY ALL",
        "reps": f"""SELECT {keys}replicate, sum(n*w) AS n, {totals} FROM units
            JOIN weights USING (unit) WHERE w > 0 GROUP BY ALL""",
    }


def _bands(num: str, den: str, scale: str, source: str, by: str = "", having: str = "") -> str:
    keys = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    den_sum = N if den == "1" else f"sum({den})"
    den_rep = "n" if den == "1" else "den"
    q = f"quantile_cont({dbl('num')}/{dbl(den_rep)}*{scale},"
    return f"""SELECT {keys}n, observed, ci_low, median, ci_high FROM (
        SELECT {keys}{N} AS n, round({dbl(f'sum({num})')}/{dbl(den_sum)}*{scale},4) AS observed
        FROM {source} GROUP BY ALL {having}) o JOIN (
        SELECT {keys}round({q}0.025),4) AS ci_low, round({q}0.5),4) AS median,
        round({q}0.975),4) AS ci_high FROM reps GROUP BY ALL) q {join}"""


def _bootstrap():
    add("sx_01_bootstrap_margin", fact(lambda f: stats.bootstrap_margin(f, **unit_options())), sql(
        _bands("net", "amount", "100", "s"), **_weights(2000),
        **_replicates({"num": "net", "den": "amount"})))
    add("sx_02_bootstrap_mean", fact(lambda f: stats.bootstrap_mean(f, **unit_options())), sql(
        _bands("amount", "1", "1", "s"), **_weights(2000), **_replicates({"num": "amount"})))
    add("sx_03_bootstrap_channels",
        lambda st: stats.bootstrap_channel_margin(st[FACT], st["dim_channel"], **unit_options()), sql(
        _bands("net", "amount", "100", "sc", "channel_name", f"HAVING {N} >= 100"), **_weights(1000),
        sc=f"SELECT * FROM s {JOIN_CH}",
        **_replicates({"num": "net", "den": "amount"}, "channel_name", "sc")))
    sums = {"gmv": "amount", "mdr": "mdr", "cb": "cashback_amt", "fee": "processing_fee_amt"}
    for grid, cells in whatif.GRIDS.items():
        keys = "mdr_delta, cashback_cut_pct, fee_cut_pct"
        rows = ", ".join(f"({float(m)!r}::DOUBLE, {c}::BIGINT, {p}::BIGINT)" for m, c, p in cells)
        mdr = f"({dbl('r.mdr')} + {dbl('r.gmv')}*mdr_delta/100)"
        if grid == "mdr":
            label = "CAST(mdr_delta AS VARCHAR)"
            u = [f"({dbl(_draw(repr(s), 'replicate', label, repr('42')))} + 0.5)/4294967296" for s in "uv"]
            noise = f"(sqrt(-2*ln({u[0]}))*cos(2*pi()*({u[1]})))"
            mdr = f"({mdr} + {noise}*sqrt({dbl('r.squares')})*(0.05::DOUBLE/100))"
        if grid == "cashback":
            mdr = (f"({dbl('r.mdr')}*(1 + (-0.3::DOUBLE*{dbl('cashback_cut_pct')}/100/100)"
                   f"*{dbl('r.gmv')}/{dbl('b.gmv')}))")
        net = (f"({mdr} - {dbl('r.cb')}*(1 - {dbl('cashback_cut_pct')}/100)"
               f" - {dbl('r.fee')}*(1 - {dbl('fee_cut_pct')}/100))")
        more = {"squares": "amount*amount"} if grid == "mdr" else {}
        q = "quantile_cont(x,"
        count = 1000 if grid == "combined" else 5000
        add(f"wi_11_bootstrap_{grid}",
            fact(lambda f, g=grid, n=count: whatif.bootstrap_scenarios(
                f, g, replicates=n, unit=_unit())), sql(
            f"""SELECT {keys}, round({q}0.5),2) AS rev_median, round({q}0.025),2) AS rev_ci_low,
            round({q}0.975),2) AS rev_ci_high,
            round(({q}0.5) - max(base))/max(base)*100,4) AS rev_change_pct FROM (
            SELECT {keys}, {net} AS x, {dbl('b.net')} AS base
            FROM reps r, b, (VALUES {rows}) g({keys})) GROUP BY {keys}""",
            b=BASE, **_weights(count), **_replicates({**sums, **more})))


def unit_options():
    return {"unit": _unit()}


# --- tests -------------------------------------------------------------------------------------

SIMPSON = 6000


def _upper(z: str) -> str:
    """Upper tail of the standard normal by Simpson's rule over 12 deviations."""
    h = 12.0 / SIMPSON
    x = f"({z} + i*{h!r})"
    f = f"exp(-{x}*{x}/2)/sqrt(2*pi())"
    w = f"(CASE WHEN i = 0 OR i = {SIMPSON} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(SELECT sum({w}*{f})*{h!r}/3 FROM range({SIMPSON + 1}) i(i))"


def _student(t: str, df: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over 60 units."""
    steps = 60000
    h = 60.0 / steps
    x = f"(abs({t}) + i*{h!r})"
    f = f"pow(1 + {x}*{x}/{df}, -({df} + 1)/2)"
    w = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    const = f"exp(lgamma(({df} + 1)/2) - lgamma({df}/2))/sqrt({df}*pi())"
    return f"(2*{const}*(SELECT sum({w}*{f})*{h!r}/3 FROM range({steps + 1}) i(i)))"


def _chi(counts: str) -> str:
    a, b, c, d = (dbl(x) for x in "abcd")
    n = f"({a} + {b} + {c} + {d})"
    gap = f"greatest(abs({a}*{d} - {b}*{c}) - {n}/2, 0)"
    chi = f"({n}*{gap}*{gap}/NULLIF(({a}+{b})*({c}+{d})*({a}+{c})*({b}+{d}),0))"
    return f"""SELECT a, b, c, d, round(x,6) AS chi2, 1::BIGINT AS dof,
        round(CASE WHEN x IS NOT NULL THEN 2*{_upper('sqrt(x)')} END,6) AS p_value
        FROM (SELECT *, {chi} AS x FROM ({counts}))"""


WINDOW = ("1997-01-01", "1997-04-30")
EXPERIMENT = {
    "win": f"""SELECT *, date_trunc('month', txn_date) = (SELECT date_trunc('month', min(txn_date))
        FROM s WHERE txn_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}') AS early
        FROM s WHERE txn_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'""",
    "later": "SELECT DISTINCT customer_id FROM win WHERE NOT early",
    "ga": "SELECT DISTINCT customer_id FROM win WHERE early AND cashback_amt = 0",
    "gb": "SELECT DISTINCT customer_id FROM win WHERE early AND cashback_amt > 0",
}


def _welch_sql(one: str, two: str, source: str) -> str:
    """Moments of two selections of `x` and the test on them."""
    return f"""SELECT na AS n_a, nb AS n_b, round(ma,4) AS mean_a, round(mb,4) AS mean_b,
        round(t,6) AS t, round(df,4) AS df, round({_student('t', 'df')},6) AS p_value FROM (
        SELECT *, (ma - mb)/sqrt(va + vb) AS t,
        (va + vb)*(va + vb)/(va*va/(na - 1) + vb*vb/(nb - 1)) AS df FROM (
        SELECT {one}, {two} FROM {source}))"""


def _moments(c: str, side: str) -> str:
    return f"count({c}) AS n{side}, avg({c}) AS m{side}, var_samp({c})/count({c}) AS v{side}"


def _tests():
    add("sx_04_chi_square", fact(lambda f: stats.chi_square_2x2(
        f, F.col("cashback_amt") > 0, F.col("status") == "SUCCESS")), sql(_chi(
            """SELECT count(*) FILTER (WHERE cashback_amt > 0 AND status='SUCCESS') AS a,
            count(*) FILTER (WHERE cashback_amt > 0 AND status<>'SUCCESS') AS b,
            count(*) FILTER (WHERE cashback_amt <= 0 AND status='SUCCESS') AS c,
            count(*) FILTER (WHERE cashback_amt <= 0 AND status<>'SUCCESS') AS d
            FROM fact_transactions""")))
    add("sx_04_chi_square_repeat", fact(lambda f: stats.chi_square_2x2(
        stats.customers(f), F.col("had_cashback"), F.col("txns") > 1)), sql(_chi(
            """SELECT count(*) FILTER (WHERE h AND n > 1) AS a, count(*) FILTER (WHERE h AND n = 1) AS b,
            count(*) FILTER (WHERE NOT h AND n > 1) AS c, count(*) FILTER (WHERE NOT h AND n = 1) AS d
            FROM (SELECT bool_or(cashback_amt > 0) AS h, count(*) AS n FROM s GROUP BY customer_id)""")))
    add("sx_04_chi_square_experiment", fact(lambda f: stats.repeat_test(f, *WINDOW)), sql(_chi(
        """SELECT (SELECT count(*) FROM ga SEMI JOIN later USING (customer_id)) AS a,
        (SELECT count(*) FROM ga ANTI JOIN later USING (customer_id)) AS b,
        (SELECT count(*) FROM gb SEMI JOIN later USING (customer_id)) AS c,
        (SELECT count(*) FROM gb ANTI JOIN later USING (customer_id)) AS d"""), **EXPERIMENT))
    x = dbl("amount")
    one, two = f"CASE WHEN cashback_amt > 0 THEN {x} END", f"CASE WHEN cashback_amt <= 0 THEN {x} END"
    add("sx_05_welch", fact(lambda f: stats.welch(
        successful(f), F.col("cashback_amt") > 0, F.col("amount"))), sql(
        _welch_sql(_moments(one, "a"), _moments(two, "b"), "s")))
    add("sx_05_welch_experiment", fact(lambda f: stats.amount_test(f, *WINDOW)), sql(
        _welch_sql("a.*", "b.*", f"""
        (SELECT {_moments(x, 'a')} FROM win SEMI JOIN gb USING (customer_id)) a,
        (SELECT {_moments(x, 'b')} FROM win SEMI JOIN ga USING (customer_id)) b"""), **EXPERIMENT))
    add("sx_06_mann_whitney", fact(lambda f: stats.mann_whitney(
        successful(f), F.col("cashback_amt") > 0, F.col("amount"))), sql(
        f"""SELECT {big('na')} AS n_a, {big('nb')} AS n_b, round(u,1) AS u, round(z,6) AS z,
        round(least(2*{_upper('z')},1),6) AS p_value FROM (
        SELECT *, (greatest(u, na*nb - u) - na*nb/2 - 0.5)
          /sqrt(na*nb/12*(na + nb + 1 - ties/((na + nb)*(na + nb - 1)))) AS z FROM (
        SELECT na, nb, ra - na*(na + 1)/2 AS u, ties FROM (
        SELECT {dbl('count(*) FILTER (WHERE g)')} AS na, {dbl('count(*) FILTER (WHERE NOT g)')} AS nb,
        sum(CASE WHEN g THEN r + (k - 1)/2::DOUBLE ELSE 0 END) AS ra,
        sum({dbl('k')}*{dbl('k')} - 1) AS ties FROM (
        SELECT cashback_amt > 0 AS g, rank() OVER (ORDER BY amount) AS r,
        count(*) OVER (PARTITION BY amount) AS k FROM s))))"""))
    add("sx_07_cohens_d", fact(lambda f: stats.cohens_d(
        successful(f), F.col("cashback_amt") > 0, F.col("amount"))), sql(
        f"""SELECT round(ma,4) AS mean_a, round(mb,4) AS mean_b, round(d,6) AS cohens_d,
        CASE WHEN abs(d) > 0.8 THEN 'Large' WHEN abs(d) > 0.5 THEN 'Medium' ELSE 'Small' END AS effect
        FROM (SELECT avg({one}) AS ma, avg({two}) AS mb,
        (avg({one}) - avg({two}))/sqrt((var_samp({one}) + var_samp({two}))/2) AS d FROM s)"""))
    flags = "SELECT customer_id, count(*) AS n, bool_or(cashback_amt > 0) AS h FROM s GROUP BY 1"
    again = "count(CASE WHEN n > 1 THEN 1 END)"
    add("sx_08_repeat_by_cashback", fact(stats.repeat_by_cashback), sql(
        f"""SELECT {text('h')} AS had_cashback, {N} AS customers, {again} AS repeaters,
        {pct(again, N)} AS repeat_rate_pct FROM f GROUP BY h""", f=flags))

    def group(name, g):
        return f"""SELECT '{name}' AS grp, count(*) AS customers, count(l.customer_id) AS repeaters,
            {pct('count(l.customer_id)', 'count(*)')} AS repeat_rate_pct
            FROM {g} LEFT JOIN later l USING (customer_id)"""

    add("sx_09_repeat_experiment", fact(lambda f: stats.repeat_experiment(f, *WINDOW)), sql(
        group("A: no cashback", "ga") + " UNION ALL " + group("B: cashback", "gb"), **EXPERIMENT))
    ab = f"""SELECT customer_id, CASE WHEN {SCB} > 0 THEN 'Cashback' ELSE 'No Cashback' END
        AS group_label, {GMV} AS total_spend, {N} AS txns FROM s GROUP BY 1"""
    add("sx_10_ab_frame", fact(stats.ab_frame), sql(
        f"SELECT customer_id, group_label, {dbl('total_spend')} AS total_spend, txns FROM ab", ab=ab))
    mean = "(SELECT avg(txns) FROM ab WHERE group_label = '{0}')".format
    add("sx_10_ab_summary", fact(stats.ab_summary), sql(
        f"""SELECT group_label, {N} AS customers, {ratio('sum(total_spend)', N)} AS avg_spend,
        {ratio('sum(txns)', N)} AS avg_txns,
        round(({mean('Cashback')} - {mean('No Cashback')})/{mean('No Cashback')}*100,4) AS txn_lift_pct
        FROM ab GROUP BY 1""", ab=ab))
    add("sx_11_describe", fact(stats.describe), sql(
        f"""SELECT {N} AS n, round(avg({x}),2) AS mean, round(quantile_cont({x},0.5),2) AS median,
        round(stddev_samp({x}),4) AS std, round(skewness({x}),6) AS skew,
        round(kurtosis({x}),6) AS kurt, min({x}) AS min, max({x}) AS max FROM s"""))
    add("sx_12_percentiles", fact(stats.percentiles), sql("SELECT " + ", ".join(
        f"round(quantile_cont({x},{p / 100}),2) AS p{p}" for p in stats.PERCENTS) + " FROM s"))
    m = f"(SELECT avg({x}) FROM s)"
    z = f"({x} - {m})"
    add("sx_13_normality", fact(stats.normality), sql(
        f"""SELECT n, round(jb,4) AS jarque_bera, round(exp(-jb/2),6) AS p_value FROM (
        SELECT n, n::DOUBLE/6*(g1*g1 + g2*g2/4) AS jb FROM (
        SELECT {N} AS n, avg(pow({z},3))/pow(avg(pow({z},2)),1.5) AS g1,
        avg(pow({z},4))/pow(avg(pow({z},2)),2) - 3 AS g2 FROM s))"""))


def _measures():
    def zero(e):
        return f"coalesce({e},0)"

    core = f"""{money(GMV)} AS total_gmv, {money(SMDR)} AS gross_mdr_income,
        {money(SCB)} AS total_cashback, {money(SFEE)} AS total_processing_cost,
        {money(SNET)} AS net_revenue, {zero(pct(SNET, GMV, 4))} AS margin_pct,
        {zero(ratio(GMV, N))} AS avg_ticket_size, {N} AS total_transactions,
        {zero(pct(SCB, GMV, 4))} AS cashback_pct_of_gmv,
        {zero(pct(SFEE, GMV, 4))} AS processing_cost_pct_of_gmv,
        {zero(ratio(SNET, SCOST, 4))} AS efficiency_ratio"""
    add("ms_01_base", fact(measures.base), sql(f"SELECT {core} FROM s"))
    add("ms_01_base_by_device", fact(lambda f: measures.base(f, ["device_os"])), sql(
        f"SELECT device_os, {core} FROM s GROUP BY 1"))
    trailing = f"""(SELECT count(DISTINCT customer_id) FROM s x
        WHERE x.txn_date BETWEEN last_day(m.d) - 29 AND last_day(m.d))"""
    add("ms_02_users", fact(measures.users), sql(
        f"""SELECT month, mau_30d, users AS unique_customers, round(dau,4) AS avg_dau,
        {zero('round(dau/users*100,4)')} AS stickiness_pct,
        {zero('round(dau/NULLIF(mau_30d,0)*100,4)')} AS stickiness_30d_pct, n AS total_transactions,
        {ratio('n', 'users', 4)} AS txns_per_user FROM (
        SELECT month, users, n, {dbl('ud')}/days AS dau, {trailing} AS mau_30d FROM m)""",
        m=f"""SELECT {MONTH} AS month, min(txn_date) AS d, {USERS} AS users, {N} AS n,
        count(DISTINCT (customer_id, txn_date)) AS ud, count(DISTINCT txn_date) AS days
        FROM s GROUP BY 1"""))
    add("ms_02_users_overall", fact(measures.users_overall), sql(
        f"""SELECT {big('sum(users)')} AS total_mau, round(avg(users),4) AS average_mau,
        round(avg(round(round({dbl('ud')}/days,10)/users*100,10)),4) AS average_stickiness_pct FROM (
        SELECT {USERS} AS users, count(DISTINCT (customer_id, txn_date)) AS ud,
        count(DISTINCT txn_date) AS days FROM s GROUP BY {MONTH})"""))
    add("ms_03_prev_month", fact(measures.prev_month), sql(
        f"""SELECT {customers.month_text('a.m')} AS month, {money('a.gmv')} AS gmv,
        {money('z.gmv')} AS prev_month_gmv, {growth('a.gmv', 'z.gmv')} AS gmv_mom_pct,
        {money('a.net')} AS net_revenue, {money('z.net')} AS prev_month_revenue,
        {growth('a.net', 'z.net')} AS revenue_mom_pct, a.users AS mau, z.users AS prev_month_mau,
        {growth('a.users', 'z.users')} AS mau_mom_pct FROM m a LEFT JOIN m z ON z.m = a.m - 1""",
        m=f"SELECT {MIDX} AS m, {GMV} AS gmv, {SNET} AS net, {USERS} AS users FROM s GROUP BY 1"))
    over = "OVER (PARTITION BY year(d) ORDER BY d)"
    add("ms_04_ytd", fact(measures.ytd), sql(
        f"""SELECT {text('d')} AS txn_date, {money(f'sum(g) {over}')} AS gmv_ytd,
        {money(f'sum(r) {over}')} AS revenue_ytd
        FROM (SELECT txn_date AS d, {GMV} AS g, {SNET} AS r FROM s GROUP BY 1)"""))
    add("ms_05_channel", with_dims(measures.channel, "dim_channel"), sql(
        f"""SELECT channel_name, {money(SNET)} AS channel_net_revenue,
        {money(SCOST)} AS channel_total_cost, {zero(ratio(SNET, SCOST, 4))} AS efficiency_ratio,
        {zero(share(GMV))} AS gmv_share_pct FROM s LEFT JOIN dim_channel USING (channel_id)
        GROUP BY channel_name"""))
    have = "count(CASE WHEN cashback_amt > 0 THEN 1 END)"
    add("ms_06_cashback", fact(measures.cashback), sql(
        f"""SELECT {zero(ratio(GMV, SCB))} AS gmv_per_cashback_rupee,
        {zero(pct(SCB, GMV, 4))} AS cashback_rate_pct, {have} AS cashback_transactions,
        {zero(pct(have, N))} AS cashback_coverage_pct FROM s"""))
    add("ms_08_success_rate", fact(measures.success_rate), sql(
        f"SELECT {zero(pct(OK, N))} AS success_rate_pct FROM fact_transactions"))
    add("ms_08_success_rate_by_city", fact(lambda f: measures.success_rate(f, ["city_id"])), sql(
        f"""SELECT {big('city_id')} AS city_id, {zero(pct(OK, N))} AS success_rate_pct
        FROM fact_transactions GROUP BY city_id"""))
    add("ms_09_latest_mom", fact(measures.latest_mom), sql(
        f"""SELECT max(month) AS month, max_by(mom, month) AS latest_revenue_mom_pct FROM (
        SELECT month, {growth('net', 'lag(net) OVER (ORDER BY month)')} AS mom FROM m)
        WHERE mom IS NOT NULL""", m=f"SELECT {MONTH} AS month, {SNET} AS net FROM s GROUP BY 1"))


def _extracts():
    """Extracts not already covered by an operator of the same definition."""
    def extract(name):
        return export.EXTRACTS[name]

    from paytally.plans.catalog import _QUERIES as known

    add("exp_01_monthly_kpi", extract("01_monthly_kpi"), known["kpi_15_monthly_kpi"][1])
    perf = f"""SELECT channel_name, {N} AS txn_count, {dbl(GMV)} AS gmv, {dbl(SNET)} AS net_revenue,
        {dbl(SCB)} AS cashback_cost, {dbl(SFEE)} AS processing_cost, {USERS} AS unique_users,
        {pct(SNET, GMV, 10)} AS margin_pct, {dbl(SCOST)} AS total_cost,
        {ratio(SNET, SCOST, 10)} AS efficiency_ratio, {share(GMV, digits=10)} AS gmv_share_pct
        FROM s {JOIN_CH} GROUP BY 1"""
    add("exp_02_channel_performance", extract("02_channel_performance"), sql(perf))
    add("exp_03_channel_trend", extract("03_monthly_channel_trend"), sql(
        f"""SELECT {MONTH} AS txn_month, channel_name, {N} AS txn_count, {dbl(GMV)} AS gmv,
        {dbl(SNET)} AS net_revenue FROM s {JOIN_CH} GROUP BY 1, 2"""))
    add("exp_04_geo", extract("04_geo_gmv"), sql(
        f"""SELECT state, tier, {N} AS txn_count, {dbl(GMV)} AS gmv, {dbl(SNET)} AS net_revenue,
        {USERS} AS unique_users, {share(GMV, digits=10)} AS gmv_share_pct FROM s {JOIN_CI}
        GROUP BY 1, 2"""))
    add("exp_05_stickiness", extract("05_dau_mau_stickiness"), sql(
        f"""SELECT month AS txn_month, round(d,10) AS avg_dau, users AS mau,
        round(round(d,10)/users*100,10) AS stickiness_pct FROM (
        SELECT {MONTH} AS month, {USERS} AS users,
        {dbl('count(DISTINCT (customer_id, txn_date))')}/count(DISTINCT txn_date) AS d
        FROM s GROUP BY 1)"""))
    add("exp_06_cohort", extract("06_cohort_retention"), sql(
        f"""SELECT {customers.month_text('f')} AS cohort_month, k AS months_since_start,
        users AS active_users, size AS cohort_size, {pct('users', 'size', 10)} AS retention_pct
        FROM cells WHERE k <= 11""", **customers.COHORT))
    add("exp_07_rfm", extract("07_rfm_segments"), sql(
        f"""SELECT customer_id, {text('last_txn_date')} AS last_txn_date, frequency,
        {dbl('monetary')} AS monetary, {dbl('net_revenue')} AS net_revenue, recency_days,
        {big('r_score')} AS r_score, {big('f_score')} AS f_score, {big('m_score')} AS m_score,
        {big('r_score + f_score + m_score')} AS rfm_total, segment AS rfm_segment, segment_tag
        FROM seg LEFT JOIN dim_customer USING (customer_id)""", **customers._segment_ctes("qcut5")))
    add("exp_08_clv", extract("08_clv_table"), known["cl_06_tiers_shifted"][1])
    add("exp_09_churn", extract("09_churn_risk"), sql(
        f"SELECT {customers.ACT}, churn_risk FROM lab", **customers._labelled("D")))
    cat = f"""SELECT category, {N} AS txn_count, {dbl(GMV)} AS gmv, {dbl(SNET)} AS net_revenue,
        {dbl(SCB)} AS cashback, {USERS} AS unique_users, {pct(SNET, GMV, 10)} AS margin_pct,
        {share(GMV, digits=10)} AS gmv_share FROM s
        JOIN (SELECT merchant_id, category FROM dim_merchant) USING (merchant_id) GROUP BY 1"""
    add("exp_10_category", extract("10_merchant_category"), sql(cat))
    add("exp_11_cashback", extract("11_cashback_roi"), sql(
        f"""SELECT {MONTH} AS txn_month, {dbl(GMV)} AS gmv, {dbl(SCB)} AS cashback_cost,
        {dbl(SNET)} AS net_revenue, {ratio(GMV, SCB, 10)} AS gmv_per_cashback,
        {pct(SCB, GMV, 10)} AS cashback_as_pct_gmv FROM s GROUP BY 1"""))
    add("exp_12_whatif", extract("12_whatif_scenarios"), known["wi_08_elasticity_grid"][1])
    funnel = known["cr_03_funnel_d"][1]
    add("snk_02_churn_risk_funnel", extract("churn_risk_funnel"),
        f"SELECT churn_risk, customer_count, avg_days_inactive, at_risk_gmv, sort_order FROM ({funnel})")
    add("snk_03_cashback_scenarios", extract("cashback_scenario_results"),
        known["wi_10_sensitivity_uniform"][1])
    add("snk_03_mdr_scenarios", extract("mdr_scenario_results"), known["wi_09_mdr_ladder"][1])

    def pack(name):
        return export.PACK[name]

    lag = "lag({0}) OVER (ORDER BY month)".format
    add("snk_04_pack_monthly_kpis", pack("monthly_kpis"), sql(
        f"""SELECT month, {money('gmv')} AS gmv, {money('net')} AS net_revenue, mau, txn_count,
        {money('cb')} AS cashback_spent, {money(lag('gmv'))} AS prev_gmv,
        {growth('gmv', lag('gmv'))} AS gmv_mom_pct, {growth('net', lag('net'))} AS rev_mom_pct,
        {growth('mau', lag('mau'))} AS mau_mom_pct FROM m""",
        m=f"""SELECT {MONTH} AS month, {GMV} AS gmv, {SNET} AS net, {USERS} AS mau, {N} AS txn_count,
        {SCB} AS cb FROM s GROUP BY 1"""))
    same = {"gmv_summary": "kpi_01_gmv_summary", "revenue_summary": "kpi_03_revenue_summary",
            "channel_efficiency": "ch_05_efficiency", "geo_gmv": "geo_08_state_tier",
            "rfm_segments": "rf_05_summary_kth4", "whatif_scenarios": "wi_01_pack",
            "churn_risk": "cr_03_funnel_b"}
    for name, key in same.items():
        add(f"snk_04_pack_{name}", pack(name), known[key][1])


def register():
    _whatif()
    _bootstrap()
    _tests()
    _measures()
    _extracts()
