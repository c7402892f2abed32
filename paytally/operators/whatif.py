"""What-if scenarios. Every scenario is linear in a few base totals, so the fact table is aggregated
once and the scenario rows are computed from that single row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.functions.expr import (
    dbl, lookup, money, month_start, net_revenue, pct, rnd, safe_div, successful, totals,
)
from paytally.functions.tails import erfc
from paytally.operators import churn, stats
from paytally.sources.readers import values

SCENARIO = (
    "position int, scenario string, mdr_shift decimal(6,4), cashback_factor decimal(6,4), "
    "fee_factor decimal(6,4)"
)

# Scenario name, MDR shift in percentage points, cashback factor, fee factor.
MDR_STEPS = [("Current", "0", "1", "1"), ("+0.5% MDR", "0.5", "1", "1"),
             ("+1.0% MDR", "1.0", "1", "1")]
CASHBACK_STEPS = [("Current", "0", "1", "1"), ("-10% Cashback", "0", "0.90", "1"),
                  ("-25% Cashback", "0", "0.75", "1"), ("-50% Cashback", "0", "0.50", "1"),
                  ("Zero Cashback", "0", "0", "1")]
FEE_STEPS = [("Current", "0", "1", "1"), ("-5% Processing Cost", "0", "1", "0.95"),
             ("-10% Processing Cost", "0", "1", "0.90")]
PACK = [("BASE", "0", "1", "1"), ("MDR +0.5%", "0.5", "1", "1"),
        ("Cashback -25%", "0", "0.75", "1"), ("Cashback -50%", "0", "0.50", "1"),
        ("Processing Fee -10%", "0", "1", "0.90"),
        ("Optimized (MDR+0.3, CB-20%, PF-5%)", "0.3", "0.80", "0.95")]
FULL = [("BASE (Current)", "0", "1", "1"), ("Scenario 1: MDR +0.5%", "0.5", "1", "1"),
        ("Scenario 2: MDR -0.5%", "-0.5", "1", "1"),
        ("Scenario 3: Cashback -25%", "0", "0.75", "1"),
        ("Scenario 4: Cashback -50%", "0", "0.50", "1"),
        ("Scenario 5: Processing Fee -10%", "0", "1", "0.90"),
        ("Scenario 6: Optimized (MDR+0.3, CB-20%, PF-5%)", "0.3", "0.80", "0.95")]


def scenario_frame(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    data = [(i, n, Decimal(m), Decimal(c), Decimal(p)) for i, (n, m, c, p) in enumerate(rows)]
    return values(spark, data, SCENARIO)


def base(f: DataFrame) -> DataFrame:
    """One row of totals over SUCCESS payments; decimals."""
    return totals(successful(f)).select(
        "gmv", F.col("mdr").alias("mdr_income"), "cashback", F.col("fee").alias("cost"),
        F.col("net").alias("net_revenue"),
    )


def base_report(f: DataFrame) -> DataFrame:
    return base(f).select(
        *[money(c).alias(c) for c in ("gmv", "mdr_income", "cashback", "cost", "net_revenue")],
        pct("net_revenue", "gmv", 4).alias("margin_pct"),
        pct("mdr_income", "gmv", 4).alias("avg_mdr_rate_pct"),
    )


def _each(f: DataFrame, values: list, name: str, kind: str = "int") -> DataFrame:
    """The base row repeated for each value of a short list."""
    items = F.array(*[F.lit(v).cast(kind) for v in values])
    return base(f).select("*", F.explode(items).alias(name))


def scenarios(f: DataFrame, scenario_df: DataFrame) -> DataFrame:
    """P&L under MDR shifts (percentage points) and scaled cashback and fees."""
    mdr = F.col("mdr_income") + F.col("gmv") * F.col("mdr_shift") * F.lit(Decimal("0.01"))
    cash = F.col("cashback") * F.col("cashback_factor")
    fee = F.col("cost") * F.col("fee_factor")
    rows = base(f).crossJoin(scenario_df).withColumns({"m": mdr, "c": cash, "p": fee})  # one base row
    return rows.withColumn("net", F.col("m") - F.col("c") - F.col("p")).orderBy("position").select(
        "scenario",
        money("gmv").alias("gmv"),
        money("m").alias("mdr_income"),
        money("c").alias("cashback_cost"),
        money("p").alias("processing_cost"),
        money("net").alias("net_revenue"),
        pct("net", "gmv", 4).alias("margin_pct"),
        money(F.col("net") - F.col("net_revenue")).alias("revenue_uplift"),
    )


def mdr_step(f: DataFrame, step: str = "0.5") -> DataFrame:
    """Net revenue with the MDR raised by ``step`` percentage points at constant GMV."""
    extra = F.col("gmv") * F.lit(Decimal(step)) * F.lit(Decimal("0.01"))
    return base(f).withColumn("extra", extra).withColumn(
        "new", F.col("net_revenue") + F.col("extra")
    ).select(
        money("gmv").alias("gmv"),
        money("net_revenue").alias("current_net_revenue"),
        money("new").alias("projected_revenue"),
        money("extra").alias("incremental_revenue"),
        pct("net_revenue", "gmv", 4).alias("current_margin_pct"),
        pct("new", "gmv", 4).alias("new_margin_pct"),
    )


def cashback_ladder(f: DataFrame, cuts: list[int] = (0, 10, 20, 30, 40, 50)) -> DataFrame:
    keep = F.lit(1) - F.col("reduction_pct").cast("decimal(5,2)") * F.lit(Decimal("0.01"))
    rows = _each(f, cuts, "reduction_pct").withColumn("new_cb", F.col("cashback") * keep)
    new = F.col("mdr_income") - F.col("new_cb") - F.col("cost")
    return rows.withColumn("new_net", new).select(
        "reduction_pct",
        money("gmv").alias("gmv"),
        money("cashback").alias("current_cashback"),
        money("new_cb").alias("new_cashback"),
        money("net_revenue").alias("current_net_revenue"),
        money("new_net").alias("new_net_revenue"),
        pct("new_net", "gmv", 4).alias("new_margin_pct"),
        money(F.col("new_net") - F.col("net_revenue")).alias("revenue_uplift"),
    ).orderBy("reduction_pct")


def user_growth(f: DataFrame, growth: list[int] = (0, 10, 20, 30, 50)) -> DataFrame:
    """Revenue of the last month scaled with its users at constant revenue per user."""
    s = successful(f)
    last = s.agg(month_start(F.max("txn_date")).alias("last_m"))
    month = s.crossJoin(F.broadcast(last)).filter(month_start() == F.col("last_m"))  # one row
    row = month.agg(
        F.countDistinct("customer_id").alias("mau"), F.sum(net_revenue()).alias("net")
    )
    steps = F.explode(F.array(*[F.lit(g) for g in growth])).alias("growth_pct")
    users = dbl("mau") * (F.lit(1.0) + dbl("growth_pct") / 100)
    revenue = users * safe_div("net", "mau")
    return row.select("*", steps).select(
        "growth_pct",
        F.col("mau").alias("current_mau"),
        rnd(users, 0).alias("projected_mau"),
        money("net").alias("current_revenue"),
        rnd(revenue, 2).alias("projected_revenue"),
        rnd(revenue - dbl("net"), 2).alias("incremental_revenue"),
    ).orderBy("growth_pct")


def combined(f: DataFrame, mdr_shift: str = "0.5", cashback_cut: str = "0.20") -> DataFrame:
    """MDR up and cashback down at once."""
    new = (
        F.col("mdr_income") + F.col("gmv") * F.lit(Decimal(mdr_shift)) * F.lit(Decimal("0.01"))
        - F.col("cashback") * F.lit(1 - Decimal(cashback_cut)) - F.col("cost")
    )
    return base(f).withColumn("new", new).select(
        money("gmv").alias("gmv"),
        money("net_revenue").alias("current_net_revenue"),
        pct("net_revenue", "gmv", 4).alias("current_margin_pct"),
        money("new").alias("scenario_net_revenue"),
        pct("new", "gmv", 4).alias("scenario_margin_pct"),
        money(F.col("new") - F.col("net_revenue")).alias("revenue_uplift"),
    )


def channel_shift(f: DataFrame, dim_channel: DataFrame, src: str = "CARD", dst: str = "UPI",
                  pct_moved: int = 10, per_txn: bool = False) -> DataFrame:
    """Move a part of one channel's GMV to another.

    By default the average fee and cashback of the target enter once per unit of relative GMV, as in
    the published scenario; ``per_txn`` charges them per moved and existing transaction instead.
    """
    named = lookup(successful(f), dim_channel, "channel_id", "channel_name")
    t = totals(named.filter(F.col("channel_name").isin(src, dst)), "channel_name")

    def of(channel: str, c: str) -> Column:
        return F.max(F.when(F.col("channel_name") == channel, dbl(c)))

    row = t.agg(*[of(ch, c).alias(f"{side}_{c}") for side, ch in (("s", src), ("d", dst))
                  for c in ("gmv", "net", "txn_count", "fee", "cashback", "mdr_pct_sum")])
    part = F.lit(pct_moved / 100)
    gmv = F.col("d_gmv") + F.col("s_gmv") * part
    avg = {c: F.col(f"d_{c}") / F.col("d_txn_count") for c in ("fee", "cashback", "mdr_pct_sum")}
    if per_txn:
        load = F.col("d_txn_count") + F.col("s_txn_count") * part
        cost = load * avg["cashback"] + load * avg["fee"]
        shifted = F.col("s_net") * (1 - part) + (gmv * avg["mdr_pct_sum"] / 100 - cost)
    else:
        shifted = (
            F.col("s_net") * (1 - part) + gmv * (avg["mdr_pct_sum"] / 100)
            - gmv * avg["cashback"] / F.col("d_gmv") - gmv * avg["fee"] / F.col("d_gmv")
        )
    outcome = F.explode(F.array(
        F.struct(F.lit("Current State").alias("scenario"), F.col("s_gmv").alias("source"),
                 F.col("d_gmv").alias("target"), (F.col("s_net") + F.col("d_net")).alias("net")),
        F.struct(F.lit(f"{pct_moved}% {src} -> {dst} Shift").alias("scenario"),
                 (F.col("s_gmv") * (1 - part)).alias("source"), gmv.alias("target"),
                 shifted.alias("net")),
    ))
    return row.select(outcome.alias("o")).select(
        "o.scenario", rnd("o.source", 2).alias("source_gmv"),
        rnd("o.target", 2).alias("target_gmv"),
        rnd("o.net", 2).alias("combined_net_revenue"),
    )


def churn_prevention(f: DataFrame, ref: str | None = None) -> DataFrame:
    """Monthly revenue kept when a fifth or three tenths of high-risk customers stay."""
    risky = churn.activity(f, ref).filter("days_inactive > 60 AND txn_last_90d < 2")
    row = risky.agg(
        F.count(F.lit(1)).alias("high_risk_count"),
        F.sum("total_gmv").alias("gmv"),
        F.sum("lifetime_value").alias("net"),
    )
    monthly = dbl("net") / 12
    return row.select(
        "high_risk_count",
        rnd(dbl("gmv") / 12, 2).alias("at_risk_monthly_gmv"),
        rnd(monthly, 2).alias("at_risk_monthly_revenue"),
        rnd(monthly * 0.2, 2).alias("recoverable_revenue_20pct"),
        rnd(monthly * 0.3, 2).alias("recoverable_revenue_30pct"),
    )


def elasticity_grid(
    f: DataFrame,
    cuts: list[int] = tuple(range(0, 55, 5)),
    mdr_steps: list[float] = (0.0, 0.25, 0.5, 1.0),
    elasticity: float = -0.003,
) -> DataFrame:
    """Cashback cuts by MDR steps; GMV reacts with ``elasticity`` per per cent of cut."""
    steps = F.explode(F.array(*[F.lit(float(m)) for m in mdr_steps])).alias("mdr_increase_pct")
    rows = _each(f, cuts, "cashback_reduction_pct").select("*", steps)
    gmv, mdr, cash, fee, net = (
        dbl(c) for c in ("gmv", "mdr_income", "cashback", "cost", "net_revenue")
    )
    new_gmv = gmv * (1 + F.lit(elasticity) * F.col("cashback_reduction_pct"))
    new_mdr = (mdr / gmv) * new_gmv + new_gmv * (F.col("mdr_increase_pct") / 100)
    new_net = new_mdr - cash * (1 - dbl("cashback_reduction_pct") / 100) - (fee / gmv) * new_gmv
    return rows.select(
        "cashback_reduction_pct",
        "mdr_increase_pct",
        rnd(new_gmv, 2).alias("projected_gmv"),
        rnd(new_net, 2).alias("projected_net_revenue"),
        rnd(new_net / new_gmv * 100, 4).alias("projected_margin_pct"),
        rnd(new_net - net, 2).alias("revenue_uplift"),
    ).orderBy("cashback_reduction_pct", "mdr_increase_pct")


def mdr_ladder(f: DataFrame, steps: int = 10) -> DataFrame:
    """MDR raised in tenths of a percentage point."""
    rows = _each(f, list(range(steps + 1)), "i")
    extra = dbl("gmv") * (F.col("i") * 0.1 / 100)
    new = dbl("net_revenue") + extra
    return rows.select(
        rnd(F.col("i") * 0.1, 1).alias("mdr_increase_pct"),
        rnd(new, 4).alias("new_net_revenue"),
        rnd(new / dbl("gmv") * 100, 6).alias("new_margin_pct"),
        rnd(extra, 4).alias("uplift"),
    ).orderBy("mdr_increase_pct")


# Relative GMV change per per cent of cashback cut, its spread and the quantiles read.
ELASTICITY = {
    # uniform within +-30 % of the mean; 5th and 95th percentile
    "uniform": {"mean": -0.003, "half_width": 0.30, "tail": 0.05},
    # normal; 2.5th and 97.5th percentile
    "normal": {"mean": -0.0003, "sd": 0.0001, "z": 1.959963984540054},
}


def sensitivity(f: DataFrame, cuts: list[int] = tuple(range(0, 55, 5)),
                dist: str = "uniform") -> DataFrame:
    """Net revenue after a cashback cut when the elasticity of GMV is uncertain.

    Revenue is linear in the elasticity, so its mean, band and probability of beating the base
    follow in closed form from the distribution of the elasticity.
    """
    spec = ELASTICITY[dist]
    mean = spec["mean"]
    if dist == "uniform":
        spread = abs(mean) * spec["half_width"] * (1 - 2 * spec["tail"])
    else:
        spread = spec["sd"] * spec["z"]
    cut = dbl("reduction_pct")
    earning = dbl("mdr_income") - dbl("cost")  # scales with GMV
    saved = dbl("cashback") * (1 - cut / 100)

    def net(e: float) -> Column:
        return earning * (1 + F.lit(e) * cut) - saved

    # Beating the base needs earning * e + cashback / 100 > 0.
    tipping = -dbl("cashback") / 100 / F.nullif(earning, F.lit(0.0))
    if dist == "uniform":
        low, width = mean - abs(mean) * spec["half_width"], 2 * abs(mean) * spec["half_width"]
        above = F.least(F.greatest((low + width - tipping) / width, F.lit(0.0)), F.lit(1.0))
    else:
        above = erfc((tipping - mean) / spec["sd"] / F.sqrt(F.lit(2.0))) / 2
    better = F.when(cut == 0, 0.0).when(earning > 0, above).otherwise(1 - above)
    rows = _each(f, cuts, "reduction_pct").select(
        "reduction_pct",
        rnd(dbl("gmv") * (1 + F.lit(mean) * cut), 2).alias("proj_gmv"),
        rnd(net(mean), 2).alias("proj_net_revenue"),
        rnd(net(mean) / (dbl("gmv") * (1 + F.lit(mean) * cut)) * 100, 4).alias("new_margin_pct"),
        rnd(net(mean) - dbl("net_revenue"), 2).alias("revenue_uplift"),
        rnd(F.least(net(mean - spread), net(mean + spread)), 2).alias("ci_lower"),
        rnd(F.greatest(net(mean - spread), net(mean + spread)), 2).alias("ci_upper"),
        rnd(better, 6).alias("p_better_than_base"),
    )
    return rows.orderBy("reduction_pct")


def best_cut(sensitivity_rows: DataFrame) -> DataFrame:
    """The cut with the highest mean net revenue."""
    return sensitivity_rows.agg(
        F.max_by("reduction_pct", "proj_net_revenue").alias("best_reduction_pct"),
        F.max("proj_net_revenue").alias("proj_net_revenue"),
        F.max_by("revenue_uplift", "proj_net_revenue").alias("revenue_uplift"),
    )


# Mean change of volume in per cent per point of MDR raised and lowered.
VOLUME_REACTION = {"up": -0.5, "down": 0.3}


def mdr_sensitivity(f: DataFrame, deltas: list[float] = (-0.5, -0.25, 0.0, 0.25, 0.5)) -> DataFrame:
    """Mean net revenue after an MDR change with a volume reaction."""
    d = F.col("mdr_delta")
    volume = F.when(d > 0, VOLUME_REACTION["up"] * d).otherwise(VOLUME_REACTION["down"] * F.abs(d))
    scale = 1 + volume / 100
    new = (
        (dbl("mdr_income") / dbl("gmv") + d / 100) * dbl("gmv") * scale
        - dbl("cashback") - dbl("cost") * scale
    )
    return _each(f, list(deltas), "mdr_delta", "double").select(
        "mdr_delta",
        rnd(volume, 4).alias("volume_change_pct"),
        rnd(new, 2).alias("mean_net_revenue"),
        rnd((new - dbl("net_revenue")) / F.nullif(dbl("net_revenue"), F.lit(0.0)) * 100, 4).alias(
            "change_pct"
        ),
    ).orderBy("mdr_delta")


# The scenario grids of the resampling study. MDR realisation has a standard deviation
# of 0.05 points per payment; the cashback grid reacts with an elasticity of -0.30 / 100.
MDR_NOISE = 0.05
CASHBACK_ELASTICITY = -0.30
GRIDS = {
    "mdr": [(i * 0.25 - 0.5, 0, 0) for i in range(9)],
    "cashback": [(0.0, c, 0) for c in range(0, 61, 10)],
    "fee": [(0.0, 0, p) for p in range(0, 26, 5)],
    "combined": [(m, c, 0) for m in (0.0, 0.25, 0.5) for c in (0, 10, 25, 50)],
}


def bootstrap_scenarios(f: DataFrame, grid: str = "mdr", replicates: int = 5000,
                        units: int = 1024, unit: Column | None = None, seed: int = 42) -> DataFrame:
    """Median and 95 % band of net revenue per scenario under resampling of payments.

    All scenarios read the same replicate totals; the base totals are a second scan. Independent
    noise on the MDR of every payment adds up to one normal term per replicate with variance
    (0.05 / 100)^2 * sum(amount^2).
    """
    sums = {
        "gmv": F.col("amount"),
        "mdr": F.col("mdr_pct") * F.col("amount") * F.lit(Decimal("0.01")),
        "cashback": F.col("cashback_amt"),
        "fee": F.col("processing_fee_amt"),
    }
    if grid == "mdr":
        sums["squares"] = dbl("amount") * dbl("amount")
    s = successful(f)
    reps = stats.replicate_sums(s, sums, replicates, units, unit=unit, seed=seed)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(m)).alias("mdr_delta"), F.lit(c).alias("cashback_cut_pct"),
                 F.lit(p).alias("fee_cut_pct"))
        for m, c, p in GRIDS[grid]
    ])).alias("g")
    keys = ["mdr_delta", "cashback_cut_pct", "fee_cut_pct"]
    rows = reps.select("*", cells).select("*", *[f"g.{k}" for k in keys])
    mdr = dbl("mdr") + dbl("gmv") * F.col("mdr_delta") / 100
    if grid == "mdr":
        noise = stats.normal_draw("replicate", rnd("mdr_delta", 2).cast("string"), seed)
        mdr = mdr + noise * F.sqrt(F.col("squares")) * (MDR_NOISE / 100)
    if grid == "cashback":
        # The reaction is scaled with the replicate's own GMV, as in the published simulation.
        reaction = CASHBACK_ELASTICITY * dbl("cashback_cut_pct") / 100 / 100
        mdr = dbl("mdr") * (1 + reaction * dbl("gmv") / F.col("base_gmv"))
    net = (
        mdr - dbl("cashback") * (1 - dbl("cashback_cut_pct") / 100)
        - dbl("fee") * (1 - dbl("fee_cut_pct") / 100)
    )
    origin = base(f).select(dbl("gmv").alias("base_gmv"), dbl("net_revenue").alias("base_net"))
    bands = (
        rows.crossJoin(F.broadcast(origin))  # one row
        .select(*keys, "base_net", net.alias("net"))
        .groupBy(*keys)
        .agg(
            F.percentile("net", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"),
            F.max("base_net").alias("base_net"),
        )
    )
    median = F.col("q")[1]
    change = (median - F.col("base_net")) / F.nullif(F.col("base_net"), F.lit(0.0)) * 100
    return bands.select(
        *keys,
        rnd(median, 2).alias("rev_median"),
        rnd(F.col("q")[0], 2).alias("rev_ci_low"),
        rnd(F.col("q")[2], 2).alias("rev_ci_high"),
        rnd(change, 4).alias("rev_change_pct"),
    ).orderBy(*keys)
