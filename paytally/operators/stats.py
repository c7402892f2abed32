"""Bootstrap intervals, group tests and distribution summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.functions.expr import (
    dbl, lookup, month_start, net_revenue, pct, ratio, rnd, safe_div, successful,
)
from paytally.functions.ordered import in_ranges, percentiles as exact_percentiles, running_sums
from paytally.functions.tails import erfc, student_two_sided

ID = "customer_id"


# --- bootstrap ---------------------------------------------------------------------------------


def _digest(*parts: str | Column | int) -> Column:
    """Hex digest of a key, the same on any cluster and partitioning."""
    return F.md5(F.concat_ws(":", *[
        (F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string")
        for p in parts
    ]))


def _number(digest: Column, at: Column | int = 0) -> Column:
    """The 32-bit number at place 0..3 of a digest."""
    start = F.lit(at) * 8 + 1
    return F.conv(F.substring(digest, start, F.lit(8)), 16, 10).cast("long")


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution function at 32-bit resolution."""
    cdf, term, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(12):
        cdf += term
        term /= k + 1
        weight = weight + (u >= int(cdf * 2**32)).cast("int")
    return weight


def normal_draw(*key: str | Column | int) -> Column:
    """Standard normal number from two hashed uniforms (Box-Muller)."""
    u = (dbl(_number(_digest(F.lit("u"), *key))) + 0.5) / 2**32
    v = (dbl(_number(_digest(F.lit("v"), *key))) + 0.5) / 2**32
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def replicate_sums(
    s: DataFrame,
    sums: dict[str, Column],
    replicates: int,
    units: int = 1024,
    by: list[str] = (),
    unit: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Totals of ``sums`` (and ``n``) in each bootstrap replicate: one row per key and replicate.

    Rows are hashed into ``units`` resampling units and added up there, in one scan with map-side
    combine; every replicate then weights the units with Poisson(1) counts. The work after the scan
    is units x replicates, whatever the size of the table. For ratios and means of independent rows
    the interval is that of row-wise resampling up to a relative error of about 1/sqrt(units); pass
    ``unit`` (for example a customer id hash) to resample other units.
    """
    by = list(by)
    key = F.pmod(F.xxhash64(*s.columns), F.lit(units)) if unit is None else unit
    per_unit = s.groupBy(*by, key.alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Units leave the exact decimal domain here; a weighted sum of doubles is enough for a band.
    # One digest serves four replicates.
    block, place = F.col("block"), F.col("place")
    drawn = (
        per_unit.select(*by, "unit", "n", *[dbl(name).alias(name) for name in sums])
        .repartition(parts, *by, "unit")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))).alias("block"))
        .withColumn("digest", _digest(seed, "unit", "block"))
        .select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("place"))
        .withColumns({
            "replicate": block * 4 + place + 1,
            "w": poisson_weight(_number(F.col("digest"), place)),
        })
    )
    if replicates % 4:
        drawn = drawn.filter(F.col("replicate") <= replicates)
    return drawn.groupBy(*by, "replicate").agg(
        F.sum(F.col("n") * F.col("w")).alias("n"),
        *[F.sum(F.col(name) * F.col("w")).alias(name) for name in sums],
    )


def bootstrap_ratio(
    s: DataFrame,
    num: Column,
    den: Column,
    replicates: int = 2000,
    by: list[str] = (),
    min_n: int = 0,
    scale: float = 100.0,
    units: int = 1024,
    unit: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """Observed value, median and 95 % interval of sum(num) / sum(den) * scale."""
    by = list(by)
    reps = replicate_sums(s, {"num": num, "den": den}, replicates, units, by, unit, seed)
    value = safe_div("num", "den") * scale
    bands = reps.select(*by, value.alias("v")).groupBy(*by).agg(
        # one value per replicate
        F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    )
    observed = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (safe_div(F.sum(num), F.sum(den)) * scale).alias("observed")
    ).filter(F.col("n") >= min_n)
    both = observed.join(bands, by) if by else observed.crossJoin(F.broadcast(bands))  # one row
    return both.select(
        *by, "n",
        rnd("observed", 4).alias("observed"),
        rnd(F.col("q")[0], 4).alias("ci_low"),
        rnd(F.col("q")[1], 4).alias("median"),
        rnd(F.col("q")[2], 4).alias("ci_high"),
    )


def bootstrap_margin(f: DataFrame, **options) -> DataFrame:
    return bootstrap_ratio(successful(f), net_revenue(), F.col("amount"), **options)


def bootstrap_mean(f: DataFrame, column: str = "amount", **options) -> DataFrame:
    return bootstrap_ratio(successful(f), F.col(column), F.lit(1), scale=1.0, **options)


def bootstrap_channel_margin(f: DataFrame, dim_channel: DataFrame, replicates: int = 1000,
                             min_n: int = 100, **options) -> DataFrame:
    named = lookup(successful(f), dim_channel, "channel_id", "channel_name")
    return bootstrap_ratio(
        named, net_revenue(), F.col("amount"), replicates, ["channel_name"], min_n, **options
    )


# --- group tests -------------------------------------------------------------------------------


def chi_square(counts: DataFrame) -> DataFrame:
    """Yates-corrected chi-square of a 2x2 table given as one row a, b, c, d."""
    a, b, c, d = (dbl(x) for x in "abcd")
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = n * gap * gap / F.nullif(margins, F.lit(0.0))
    return counts.withColumn("_x", chi2).select(
        "a", "b", "c", "d",
        rnd("_x", 6).alias("chi2"),
        F.lit(1).alias("dof"),
        rnd(erfc(F.sqrt(F.col("_x") / 2)), 6).alias("p_value"),
    )


def chi_square_2x2(df: DataFrame, group: Column, outcome: Column) -> DataFrame:
    """Test of two boolean columns; a, b = outcome yes/no in the group, c, d outside."""
    flags = df.select(group.alias("g"), outcome.alias("o"))
    g, o = F.col("g"), F.col("o")
    return chi_square(flags.agg(
        F.count_if(g & o).alias("a"), F.count_if(g & ~o).alias("b"),
        F.count_if(~g & o).alias("c"), F.count_if(~g & ~o).alias("d"),
    ))


def _moments(df: DataFrame, group: Column, x: Column) -> DataFrame:
    flags = df.select(group.alias("g"), dbl(x).alias("x"))
    one, two = F.when(F.col("g"), F.col("x")), F.when(~F.col("g"), F.col("x"))
    return flags.agg(*[
        fn(c).alias(f"{name}_{side}")
        for side, c in (("a", one), ("b", two))
        for name, fn in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
    ])


def _welch(moments: DataFrame) -> DataFrame:
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.nullif(va + vb, F.lit(0.0)))
    df = (va + vb) * (va + vb) / F.nullif(
        va * va / F.nullif(dbl("n_a") - 1, F.lit(0.0))
        + vb * vb / F.nullif(dbl("n_b") - 1, F.lit(0.0)), F.lit(0.0)
    )
    return moments.withColumns({"_t": t, "_df": df}).select(
        "n_a", "n_b",
        rnd("mean_a", 4).alias("mean_a"), rnd("mean_b", 4).alias("mean_b"),
        rnd("_t", 6).alias("t"), rnd("_df", 4).alias("df"),
        rnd(student_two_sided("_t", "_df"), 6).alias("p_value"),
    )


def welch(df: DataFrame, group: Column, x: Column) -> DataFrame:
    """Welch's t-test of ``x`` inside against outside the group."""
    return _welch(_moments(df, group, x))


def cohens_d(df: DataFrame, group: Column, x: Column) -> DataFrame:
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    d = (F.col("mean_a") - F.col("mean_b")) / F.nullif(pooled, F.lit(0.0))
    size = F.abs(F.col("cohens_d"))
    return _moments(df, group, x).select(
        rnd("mean_a", 4).alias("mean_a"), rnd("mean_b", 4).alias("mean_b"),
        rnd(d, 6).alias("cohens_d"),
    ).withColumn(
        "effect", F.when(size > 0.8, "Large").when(size > 0.5, "Medium").otherwise("Small")
    )


def mann_whitney(df: DataFrame, group: Column, x: Column) -> DataFrame:
    """Two-sided Mann-Whitney U with tie and continuity correction (normal approximation).

    Values are counted per group first, so ties cost one row; U then needs, per distinct value, the
    number of outside rows below it, which comes from a range-partitioned running total.
    """
    counts = df.select(group.alias("g"), x.alias("x")).filter(F.col("x").isNotNull()).groupBy("x").agg(
        F.count_if(F.col("g")).alias("na"), F.count_if(~F.col("g")).alias("nb")
    )
    parts = in_ranges(counts, "x")
    ranked = running_sums(parts, ["x"], b="nb")
    below = dbl(F.col("b_upto") - F.col("nb")) + dbl("nb") / 2
    ties = dbl(F.col("na") + F.col("nb"))
    row = ranked.agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"),
        F.sum(dbl("na") * below).alias("u"),
        F.sum(ties * ties * ties - ties).alias("ties"),
    )
    na, nb = dbl("n_a"), dbl("n_b")
    n = na + nb
    var = na * nb / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    top = F.greatest(F.col("u"), na * nb - F.col("u"))
    z = (top - na * nb / 2 - 0.5) / F.sqrt(F.nullif(var, F.lit(0.0)))
    return row.withColumn("_z", z).select(
        "n_a", "n_b",
        rnd("u", 1).alias("u"),
        rnd("_z", 6).alias("z"),
        rnd(F.least(erfc(F.col("_z") / F.sqrt(F.lit(2.0))), F.lit(1.0)), 6).alias("p_value"),
    )


# --- cashback experiments ----------------------------------------------------------------------


def customers(f: DataFrame) -> DataFrame:
    return successful(f).groupBy(ID).agg(
        F.count(F.lit(1)).alias("txns"),
        F.sum("amount").alias("total_spend"),
        F.sum("cashback_amt").alias("total_cashback"),
        F.max(F.col("cashback_amt") > 0).alias("had_cashback"),
    )


def repeat_by_cashback(f: DataFrame) -> DataFrame:
    """Share of customers with at least two payments, with and without cashback."""
    return customers(f).groupBy("had_cashback").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("txns") > 1).alias("repeaters")
    ).select(
        "had_cashback", "customers", "repeaters",
        pct("repeaters", "customers").alias("repeat_rate_pct"),
    )


def crosstab(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    """Counts of ``rows`` by the listed values of ``column``, 0 where a pair is missing."""
    counts = df.groupBy(rows, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(rows).pivot(column, values).agg(F.sum("n")).na.fill(0)


def _experiment(f: DataFrame, start: str, end: str) -> DataFrame:
    """Per customer of the window: group membership by cashback in its first month, later activity
    and amount moments. A customer with both kinds of payments is in both groups."""
    window = successful(f).filter(F.col("txn_date").between(start, end))
    first = window.agg(month_start(F.min("txn_date")).alias("first_m"))
    early = month_start() == F.col("first_m")
    return window.crossJoin(F.broadcast(first)).groupBy(ID).agg(  # one row
        F.max(early & (F.col("cashback_amt") > 0)).alias("in_b"),
        F.max(early & (F.col("cashback_amt") == 0)).alias("in_a"),
        F.max(~early).alias("later"),
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("x"),
        F.sum(F.col("amount") * F.col("amount")).alias("xx"),
    )


def repeat_experiment(f: DataFrame, start: str, end: str) -> DataFrame:
    """Repeat rate of customers without (A) and with cashback (B) in the first month."""
    c = _experiment(f, start, end)
    row = c.agg(*[
        F.count_if(test).alias(name)
        for g in "ab"
        for name, test in ((f"n_{g}", F.col(f"in_{g}")), (f"r_{g}", F.col(f"in_{g}") & F.col("later")))
    ])
    groups = F.expr(
        "stack(2, 'A: no cashback', n_a, r_a, 'B: cashback', n_b, r_b) AS (grp, customers, repeaters)"
    )
    return row.select(groups).select(
        "grp", "customers", "repeaters", pct("repeaters", "customers").alias("repeat_rate_pct")
    )


def repeat_test(f: DataFrame, start: str, end: str) -> DataFrame:
    """Chi-square of group A against B of the repeat experiment."""
    a, b, later = F.col("in_a"), F.col("in_b"), F.col("later")
    return chi_square(_experiment(f, start, end).agg(
        F.count_if(a & later).alias("a"), F.count_if(a & ~later).alias("b"),
        F.count_if(b & later).alias("c"), F.count_if(b & ~later).alias("d"),
    ))


def amount_test(f: DataFrame, start: str, end: str) -> DataFrame:
    """Welch test of payment amounts, cashback group (a) against the other (b)."""
    c = _experiment(f, start, end)
    sums = c.agg(*[
        F.sum(F.when(F.col(f"in_{g}"), F.col(v)).otherwise(0)).alias(f"{v}_{side}")
        for side, g in (("a", "b"), ("b", "a"))
        for v in ("n", "x", "xx")
    ])

    def moment(side):
        n, x, xx = dbl(f"n_{side}"), dbl(f"x_{side}"), dbl(f"xx_{side}")
        safe = F.nullif(n, F.lit(0.0))
        return {
            f"mean_{side}": x / safe,
            f"var_{side}": (xx - x * x / safe) / F.nullif(n - 1, F.lit(0.0)),
        }

    return _welch(sums.withColumns({**moment("a"), **moment("b")}))


def ab_frame(f: DataFrame) -> DataFrame:
    label = F.when(F.col("total_cashback") > 0, "Cashback").otherwise("No Cashback")
    return customers(f).select(ID, label.alias("group_label"), "total_spend", "txns")


def ab_summary(f: DataFrame) -> DataFrame:
    """Size, mean spend and mean payments per group, and the lift of the cashback group."""
    groups = ab_frame(f).groupBy("group_label").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_spend").alias("spend"),
        F.sum("txns").alias("txns"),
    )

    def mean_of(label, c):
        hit = F.when(F.col("group_label") == label, safe_div(c, "customers"))
        return F.max(hit)

    lift = groups.agg(
        ((mean_of("Cashback", "txns") - mean_of("No Cashback", "txns"))
         / F.nullif(mean_of("No Cashback", "txns"), F.lit(0.0)) * 100).alias("lift")
    )
    return groups.crossJoin(F.broadcast(lift)).select(  # one row
        "group_label", "customers",
        ratio("spend", "customers").alias("avg_spend"),
        ratio("txns", "customers").alias("avg_txns"),
        rnd("lift", 4).alias("txn_lift_pct"),
    )


# --- distributions -----------------------------------------------------------------------------


def describe(f: DataFrame, column: str = "amount") -> DataFrame:
    """Mean, median, sample deviation, bias-adjusted skewness and excess kurtosis, range."""
    s = successful(f).select(dbl(column).alias("x"))
    row = s.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )
    n = dbl("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    kurt = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6)
    median = exact_percentiles(successful(f), column, {"median": 0.5})
    return row.crossJoin(F.broadcast(median)).select(  # one row each
        "n", rnd("mean", 2).alias("mean"), rnd("median", 2).alias("median"),
        rnd("std", 4).alias("std"), rnd(skew, 6).alias("skew"),
        rnd(kurt, 6).alias("kurt"), F.col("lo").alias("min"), F.col("hi").alias("max"),
    )


PERCENTS = (10, 25, 50, 75, 90, 95, 99)


def percentiles(f: DataFrame, column: str = "amount", percents: list[int] = PERCENTS) -> DataFrame:
    row = exact_percentiles(successful(f), column, {f"p{p}": p / 100 for p in percents})
    return row.select(*[rnd(c, 2).alias(c) for c in row.columns])


def normality(f: DataFrame, column: str = "amount") -> DataFrame:
    """Jarque-Bera test over all rows; its statistic is chi-square with two degrees of freedom."""
    row = successful(f).select(dbl(column).alias("x")).agg(
        F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")
    )
    jb = dbl("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    return row.withColumn("jb", jb).select(
        "n", rnd("jb", 4).alias("jarque_bera"), rnd(F.exp(-F.col("jb") / 2), 6).alias("p_value")
    )


def anderson_darling(f: DataFrame, column: str = "amount") -> DataFrame:
    """Anderson-Darling statistic of all rows against the normal with their mean and deviation.

    The statistic needs every row's rank. Rows are counted by value, the values range-partitioned and
    their ranks taken from running totals, so ties are one row and no task holds all values. The adjusted
    statistic and its 5 % limit are those for an estimated mean and deviation. Fewer than two rows, or
    equal ones, have no statistic.
    """
    rows = successful(f).select(dbl(column).alias("x")).filter(F.col("x").isNotNull())
    parts = in_ranges(rows.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "x")
    mean = parts.agg(F.sum("w").alias("n"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"))
    gap = F.col("x") - F.col("mean")
    sample = parts.crossJoin(F.broadcast(mean)).groupBy("n", "mean").agg(  # one row
        F.sqrt(F.sum(gap * gap * F.col("w")) / F.nullif(F.max("n") - 1, F.lit(0))).alias("sd"))
    ranked = running_sums(parts, ["x"], r="w").crossJoin(F.broadcast(sample))  # one row
    z = gap / F.nullif(F.col("sd"), F.lit(0.0)) / math.sqrt(2)
    n, upto, before = dbl("n"), dbl("r_upto"), dbl(F.col("r_upto") - F.col("w"))

    def log(tail: Column) -> Column:
        return F.when(tail.isNotNull(), F.ln(F.greatest(tail / 2, F.lit(1e-300))))

    weighed = (upto * upto - before * before) * log(erfc(-z)) + (
        (n - before) * (n - before) - (n - upto) * (n - upto)) * log(erfc(z))
    row = ranked.select("n", weighed.alias("s")).agg(F.max("n").alias("n"), F.sum("s").alias("s"))
    a2 = -n - F.col("s") / n
    adjusted = F.col("a2") * (1 + 0.75 / n + 2.25 / (n * n))
    return row.withColumn("a2", a2).select(
        F.coalesce("n", F.lit(0)).alias("n"), rnd("a2", 4).alias("anderson_darling"),
        rnd(adjusted, 4).alias("adjusted"), (adjusted > AD_LIMIT).alias("rejected"))


#: Fixed value: 5 % limit of the adjusted statistic, mean and deviation estimated.
AD_LIMIT = 0.752


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the range of the column; the last bin is closed. Empty bins are kept."""
    x = df.select(dbl(column).alias("x")).filter(F.col("x").isNotNull())
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    step = F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0)))
    at = F.when(width == 0, 0).otherwise(F.least(step, F.lit(bins - 1)))
    counts = x.crossJoin(F.broadcast(span)).groupBy(  # one row
        at.alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    frame = span.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        rnd(F.col("lo") + F.col("bin") * F.col("w"), 4).alias("bin_low"),
        rnd(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 4).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    ).orderBy("bin")


FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Five-number summary per group."""
    rows = exact_percentiles(df, column, {f"{k}_{column}": p for k, p in FIVE.items()}, by=[by])
    return rows.select(by, *[rnd(c, 4).alias(c) for c in rows.columns if c != by])


def clip_at(df: DataFrame, column: str, p: float) -> DataFrame:
    """Cap a column (as double) at its percentile; no row is lost."""
    limit = exact_percentiles(df, column, {"_limit": p})
    capped = F.least(dbl(column), F.col("_limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(column, capped).drop("_limit")  # one row


def trim_above(df: DataFrame, column: str, p: float) -> DataFrame:
    """Rows strictly below a percentile of the column."""
    limit = exact_percentiles(df, column, {"_limit": p})
    return df.crossJoin(F.broadcast(limit)).filter(dbl(column) < F.col("_limit")).drop("_limit")
