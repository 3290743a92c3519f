"""Outlier sensitivity, normality and equal-variance checks on the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlift.functions import tails
from armlift.functions.guards import VARIANCE_EPSILON, add, sanitize_p
from armlift.functions.normal import polynomial, quantile, upper_tail
from armlift.operators.order_stats import at_label, histogram, ranked_rows, value_ranges
from armlift.session import attach, stage

# Fixed values.
WINSOR = 0.05
TRIM = 0.10
SENSITIVE = 0.25
DAGOSTINO_MIN_N = 8
SHAPIRO_MAX_N = 5000


def side_by_side(long: DataFrame, columns: list[str]) -> DataFrame:
    """(segment, arm) rows to one row per segment with _t and _c columns."""
    cells = [F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for c in columns for a in "tc"]
    return long.groupBy("segment").agg(*cells)


def robust_sums(
    rows: DataFrame, winsor: float = WINSOR, trim: float = TRIM, hist: DataFrame | None = None,
) -> DataFrame:
    """Per (segment, arm): median, winsorized and trimmed mean, spread about the median.

    The rows are read for the histogram (unless the caller shares a staged one) and
    inside the few ranges that hold a cut or the median. All clipped sums come from
    the ranges, as none has a cut within. Serves the outlier and the variance check.
    """
    winsor, trim = (min(max(f, 0.0), 0.49) for f in (winsor, trim))
    keys = ["segment", "arm"]
    hist = histogram(rows, keys, "y") if hist is None else hist
    labels = {
        "w_lo": lambda n: F.floor(n * F.lit(winsor)) + 1, "w_hi": lambda n: n - F.floor(n * F.lit(winsor)),
        "t_lo": lambda n: F.floor(n * F.lit(trim)) + 1, "t_hi": lambda n: n - F.floor(n * F.lit(trim)),
        "m_lo": lambda n: F.floor((n + 1) / 2), "m_hi": lambda n: F.floor(n / 2) + 1}
    # a group's ranges are bounded by its buckets: windows over them stay small
    whole = Window.partitionBy(*keys)
    cells = value_ranges(rows, keys, "y", labels, hist)
    cells = add(cells.withColumns({x: at_label(x).over(whole) for x in labels}), median="(m_lo + m_hi) / 2")
    cells = add(cells, w="least(greatest(_mean, w_lo), w_hi)", t="least(greatest(_mean, t_lo), t_hi)", z="abs(_mean - median)")
    cells = cells.withColumn("centre", F.sum(F.expr("_cnt * z")).over(whole) / F.col("n"))
    sums = cells.groupBy(*keys).agg(
        F.max("n").alias("k"), F.max("median").alias("median"), F.max("t_lo").alias("t_lo"),
        F.max("t_hi").alias("t_hi"), F.expr("sum(_cnt * w) / max(n)").alias("winsor_mean"), F.expr("sum(_cnt * t)").alias("t_sum"),
        F.max("centre").alias("zm"),
        F.expr("sum(_m2 + _cnt * (z - centre) * (z - centre)) / nullif(max(n) - 1, 0)").alias("zv"))
    cut = f"floor(k * {trim}D)"
    return stage(add(sums, trim_mean=f"(t_sum - {cut} * (t_lo + t_hi)) / (k - 2 * {cut})"))


def outlier_sensitivity(moments: DataFrame, sums: DataFrame) -> DataFrame:
    """Winsorized and trimmed effects against the raw effect, from ``robust_sums``."""
    wide = side_by_side(sums, ["winsor_mean", "trim_mean"])
    out = moments.select("segment", "mean_t", "mean_c", "var_all").join(wide, "segment")
    out = add(out, raw_effect="mean_t - mean_c", winsorized_effect="winsor_mean_t - winsor_mean_c",
              trimmed_effect="trim_mean_t - trim_mean_c")
    out = add(out, winsorized_delta="winsorized_effect - raw_effect", trimmed_delta="trimmed_effect - raw_effect")
    out = add(out, max_abs_delta="greatest(abs(winsorized_delta), abs(trimmed_delta))")
    flat = f"sqrt(var_all) <= {VARIANCE_EPSILON}D"
    # Without spread any shift is infinitely large against it: null score, sensitive.
    out = add(out, sensitivity_score=f"""CASE WHEN NOT {flat} THEN max_abs_delta / sqrt(var_all)
        WHEN max_abs_delta > 0 THEN NULL ELSE 0D END""")
    out = add(out, is_outlier_sensitive=f"coalesce(sensitivity_score > {SENSITIVE}, true)")
    return out.drop("mean_t", "mean_c", "var_all", "winsor_mean_t", "winsor_mean_c", "trim_mean_t", "trim_mean_c")


def levene_test(moments: DataFrame, sums: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Median-centred equal-variance test from ``robust_sums``: F, degrees of freedom and p."""
    wide = side_by_side(sums, ["k", "zm", "zv"])
    out = moments.select("segment", "n_t", "n_c", "var_t", "var_c").join(wide, "segment", "left")
    out = add(out, variance_reason=f"""CASE WHEN n_t < 3 OR n_c < 3 THEN 'insufficient_sample_size'
        WHEN least(var_t, var_c) <= {VARIANCE_EPSILON}D THEN 'degenerate_variance' END""",
              levene_df="CAST(k_t + k_c - 2 AS DOUBLE)")
    out = add(out, _within="((k_t - 1) * zv_t + (k_c - 1) * zv_c) / nullif(levene_df, 0D)",
              _between="(zm_t - zm_c) * (zm_t - zm_c) * k_t * k_c / (k_t + k_c)")
    out = add(out, levene_f="CASE WHEN variance_reason IS NULL AND _within > 0 THEN _between / _within END")
    p = tails.t_p_value(F.sqrt("levene_f"), F.col("levene_df"))  # F(1, v) is the square of t(v)
    return out.withColumn("levene_p_value", p).select(
        "segment", "levene_f", "levene_df", "levene_p_value", "variance_reason",
        (F.col("levene_p_value") > alpha).alias("equal_variance_passed"))


def dagostino_test(rows: DataFrame) -> DataFrame:
    """D'Agostino-Pearson K² and p per (segment, arm): one aggregation, p = exp(-K²/2)."""
    y = F.col("y")
    d = rows.groupBy("segment", "arm").agg(
        F.count(y).cast("double").alias("n"), F.skewness(y).alias("g1"), F.kurtosis(y).alias("g2"),
        F.var_samp(y).alias("v"))
    d = d.where((F.col("n") >= DAGOSTINO_MIN_N) & (F.col("v") > VARIANCE_EPSILON))
    # Skewness, transformed to normality.
    d = add(d, s="g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))",
            b="3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))")
    d = add(d, w="sqrt(2 * (b - 1)) - 1")
    d = add(d, u="CASE WHEN s = 0 THEN 1D ELSE s END / sqrt(2 / (w - 1))", delta="1 / sqrt(0.5D * ln(w))")
    d = add(d, z1="delta * ln(u + sqrt(u * u + 1))")
    # Kurtosis, transformed to normality.
    d = add(d, x="""(g2 + 3 - 3 * (n - 1) / (n + 1))
            / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))""",
            r="""6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
            * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))""")
    d = add(d, a="6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r)))")
    d = add(d, q="1 + x * sqrt(2 / (a - 4))")
    d = add(d, z2="(1 - 2 / (9 * a) - signum(q) * power((1 - 2 / a) / nullif(abs(q), 0D), 1 / 3D)) / sqrt(2 / (9 * a))")
    d = add(d, statistic="z1 * z1 + z2 * z2")
    return d.select("segment", "arm", F.col("n").cast("bigint").alias("n"), "statistic",
                    sanitize_p(F.exp(-F.col("statistic") / 2)).alias("p_value"))


# Royston (1995), algorithm AS R94, lowest power first.
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
ROYSTON_GAMMA = (-2.273, 0.459)


def _poly(coefs: tuple[float, ...], x: str) -> str:
    return polynomial(x, coefs[::-1])


def shapiro_test(rows: DataFrame) -> DataFrame:
    """Shapiro-Wilk W and p per (segment, arm), Royston's approximation.

    Ranks come from value ranges, so a large arm is spread over many tasks; the
    weights are a function of the rank alone and W is a ratio of two sums.
    """
    keys = ["segment", "arm"]
    c = F.col
    sizes = rows.groupBy(*keys).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("v"))
    sizes = stage(sizes.where((c("n") >= 3) & (c("v") > VARIANCE_EPSILON)))
    ranked = attach(ranked_rows(rows.select(*keys, "y"), keys, "y"), sizes, keys)
    ranked = ranked.withColumn("pos", (c("rank") - 0.375) / (c("n") + 0.25))
    ranked = ranked.withColumn("m", F.expr(quantile("pos")))
    # The sum of squared scores needs only the sizes, but is taken from the rows' ranks.
    sums = ranked.groupBy(*keys).agg(
        F.max("n").cast("double").alias("n"), F.max("v").alias("v"),
        F.sum(c("m") * c("m")).alias("mm"),
        F.sum(c("m") * (c("y") - c("mean"))).alias("my"),
        F.max("m").alias("m_last"),
        F.max(F.when(c("rank") == c("n") - 1, c("m"))).alias("m_second"),
        F.sum(F.when(c("rank") == c("n"), c("y")).when(c("rank") == 1, -c("y"))).alias("outer_gap"),
        F.sum(F.when(c("rank") == c("n") - 1, c("y")).when(c("rank") == 2, -c("y"))).alias("inner_gap"),
    )
    s = add(sums, a1=f"m_last / sqrt(mm) + {_poly(ROYSTON_LAST, '(1 / sqrt(n))')}",
            a2=f"m_second / sqrt(mm) + {_poly(ROYSTON_SECOND, '(1 / sqrt(n))')}")
    s = add(s, root="""sqrt(CASE WHEN n > 5
        THEN (mm - 2 * m_last * m_last - 2 * m_second * m_second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
        ELSE (mm - 2 * m_last * m_last) / (1 - 2 * a1 * a1) END)""")
    # The inner weights are the scores over the root; the ends have their own.
    s = add(s, b=f"""CASE WHEN n = 3 THEN {math.sqrt(0.5)!r}D * outer_gap
        WHEN n > 5 THEN (my - m_last * outer_gap - m_second * inner_gap) / root + a1 * outer_gap + a2 * inner_gap
        ELSE (my - m_last * outer_gap) / root + a1 * outer_gap END""")
    s = add(s, statistic="least(1D, b * b / ((n - 1) * v))")
    s = add(s, g=_poly(ROYSTON_GAMMA, "n"), lw="ln(1 - statistic)", ln_n="ln(n)")
    s = add(s, z=f"""CASE WHEN n <= 11
        THEN (-ln(g - lw) - {_poly(ROYSTON_SMALL_MEAN, 'n')}) / exp({_poly(ROYSTON_SMALL_SD, 'n')})
        ELSE (lw - {_poly(ROYSTON_LARGE_MEAN, 'ln_n')}) / exp({_poly(ROYSTON_LARGE_SD, 'ln_n')}) END""")
    s = add(s, _p=f"""CASE
        WHEN n = 3 THEN greatest(0D, {(6.0 / math.pi)!r}D * (asin(sqrt(statistic)) - {math.asin(math.sqrt(0.75))!r}D))
        WHEN n <= 11 AND lw >= g THEN 1e-99D
        WHEN z >= 0 THEN {upper_tail('abs(z)')} ELSE 1 - {upper_tail('abs(z)')} END""")
    return s.select(*keys, c("n").cast("bigint").alias("n"), "statistic", sanitize_p(c("_p")).alias("p_value"))


def normality_test(rows: DataFrame, moments: DataFrame, alpha: float = 0.05, test: str = "by_size") -> DataFrame:
    """One test for all segments, or (``by_size``) D'Agostino for large ones and Shapiro-Wilk otherwise.

    ``moments`` must be staged. Each test runs only on the segments it applies to;
    its name is in the row.
    """
    c = F.col
    low, high = F.least("n_t", "n_c"), F.greatest("n_t", "n_c")
    plan = moments.select("segment", (
        F.when((low >= DAGOSTINO_MIN_N) & {
            "by_size": high > SHAPIRO_MAX_N, "shapiro": F.lit(False)}.get(test, F.lit(True)), "dagostino_k2")
        .when((low >= 3) & F.lit(test != "dagostino_k2"), "shapiro").otherwise("not_applicable")).alias("normality_test"))
    plan = stage(plan)
    parts = []
    for name, run in (("dagostino_k2", dagostino_test), ("shapiro", shapiro_test)):
        mine = plan.where(c("normality_test") == name).select("segment")
        if not mine.isEmpty():
            parts.append(run(attach(rows, stage(mine), ["segment"])).select("segment", "arm", "statistic", "p_value"))
    if parts:
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        plan = plan.join(side_by_side(found, ["p_value"]), "segment", "left")
    else:
        plan = plan.withColumns({f"p_value_{a}": F.lit(None).cast("double") for a in "tc"})
    return plan.select(
        "segment", "normality_test",
        c("p_value_t").alias("treatment_normality_p_value"), c("p_value_c").alias("control_normality_p_value"),
        (c("p_value_t") > alpha).alias("treatment_normality_passed"),
        (c("p_value_c") > alpha).alias("control_normality_passed"))
