"""Benjamini-Hochberg correction and group-sequential decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlift.config import Sequential
from armlift.functions.guards import sanitize_p
from armlift.functions.normal import upper_tail, z_quantile
from armlift.session import BROADCAST_ROWS, stage

P_STEPS = 64  # buckets per e-fold of the p-value


def _adjust_small(df: DataFrame, p: str, adjusted: str, by: list[str]) -> DataFrame:
    """p * m / rank, then the minimum over all larger p; one window per experiment."""
    whole = Window.partitionBy(*by)
    ranked = df.withColumn("_p", sanitize_p(F.col(p)))
    ranked = ranked.withColumns({
        "_m": F.count(F.lit(1)).over(whole),
        "_rank": F.row_number().over(whole.orderBy("_p", "segment"))})
    up = whole.orderBy("_p", "segment").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lowest = F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(up)
    return ranked.withColumns({adjusted: F.least(F.lit(1.0), lowest), "_segments": F.col("_m")}).drop(
        "_p", "_m", "_rank")


def _adjust_large(df: DataFrame, p: str, adjusted: str, by: list[str]) -> DataFrame:
    """The same without sorting an experiment in one task.

    Ranks and running minima are taken inside p-value buckets and completed with
    the totals of the other buckets. Exact zeros and ones, which may be many,
    need no rank and are spread over buckets of their own outside the ranked range.
    """
    base = df.withColumn("_p", sanitize_p(F.col(p)))
    plain = (F.col("_p") > 0) & (F.col("_p") < 1)
    spread = F.pmod(F.xxhash64("segment"), F.lit(64))
    bucket = (
        F.when(plain, F.floor(F.log("_p") * P_STEPS))
        .when(F.col("_p") == 0, -1_000_000 - spread)
        .otherwise(1_000 + spread)
    )
    base = base.withColumn("_b", bucket.cast("bigint"))
    hist = base.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns({
        "_m": F.sum("_cnt").over(whole),
        "_below": F.sum("_cnt").over(upto) - F.col("_cnt"),
    })
    inside = Window.partitionBy(*by, "_b").orderBy("_p")
    ranked = base.join(hist, [*by, "_b"])
    ranked = ranked.withColumn("_rank", F.col("_below") + F.row_number().over(inside))
    ranked = ranked.withColumn(
        "_raw", F.when(plain, F.col("_p") * F.col("_m") / F.col("_rank")).otherwise(F.col("_p")))
    lows = ranked.groupBy(*by, "_b").agg(F.min("_raw").alias("_low"))
    after = whole.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    lows = lows.select(*by, "_b", F.min("_low").over(after).alias("_next"))
    suffix = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = ranked.withColumn("_here", F.min("_raw").over(suffix)).join(lows, [*by, "_b"])
    value = F.least(F.lit(1.0), F.col("_here"), F.coalesce("_next", F.lit(1.0)))
    out = out.withColumn(adjusted, F.when(plain, value).otherwise(F.col("_p")))
    return out.withColumn("_segments", F.col("_m")).drop(
        "_p", "_b", "_cnt", "_m", "_below", "_rank", "_raw", "_here", "_next")


def bh_fdr(results: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Correct the mean-test and proportion p-values across the segments of an experiment.

    ``by`` names the experiment columns. A pooled row (``is_overall``) is no hypothesis
    of the family and keeps its own p-values. Applied where an experiment has more than
    one segment; blocked segments are never significant.
    ``is_significant_adjusted_vetoed`` also honours the sample-ratio veto.
    """
    out = stage(results)
    small = out.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    adjust = _adjust_small if small else _adjust_large
    keys = [*(by or ["_experiment"]), *(["is_overall"] if "is_overall" in out.columns else [])]
    if not by:
        out = out.withColumn("_experiment", F.lit(1))
    out = adjust(out, "p_value", "p_value_adjusted", keys).drop("_segments")
    out = adjust(out, "proportion_p_value", "proportion_p_value_adjusted", keys)
    many = F.col("_segments") > 1
    out = out.withColumns({
        "multiple_testing_applied": many,
        "multiple_testing_method": F.when(many, "fdr_bh").otherwise("none"),
        "p_value_adjusted": F.when(many, F.col("p_value_adjusted")).otherwise(F.col("p_value")),
        "proportion_p_value_adjusted": F.when(many, F.col("proportion_p_value_adjusted"))
        .otherwise(F.col("proportion_p_value")),
    })
    # Benjamini-Hochberg rejects exactly where the adjusted p is at most alpha.
    main = (F.col("p_value_adjusted") <= alpha) & ~F.col("inference_blocked")
    prop = (F.col("proportion_p_value_adjusted") <= alpha) & ~F.col("proportion_blocked")
    out = out.withColumns({
        "is_significant_adjusted": F.when(many, main).otherwise(F.col("is_significant")),
        "proportion_is_significant_adjusted": F.when(many, prop).otherwise(F.col("proportion_is_significant")),
    })
    return out.withColumn(
        "is_significant_adjusted_vetoed", F.col("is_significant_adjusted") & ~F.col("srm_is_mismatch")
    ).drop("_segments", "_experiment")


def alpha_spent(fraction: str, method: str, alpha: float) -> str:
    """Cumulative alpha allowed at an information fraction, as SQL text."""
    pocock = f"{alpha}D * ln(1 + {(math.e - 1.0)!r}D * {fraction})"
    edge = upper_tail(f"{z_quantile(1 - alpha / 2)!r}D / sqrt({fraction})")
    spent = f"CASE WHEN {method} = 'pocock' THEN {pocock} ELSE 2 * {edge} END"
    return f"least(greatest({spent}, 0D), {alpha}D)"


def sequential(results: DataFrame, settings: Sequential, alpha: float = 0.05) -> DataFrame:
    """Stop/continue decision per segment.

    Where the results carry ``look_index`` and ``max_looks`` columns (an analysis
    of cumulative data by look) every look is decided in the same job; otherwise
    the look comes from the settings.
    """
    c = F.col
    by_row = {"look_index", "max_looks"} <= set(results.columns)
    if not settings.enabled and not by_row:
        return results.withColumns({
            "sequential_mode_enabled": F.lit(False), "sequential_method": F.lit("none"),
            "sequential_look_index": F.lit(0), "sequential_max_looks": F.lit(0),
            "sequential_information_fraction": F.lit(0.0), "sequential_alpha_spent": F.lit(0.0),
            "sequential_stop_recommended": F.lit(False), "sequential_decision": F.lit("not_requested"),
            "sequential_rationale": F.lit("")})
    out = results.withColumns({
        "_look": c("look_index") if by_row else F.lit(settings.look_index),
        "_max": c("max_looks") if by_row else F.lit(settings.max_looks),
        "_method": F.lit(settings.method)})
    out = out.withColumn("_max", F.greatest(c("_max").cast("int"), F.lit(1)))
    out = out.withColumn("_look", F.least(F.greatest(c("_look").cast("int"), F.lit(1)), c("_max")))
    out = out.withColumn("_info", c("_look") / c("_max"))
    out = out.withColumns({
        "_spent": F.expr(alpha_spent("_info", "_method", alpha)),
        "_p": sanitize_p(c("p_value")),
        "_crosses": (c("ci_lower") <= 0) & (c("ci_upper") >= 0),
    })
    final = c("_look") >= c("_max")
    futile = (c("_info") >= settings.futility_information) & (c("_p") >= settings.futility_p) & c("_crosses")
    out = out.withColumn("sequential_decision", (
        F.when(final & (c("_p") <= alpha), "final_accept")
        .when(final, "final_reject")
        .when(c("_p") <= c("_spent"), "stop_efficacy")
        .when(futile, "stop_futility")
        .otherwise("continue")))
    decision = c("sequential_decision")

    def say(template: str, *parts: Column) -> Column:
        return F.format_string(template, *parts)

    # Wording is ours; the numbers shown are the ones the decision used.
    why = (
        F.when(final, say("Look %d of %d is the last: p=%.4g against alpha=%.4g.",
                          c("_look"), c("_max"), c("_p"), F.lit(alpha)))
        .when(decision == "stop_efficacy", say("Look %d of %d: p=%.4g is within the spent alpha %.4g.",
                                               c("_look"), c("_max"), c("_p"), c("_spent")))
        .when(decision == "stop_futility", say(
            "Look %d of %d: p=%.4g is at least %.4g at information %.3f and the interval covers zero.",
            c("_look"), c("_max"), c("_p"), F.lit(settings.futility_p), c("_info")))
        .otherwise(say("Look %d of %d: p=%.4g has not reached the spent alpha %.4g (information %.3f).",
                       c("_look"), c("_max"), c("_p"), c("_spent"), c("_info")))
    )
    accepted = decision.isin("stop_efficacy", "final_accept")
    out = out.withColumns({
        "sequential_mode_enabled": F.lit(True),
        "sequential_method": c("_method"),
        "sequential_look_index": c("_look"),
        "sequential_max_looks": c("_max"),
        "sequential_information_fraction": c("_info"),
        "sequential_alpha_spent": c("_spent"),
        "sequential_stop_recommended": decision != "continue",
        "sequential_rationale": why,
        "sequential_thresholds": F.struct(
            F.lit(alpha).alias("significance_level"), c("_spent").alias("efficacy_p_value_threshold"),
            F.lit(settings.futility_p).alias("futility_p_value_threshold"),
            F.lit(settings.futility_information).alias("futility_min_information_fraction"),
            c("_info").alias("information_fraction"), c("_crosses").alias("ci_crosses_zero")),
    })
    # The spending boundary replaces the fixed alpha; guardrails and the ratio veto still block.
    blocked = c("inference_blocked") | c("srm_is_mismatch")
    out = out.withColumn("is_significant", accepted & ~blocked)
    return out.drop("_look", "_max", "_method", "_info", "_spent", "_p", "_crosses")
