"""Chart-ready and report-ready tables: projections of the segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.operators.arms import segment_rows

c = F.col

# Table keys with the other names they answer to.
CHART_ALIASES = {
    "statistical_summary": ("summary", "stats", "table"),
    "dashboard": (),
    "treatment_vs_control": ("treatment_control", "comparison", "means"),
    "effect_sizes": ("effect", "effect_size", "effects"),
    "combined_effects": ("combined",),
    "proportion_comparison": ("proportion", "conversion"),
    "p_values": ("pvalue", "p_value", "significance"),
    "sample_sizes": ("sample", "sample_size", "samples"),
    "power_analysis": ("power",),
    "cohens_d": ("cohen", "effect_magnitude"),
    "effect_waterfall": ("waterfall", "contribution"),
    "bayesian_probability": ("probability",),
    "bayesian_credible_intervals": ("bayesian_credible", "credible_interval", "credible"),
    "bayesian_expected_loss": ("bayesian_loss", "expected_loss", "loss"),
    "distribution": (),
}


def chart_keys(selection: str = "all") -> list[str]:
    wanted = (selection or "all").strip().lower()
    if wanted == "all":
        return [k for k in CHART_ALIASES if k != "distribution"]
    if wanted == "bayesian":
        return [k for k in CHART_ALIASES if k.startswith("bayesian_")]
    return [k for k, names in CHART_ALIASES.items() if wanted == k or wanted in names][:1]


def direction(value: Column, flag: Column) -> Column:
    return F.when(flag & (value > 0), "positive").when(flag & (value < 0), "negative").otherwise("neutral")


def d_band(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible")


def waterfall(results: DataFrame) -> DataFrame:
    """Contribution of each segment, largest first, and the total."""
    parts = segment_rows(results).rollup("segment").agg(
        F.sum("total_effect").alias("contribution"), F.grouping("segment").alias("is_total"))
    return parts.select(
        F.when(c("is_total") == 1, "Total").otherwise(c("segment")).alias("segment"), "contribution",
        F.when(c("is_total") == 1, "total").otherwise("relative").alias("measure"),
    ).orderBy((c("measure") == "total").asc(), c("contribution").desc(), "segment")


def chart_table(results: DataFrame, key: str) -> DataFrame:
    """Data behind one chart, by key or alias."""
    keys = chart_keys(key)
    if len(keys) != 1:
        raise ValueError(f"Unknown chart '{key}'")
    key = keys[0]
    if key == "effect_waterfall":
        return waterfall(results)
    least_loss = F.least("bayesian_expected_loss_treatment", "bayesian_expected_loss_control")
    tables = {
        "treatment_vs_control": ["treatment_mean", "control_mean"],
        "effect_sizes": [
            "effect_size", (c("effect_size") - c("ci_lower")).alias("error_minus"),
            (c("ci_upper") - c("effect_size")).alias("error_plus"),
            direction(c("effect_size"), c("is_significant")).alias("direction")],
        "combined_effects": [
            F.when(c("is_significant"), c("effect_size") * c("treatment_size")).otherwise(0.0).alias("t_test_effect"),
            "proportion_effect", "total_effect"],
        "proportion_comparison": [
            (c("treatment_proportion") * 100).alias("treatment_rate"),
            (c("control_proportion") * 100).alias("control_rate"), "proportion_is_significant"],
        "p_values": ["p_value", F.lit(0.05).alias("threshold"), (c("p_value") < 0.05).alias("below_threshold")],
        "sample_sizes": ["treatment_size", "control_size"],
        "power_analysis": [(c("power") * 100).alias("power_percent"), F.lit(80.0).alias("target_percent"),
                           (c("power") >= 0.8).alias("is_adequate")],
        "cohens_d": ["cohens_d", d_band(c("cohens_d")).alias("band")],
        "bayesian_probability": [
            (c("bayesian_prob_treatment_better") * 100).alias("probability_percent"),
            F.when(c("bayesian_prob_treatment_better") > 0.95, "positive")
            .when(c("bayesian_prob_treatment_better") < 0.05, "negative").otherwise("neutral").alias("direction")],
        "bayesian_credible_intervals": [
            "effect_size", "bayesian_credible_lower", "bayesian_credible_upper",
            direction(c("effect_size"), c("bayesian_is_significant")).alias("direction")],
        "bayesian_expected_loss": [
            least_loss.alias("expected_loss"),
            F.when(c("bayesian_expected_loss_treatment") <= c("bayesian_expected_loss_control"), "treatment")
            .otherwise("control").alias("preferred_arm")],
        "statistical_summary": [
            "treatment_size", "control_size", "effect_size", "cohens_d", "p_value", "power",
            "bayesian_prob_treatment_better", "total_effect"],
        "dashboard": [
            "treatment_mean", "control_mean", "effect_size", "p_value", "power", "treatment_size", "control_size"],
    }
    if key == "distribution":
        raise ValueError("distribution needs the raw table: use armlift.operators.profile.distribution")
    return results.select("segment", *tables[key])


def prepost_report(results: DataFrame) -> DataFrame:
    return results.select(
        "segment", "aa_test_passed", "bootstrapping_applied", "treatment_pre_mean", "control_pre_mean",
        "treatment_post_mean", "control_post_mean", "did_effect")


def frequentist_report(results: DataFrame) -> DataFrame:
    mean_part = F.when(c("is_significant"), c("effect_size") * c("treatment_size")).otherwise(0.0)
    return results.select(
        "segment", "treatment_size", "control_size", "p_value", "is_significant", "effect_size",
        "proportion_p_value", "proportion_is_significant", "proportion_effect_per_customer",
        (mean_part + c("proportion_effect")).alias("total_effect"))


def bayesian_report(results: DataFrame) -> DataFrame:
    return results.select(
        "segment", "bayesian_prob_treatment_better", "bayesian_credible_lower", "bayesian_credible_upper",
        F.least("bayesian_expected_loss_treatment", "bayesian_expected_loss_control").alias("expected_loss"),
        "bayesian_total_effect", "bayesian_is_significant")


def truncated(df: DataFrame, limit: int, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """First rows, and a one-row notice with shown and total counts."""
    head = (df.orderBy(*order) if order else df).limit(limit)
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"))
    shown = F.least(c("total_rows"), F.lit(limit).cast("bigint"))
    text = F.when(c("total_rows") > limit, F.format_string("showing first %d of %d rows", shown, c("total_rows")))
    return head, counts.select(shown.alias("shown_rows"), "total_rows", text.alias("notice"))
