"""Whole flows: from a table and its roles to results, summary and tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.config import Options, Roles, resolve_covariates
from armlift.functions import tails
from armlift.operators import inference as inf
from armlift.operators.arms import analysis_rows, is_pooled, mark_overall
from armlift.operators.balance import rebalance_control
from armlift.operators.bayes import bayesian_test
from armlift.operators.covariates import covariate_model
from armlift.operators.duplicates import duplicate_units
from armlift.operators.families import metric_family
from armlift.operators.models import huber_shift, log_shift
from armlift.operators.moments import (
    aligned_rows, enough, failures, segment_moments,
)
from armlift.operators.multiplicity import bh_fdr, sequential
from armlift.operators.order_stats import histogram
from armlift.operators.robustness import levene_test, normality_test, outlier_sensitivity, robust_sums
from armlift.operators.summary import recommendations, summarize
from armlift.plans.roles import auto_configure
from armlift.session import stage

c = F.col


@dataclass(frozen=True)
class Analysis:
    """Lazy result tables of one experiment."""

    results: DataFrame
    failures: DataFrame
    roles: Roles
    warnings: tuple[str, ...] = ()

    @property
    def summary(self) -> DataFrame:
        return summarize(self.results, self.failures)

    @property
    def recommendations(self) -> DataFrame:
        return recommendations(self.results)


def power_columns(m: DataFrame, options: Options) -> DataFrame:
    """Achieved power, required units and detectable effect of every segment at once."""
    n_t, n_c = c("rows_t"), c("rows_c")
    ratio = F.when(n_t > 0, n_c / n_t).otherwise(1.0)
    m = m.withColumns({
        "power": tails.power_of(c("cohens_d"), n_t, n_c, options.alpha),
        "required_sample_size": tails.required_n_of(c("cohens_d"), ratio, options.alpha, options.power),
        "achieved_mde": tails.detectable_effect_of(n_t, n_c, options.alpha, options.power),
    })
    return m.withColumn("is_sample_adequate", c("power") >= options.power)


def core_results(m: DataFrame, options: Options) -> DataFrame:
    """All inference that needs nothing but the segment moments and ``metric_type``."""
    m = inf.aa_test(m, options.alpha)
    if options.cuped:
        m = inf.cuped_moments(m)
    else:
        m = m.withColumns({"cuped_applied": F.lit(False), "cuped_theta": F.lit(0.0),
                           "cuped_variance_reduction": F.lit(0.0), "cuped_reason": F.lit(None).cast("string")})
    m = inf.primary_test(m, options)
    m = inf.proportion_test(m, options.alpha, options.proportion_method)
    m = inf.sample_ratio(m, options.alpha, options.expected_treatment_ratio)
    m = inf.significance(m, options.alpha)
    m = inf.combined_effects(m)
    m = inf.variance_ratio(m)
    m = power_columns(m, options)
    m = bayesian_test(m, options.posterior)
    has = c("has_pre")
    return m.withColumns({
        "did_treatment_change": F.when(has, c("dmean_t")).otherwise(0.0),
        "did_control_change": F.when(has, c("dmean_c")).otherwise(0.0),
        "did_effect": F.when(has, c("dmean_t") - c("dmean_c")).otherwise(c("effect_size")),
        "treatment_size": c("rows_t"), "control_size": c("rows_c"),
        "treatment_mean": c("mean_t"), "control_mean": c("mean_c"),
        "treatment_post_mean": c("mean_t"), "control_post_mean": c("mean_c"),
        "treatment_pre_mean": F.when(has, c("xmean_t")).otherwise(0.0),
        "control_pre_mean": F.when(has, c("xmean_c")).otherwise(0.0),
    })


RESULT_COLUMNS = [
    "segment", "treatment_size", "control_size", "treatment_pre_mean", "treatment_post_mean",
    "control_pre_mean", "control_post_mean", "treatment_mean", "control_mean", "effect_size", "cohens_d",
    "t_statistic", "p_value", "is_significant", "ci_lower", "ci_upper", "metric_type", "model_type",
    "model_effect", "model_ci_lower", "model_ci_upper", "model_effect_scale", "model_effect_exponentiated",
    "power", "required_sample_size", "is_sample_adequate", "achieved_mde",
    "did_treatment_change", "did_control_change", "did_effect", "aa_test_passed", "aa_p_value",
    "treatment_proportion", "control_proportion", "proportion_diff", "proportion_z_stat",
    "proportion_p_value", "proportion_is_significant", "inference_guardrail_triggered",
    "proportion_guardrail_triggered", "inference_blocked", "proportion_blocked", "inference_reasons",
    "proportion_reasons", "non_finite_removed", "srm_chi2", "srm_p_value", "srm_is_mismatch",
    "srm_is_applicable", "srm_reason", "srm_observed_treatment_ratio", "srm_observed_control_ratio",
    "srm_expected_treatment_size", "srm_expected_control_size", "variance_ratio", "variance_ratio_passed",
    "proportion_effect", "proportion_effect_per_customer", "total_effect", "total_effect_per_customer",
    "bayesian_prob_treatment_better", "bayesian_expected_loss_treatment", "bayesian_expected_loss_control",
    "bayesian_credible_lower", "bayesian_credible_upper", "bayesian_relative_uplift", "bayesian_is_significant",
    "bayesian_total_effect", "bayesian_total_effect_per_customer", "rows_dropped",
    "cuped_applied", "cuped_theta", "cuped_variance_reduction", "cuped_reason",
]


def analyze(df: DataFrame, roles: Roles, options: Options | None = None) -> Analysis:
    """Analyse every segment (and/or the whole table) of an experiment.

    The table is scanned once for all moments. Robust fits, covariate models and
    row-level diagnostics add grouped scans for all segments together; the number
    of jobs never depends on the number of segments.
    """
    options = options or Options()
    covs = resolve_covariates(df, roles) if options.covariates else ()
    rows = analysis_rows(df, roles, options.scope, covs, unit=options.rebalance and roles.customer_id in df.columns)
    moments = stage(segment_moments(rows))
    report = None
    if options.rebalance and roles.usable_pre(df):
        rows, report = rebalance_control(
            rows, enough(moments), options.rebalance_iterations, alpha=options.alpha, seed=options.seed)
        report = stage(report)
        if not report.isEmpty():
            moments = stage(segment_moments(rows))
    lost = failures(moments)
    usable = stage(enough(moments)) if options.diagnostics else enough(moments)
    multi = options.diagnostics or covs or options.metric_type in ("auto", "heavy_tail")
    part = aligned_rows(rows, usable) if multi else rows
    # one histogram serves the family rule, the outlier and the variance check
    hist = stage(histogram(part, ["segment", "arm"], "y")) if options.diagnostics else None
    m = stage(metric_family(usable, rows, options, hist))

    heavy = m.where(c("metric_type") == "heavy_tail")
    fit_needed = options.metric_type in ("auto", "heavy_tail") and not heavy.isEmpty()
    base = m
    if fit_needed:
        flat = (F.greatest("var_t", "var_c") <= 0)
        target = stage(heavy.where(~flat))
        mine = aligned_rows(rows, target)
        fits = log_shift(mine, target) if options.heavy_tail_strategy == "log_transform" else huber_shift(mine)
        base = m.join(fits.drop("fit_scale"), "segment", "left")
    results = mark_overall(core_results(base, options).select(*RESULT_COLUMNS), is_pooled(roles, options.scope))
    results = _with_balance(results, report, m)
    if covs:
        results = _with_covariates(results, covariate_model(part, m, covs, options))
    else:
        results = _with_covariates(results, None)
    if options.diagnostics:
        results = _with_diagnostics(results, df, roles, options, part, m, hist)
    results = sequential(results, options.sequential, options.alpha)
    results = bh_fdr(results, options.alpha)
    return Analysis(stage(nest_diagnostics(results)), stage(lost), roles)


def _with_balance(results: DataFrame, report: DataFrame | None, m: DataFrame) -> DataFrame:
    if report is None:
        return results.withColumns({
            "bootstrapping_applied": F.lit(False), "original_control_size": c("control_size")})
    extra = report.select(
        "segment", c("aa_p_value").alias("_p"), c("aa_test_passed").alias("_ok"),
        c("original_control_size").alias("_size"))
    out = results.join(extra, "segment", "left")
    return out.withColumns({
        "bootstrapping_applied": c("_p").isNotNull(),
        "original_control_size": F.coalesce("_size", "control_size"),
        "aa_p_value": F.coalesce("_p", "aa_p_value"),
        "aa_test_passed": F.coalesce("_ok", "aa_test_passed"),
    }).drop("_p", "_ok", "_size")


def _with_covariates(results: DataFrame, adjusted: DataFrame | None) -> DataFrame:
    """Unadjusted values stand in where no covariate model applies."""
    spec: dict[str, tuple[Column, str]] = {
        "covariate_adjustment_applied": (F.lit(False), "boolean"),
        "covariates_used": (F.array().cast("array<string>"), "array<string>"),
        "covariate_adjusted_effect": (c("effect_size"), "double"),
        "covariate_adjusted_p_value": (c("p_value"), "double"),
        "covariate_adjusted_ci_lower": (c("ci_lower"), "double"),
        "covariate_adjusted_ci_upper": (c("ci_upper"), "double"),
        "covariate_adjusted_model_type": (F.lit("none"), "string"),
        "covariate_adjusted_effect_scale": (c("model_effect_scale"), "string"),
        "covariate_adjusted_effect_exponentiated": (c("model_effect_exponentiated"), "double"),
        "average_marginal_effect_se": (F.lit(None).cast("double"), "double"),
        "covariate_raw_ci_lower": (c("ci_lower"), "double"),
        "covariate_raw_ci_upper": (c("ci_upper"), "double"),
        "covariate_model_converged": (F.lit(None).cast("boolean"), "boolean"),
        "covariate_model_reason": (F.lit(""), "string"),
    }
    if adjusted is None:
        return results.withColumns({k: v for k, (v, _) in spec.items()})
    out = results.join(adjusted.select("segment", *spec), "segment", "left")
    return out.withColumns({k: F.coalesce(c(k), v) for k, (v, _) in spec.items()})


def _with_diagnostics(
    results: DataFrame, df: DataFrame, roles: Roles, options: Options, part: DataFrame, m: DataFrame, hist: DataFrame,
) -> DataFrame:
    normal = normality_test(part, m, options.alpha, options.normality)
    sums = robust_sums(part, hist=hist)
    levene = levene_test(m, sums, options.alpha).drop("levene_df")
    outliers = outlier_sensitivity(m, sums)
    doubles = duplicate_units(df, roles, options.scope).select(
        "segment", "unique_units", "within_arm_repeats", "cross_arm_units", "has_duplicates",
        c("warning").alias("duplicate_warning"))
    for extra in (normal, levene, outliers, doubles):
        results = results.join(stage(extra), "segment", "left")
    return results


def nest_diagnostics(results: DataFrame) -> DataFrame:
    """Add the nested diagnostics struct built from the flat columns."""
    def pick(*names: str) -> list[Column]:
        return [c(n) for n in names if n in results.columns]

    frequentist = F.struct(
        F.struct(c("inference_guardrail_triggered").alias("guardrail_triggered"),
                 c("inference_blocked").alias("blocks_significance"),
                 c("inference_reasons").alias("reasons")).alias("t_test"),
        F.struct(c("proportion_guardrail_triggered").alias("guardrail_triggered"),
                 c("proportion_blocked").alias("blocks_significance"),
                 c("proportion_reasons").alias("reasons")).alias("proportion_test"),
        F.struct(*pick("metric_type", "model_type", "model_effect_scale", "model_effect",
                       "model_effect_exponentiated", "covariate_adjustment_applied", "covariates_used",
                       "covariate_adjusted_model_type", "covariate_adjusted_effect_scale"))
        .alias("model_inference"))
    quality = [F.struct(*pick(
        "srm_chi2", "srm_p_value", "srm_is_mismatch", "srm_is_applicable", "srm_reason",
        "srm_observed_treatment_ratio", "srm_expected_treatment_size", "srm_expected_control_size")).alias("srm")]
    if "normality_test" in results.columns:
        quality += [
            F.struct(*pick("normality_test", "treatment_normality_p_value", "control_normality_p_value",
                           "treatment_normality_passed", "control_normality_passed", "levene_p_value",
                           "equal_variance_passed", "variance_reason")).alias("assumptions"),
            F.struct(*pick("winsorized_effect", "trimmed_effect", "winsorized_delta", "trimmed_delta",
                           "max_abs_delta", "sensitivity_score", "is_outlier_sensitive")).alias("outlier_sensitivity"),
            F.struct(*pick("unique_units", "within_arm_repeats", "cross_arm_units", "has_duplicates",
                           "duplicate_warning")).alias("duplicate_units"),
        ]
    return results.withColumn("diagnostics", F.struct(
        frequentist.alias("frequentist"), F.struct(*quality).alias("experiment_quality")))


def auto_analyze(df: DataFrame, options: Options | None = None) -> Analysis:
    """Detect roles and labels, then analyse."""
    found = auto_configure(df)
    if not found.success:
        raise ValueError(found.error)
    done = analyze(df, found.roles, options)
    return Analysis(done.results, done.failures, done.roles, found.warnings)


def sample_size_table(
    history: DataFrame, value: str, effects: list[float], metric_type: str = "continuous",
    segment: str | None = None, alpha: float = 0.05, power: float = 0.8, ratio: float = 1.0,
) -> DataFrame:
    """Units needed per arm for a list of absolute effects, from measured baselines.

    Baselines of all segments come from one aggregation over the history.
    """
    if metric_type not in ("proportion", "continuous"):
        raise ValueError("metric_type must be 'proportion' or 'continuous'")
    if not effects or min(effects) <= 0:
        raise ValueError("every effect must be positive")
    if not (0 < alpha < 1 and 0 < power < 1):
        raise ValueError("alpha and power must be in (0, 1)")
    name = F.col(segment).cast("string") if segment else F.lit("Overall")
    v = F.col(value).cast("double")
    base = history.where(v.isNotNull() & name.isNotNull()).groupBy(name.alias("segment")).agg(
        F.avg(v).alias("baseline_mean"), F.stddev_samp(v).alias("baseline_std"),
        F.avg((v != 0).cast("double")).alias("baseline_rate"))
    grid = base.withColumn("mde", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    if metric_type == "continuous":
        sized = grid.where("baseline_std > 0").withColumn("standardized_effect", c("mde") / c("baseline_std"))
    else:
        p1, p2 = c("baseline_rate"), c("baseline_rate") + c("mde")
        sized = grid.where((p1 > 0) & (p1 < 1) & (p2 < 1)).withColumn(
            "standardized_effect", 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2)))
    sized = sized.withColumn("treatment_n", tails.required_n_of(
        c("standardized_effect"), F.lit(ratio), alpha, power))
    sized = sized.withColumn("control_n", F.bround(c("treatment_n") * ratio).cast("bigint"))
    return sized.withColumn("total_n", c("treatment_n") + c("control_n"))
