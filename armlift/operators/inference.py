"""Tests and intervals as SQL arithmetic over the segment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.config import Options
from armlift.functions import tails
from armlift.functions.guards import (
    MIN_CELL, MIN_SAMPLE, VARIANCE_EPSILON, add, reason_list, snapped, valid_p,
)
from armlift.functions.normal import two_sided, z_quantile
from armlift.operators.families import OVERDISPERSION
from armlift.session import attach


def cohens_d(m: DataFrame) -> DataFrame:
    m = add(m, _sd="""CASE WHEN n_t >= 2 AND n_c >= 2 THEN
        sqrt(greatest(((n_t - 1) * var_t + (n_c - 1) * var_c) / (n_t + n_c - 2), 0D)) ELSE 0D END""")
    return add(m, cohens_d="CASE WHEN _sd > 0 THEN (mean_t - mean_c) / _sd ELSE 0D END").drop("_sd")


def welch_columns(m: DataFrame, name: str, stats: str = "", ok: str = "true") -> DataFrame:
    """Add standard error, statistic and degrees of freedom; null where not defined.

    ``stats`` prefixes the columns n_t, mean_t, var_t and their control twins.
    """
    n_t, n_c, v_t, v_c = (f"{stats}{x}" for x in ("n_t", "n_c", "var_t", "var_c"))
    a, b = f"({v_t} / {n_t})", f"({v_c} / {n_c})"
    m = add(m, **{f"{name}_se": f"""CASE WHEN {ok} AND {n_t} >= 2 AND {n_c} >= 2 AND {a} + {b} > 0
        THEN sqrt({a} + {b}) END"""})
    return add(m, **{
        f"{name}_t": f"({stats}mean_t - {stats}mean_c) / {name}_se",
        f"{name}_df": f"""CASE WHEN {name}_se IS NOT NULL THEN ({a} + {b}) * ({a} + {b})
            / ({a} * {a} / ({n_t} - 1) + {b} * {b} / ({n_c} - 1)) END""",
    })


def welch_test(m: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Welch t, p and interval; (0, 1, (0, 0)) when it is not defined."""
    m = welch_columns(m, "welch")
    m = m.withColumns({
        "_crit": tails.t_critical(1 - alpha / 2, F.col("welch_df")),
        "_p": tails.t_p_value(F.col("welch_t"), F.col("welch_df")),
    })
    m = add(
        m, welch_p="coalesce(_p, 1D)", welch_t="coalesce(welch_t, 0D)",
        welch_lower="coalesce(mean_t - mean_c - _crit * welch_se, 0D)",
        welch_upper="coalesce(mean_t - mean_c + _crit * welch_se, 0D)")
    return m.drop("_crit", "_p")


def aa_test(m: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Balance of the pre-period: Welch test on rows complete in pre and post."""
    if "aa_n_t" not in m.columns:
        return add(m, aa_t_statistic="0D", aa_p_value="1D", aa_test_passed="true", pre_effect_diff="0D")
    m = welch_columns(m, "_aa", "aa_")
    m = m.withColumn("_p", tails.t_p_value(F.col("_aa_t"), F.col("_aa_df")))
    enough = "(aa_n_t >= 2 AND aa_n_c >= 2)"
    return add(
        m, aa_p_value="coalesce(_p, 1D)", aa_t_statistic="coalesce(_aa_t, 0D)",
        aa_test_passed=f"NOT {enough} OR coalesce(_p, 1D) > {alpha}D",
        pre_effect_diff=f"CASE WHEN {enough} THEN aa_mean_t - aa_mean_c ELSE 0D END",
    ).drop("_aa_t", "_aa_df", "_aa_se", "_p")


def cuped_moments(m: DataFrame) -> DataFrame:
    """Replace the outcome moments by those of y - theta * (x - mean x).

    theta comes from both arms together; the adjusted mean and variance have a
    closed form in the moments, so no second pass over the rows is needed.
    """
    m = add(m, _between="n_t * n_c / nullif(n_t + n_c, 0)", _gx="xmean_t - xmean_c", _gy="mean_t - mean_c")
    m = add(
        m,
        _xvar="((n_t - 1) * xvar_t + (n_c - 1) * xvar_c + _between * _gx * _gx) / nullif(n_t + n_c - 1, 0)",
        _xycov="((n_t - 1) * cov_t + (n_c - 1) * cov_c + _between * _gx * _gy) / nullif(n_t + n_c - 1, 0)",
        pre_mean_all="(n_t * xmean_t + n_c * xmean_c) / nullif(n_t + n_c, 0)")
    m = add(m, cuped_reason=f"""CASE WHEN NOT has_pre THEN 'no_pre_period_metric'
        WHEN _xvar <= {VARIANCE_EPSILON}D OR var_all <= {VARIANCE_EPSILON}D THEN 'zero_variance' END""")
    m = add(m, cuped_applied="cuped_reason IS NULL",
            cuped_theta="CASE WHEN cuped_reason IS NULL THEN _xycov / _xvar ELSE 0D END")
    m = add(m, _adj="greatest(0D, var_all + cuped_theta * cuped_theta * _xvar - 2 * cuped_theta * _xycov)")
    m = add(m, cuped_variance_reduction="CASE WHEN cuped_applied THEN greatest(0D, 1 - _adj / var_all) ELSE 0D END")
    new = {"var_all": "CASE WHEN cuped_applied THEN _adj ELSE var_all END"}
    for a in "tc":
        new[f"mean_{a}"] = (f"CASE WHEN cuped_applied THEN mean_{a} - cuped_theta * (xmean_{a} - pre_mean_all) "
                            f"ELSE mean_{a} END")
        new[f"var_{a}"] = (f"CASE WHEN cuped_applied THEN greatest(0D, var_{a} + cuped_theta * cuped_theta * xvar_{a} "
                           f"- 2 * cuped_theta * cov_{a}) ELSE var_{a} END")
    if "metric_type" in m.columns:
        new["metric_type"] = "CASE WHEN cuped_applied THEN 'continuous' ELSE metric_type END"
    return add(m, **new).drop("_between", "_gx", "_gy", "_xvar", "_xycov", "_adj")


def cuped_rows(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Row-level adjusted outcome ``y_cuped``; ``staged`` holds cuped_theta and pre_mean_all."""
    joined = attach(rows, staged.select("segment", "cuped_theta", "pre_mean_all"), ["segment"], "left")
    return add(joined, y_cuped="y - cuped_theta * (x - pre_mean_all)").drop("cuped_theta", "pre_mean_all")


def primary_test(m: DataFrame, options: Options) -> DataFrame:
    """Metric-aware effect, statistic, p-value and both intervals.

    Needs ``metric_type``. Heavy-tailed segments take their fit from the columns
    ``fit_*`` when a model pass supplied them and the HC3 difference otherwise; a
    segment that the pass could not fit is marked as a fallback.
    """
    alpha, z = options.alpha, f"{z_quantile(1 - options.alpha / 2)!r}D"
    eps, small = f"{VARIANCE_EPSILON}D", MIN_SAMPLE
    welch = options.primary_test == "welch"
    m = cohens_d(m)
    if welch:
        m = welch_test(m, alpha)
    fitted = "fit_effect" in m.columns
    if not fitted:
        m = add(m, fit_effect="CAST(NULL AS DOUBLE)", fit_se="CAST(NULL AS DOUBLE)",
                fit_raw_se="CAST(NULL AS DOUBLE)", fit_type="CAST(NULL AS STRING)")
    over = f"(mean_all > {eps} AND var_all > {OVERDISPERSION} * mean_all)"
    negative = {"negative_binomial": "true", "auto": over}.get(options.count_model, "false")
    m = add(
        m, _raw=snapped("(mean_t - mean_c)"), _small=f"n_t < {small} OR n_c < {small}",
        _short="n_t < 2 OR n_c < 2", _degen=f"var_t <= {eps} OR var_c <= {eps}",
        non_finite_removed="(rows_t - n_t) + (rows_c - n_c)",
        model_type=f"""CASE
            WHEN n_t < 2 OR n_c < 2 THEN 'insufficient_data'
            WHEN var_t <= {eps} AND var_c <= {eps} THEN 'deterministic'
            WHEN metric_type = 'binary' AND mean_t > 0 AND mean_t < 1 AND mean_c > 0 AND mean_c < 1
                THEN 'glm_binomial'
            WHEN metric_type = 'count' AND mean_t > 0 AND mean_c > 0
                THEN CASE WHEN {negative} THEN 'glm_negative_binomial' ELSE 'glm_poisson' END
            WHEN metric_type = 'heavy_tail' AND fit_effect IS NOT NULL THEN fit_type
            WHEN metric_type IN ('binary', 'count'{", 'heavy_tail'" if fitted else ""}) THEN 'ols_hc3_fallback'
            ELSE '{"welch_t" if welch else "ols_hc3"}' END""")
    m = add(
        m,
        model_effect=snapped("""(CASE
            WHEN model_type = 'glm_binomial' THEN ln(mean_t / (1 - mean_t)) - ln(mean_c / (1 - mean_c))
            WHEN model_type IN ('glm_poisson', 'glm_negative_binomial') THEN ln(mean_t) - ln(mean_c)
            WHEN model_type IN ('rlm_huber', 'ols_log1p_hc3') THEN fit_effect
            WHEN model_type = 'insufficient_data' THEN 0D
            ELSE _raw END)"""),
        # Closed forms of the two-arm fits; the linear model uses HC3 errors.
        _se="""sqrt(CASE
            WHEN model_type = 'glm_binomial'
                THEN 1 / (n_t * mean_t * (1 - mean_t)) + 1 / (n_c * mean_c * (1 - mean_c))
            WHEN model_type = 'glm_negative_binomial'
                THEN (1 + mean_t) / (n_t * mean_t) + (1 + mean_c) / (n_c * mean_c)
            WHEN model_type = 'glm_poisson' THEN 1 / (n_t * mean_t) + 1 / (n_c * mean_c)
            WHEN model_type IN ('rlm_huber', 'ols_log1p_hc3') THEN fit_se * fit_se
            WHEN model_type IN ('ols_hc3', 'ols_hc3_fallback') THEN var_t / (n_t - 1) + var_c / (n_c - 1)
            ELSE 0D END)""",
        # Standard error of the same contrast on the raw scale.
        _raw_se="""sqrt(CASE
            WHEN model_type = 'glm_binomial' THEN mean_t * (1 - mean_t) / n_t + mean_c * (1 - mean_c) / n_c
            WHEN model_type = 'glm_negative_binomial' THEN mean_t * (1 + mean_t) / n_t + mean_c * (1 + mean_c) / n_c
            WHEN model_type = 'glm_poisson' THEN mean_t / n_t + mean_c / n_c
            WHEN model_type = 'ols_log1p_hc3' THEN fit_raw_se * fit_raw_se END)""")
    m = add(m, _z="CASE WHEN _se > 0 THEN model_effect / _se END")
    as_welch = "WHEN model_type = 'welch_t' THEN {}" if welch else ""
    m = add(
        m,
        effect_size="CASE WHEN _short THEN 0D ELSE _raw END",
        # An exact difference has an unbounded statistic: null here, p-value 0.
        t_statistic=f"""CASE WHEN model_type = 'deterministic' AND _raw <> 0 THEN CAST(NULL AS DOUBLE)
            {as_welch.format('welch_t')} ELSE coalesce(_z, 0D) END""",
        _p=f"""CASE WHEN model_type = 'deterministic' THEN CASE WHEN _raw = 0 THEN 1D ELSE 0D END
            {as_welch.format('welch_p')} ELSE coalesce({two_sided('_z')}, 1D) END""",
        model_ci_lower=f"CASE {as_welch.format('welch_lower') or 'WHEN false THEN 0D'} ELSE model_effect - {z} * _se END",
        model_ci_upper=f"CASE {as_welch.format('welch_upper') or 'WHEN false THEN 0D'} ELSE model_effect + {z} * _se END",
        model_effect_scale="""CASE
            WHEN model_type = 'glm_binomial' THEN 'log_odds'
            WHEN model_type IN ('glm_poisson', 'glm_negative_binomial') THEN 'log_rate'
            WHEN model_type = 'ols_log1p_hc3' THEN 'log_mean_difference'
            WHEN model_type = 'rlm_huber' THEN 'location_shift' ELSE 'mean_difference' END""",
        model_effect_exponentiated="""CASE
            WHEN model_type IN ('glm_binomial', 'glm_poisson', 'glm_negative_binomial', 'ols_log1p_hc3')
            THEN exp(model_effect) ELSE 1D END""",
        inference_reasons=reason_list(
            ("non_finite_removed > 0", "non_finite_values_removed"),
            ("_small", "small_sample_size"),
            ("_short", "insufficient_sample_size"),
            ("NOT _short AND _degen", "degenerate_variance"),
            ("model_type = 'ols_hc3_fallback'", "model_fit_failed_fallback_to_ols")),
        inference_blocked="_small")
    m = add(
        m, p_value=valid_p("_p"),
        ci_lower=f"coalesce(_raw - {z} * _raw_se, model_ci_lower)",
        ci_upper=f"coalesce(_raw + {z} * _raw_se, model_ci_upper)")
    return m.drop("_raw", "_small", "_short", "_degen", "_se", "_raw_se", "_z", "_p")


def proportion_test(m: DataFrame, alpha: float = 0.05, method: str = "score") -> DataFrame:
    """Two-proportion z-test on conversions (outcome not zero), with guardrails."""
    if method not in ("score", "wald"):
        raise ValueError("method must be 'score' or 'wald'")
    m = add(
        m,
        treatment_proportion="CASE WHEN n_t > 0 THEN conv_t / n_t ELSE 0D END",
        control_proportion="CASE WHEN n_c > 0 THEN conv_c / n_c ELSE 0D END",
        _empty="n_t <= 0 OR n_c <= 0",
        _few=f"n_t < {MIN_SAMPLE} OR n_c < {MIN_SAMPLE}",
        _thin=f"n_t > 0 AND n_c > 0 AND least(conv_t, n_t - conv_t, conv_c, n_c - conv_c) < {MIN_CELL}",
        _ends="""n_t > 0 AND n_c > 0 AND
            ((conv_t = 0 AND conv_c = 0) OR (conv_t = n_t AND conv_c = n_c))""",
        _pool="(conv_t + conv_c) / nullif(n_t + n_c, 0)")
    m = add(m, _pooled="_pool * (1 - _pool) * (1 / nullif(n_t, 0) + 1 / nullif(n_c, 0))",
            _own="treatment_proportion * (1 - treatment_proportion) / nullif(n_t, 0)"
                 " + control_proportion * (1 - control_proportion) / nullif(n_c, 0)")
    if method == "score":
        variance, tested = "_pooled * (n_t + n_c) / (n_t + n_c - 1)", "NOT (_empty OR _thin OR _ends)"
    else:
        variance, tested = "CASE WHEN _own > 0 THEN _own ELSE _pooled END", "NOT _empty AND _pooled > 0"
    m = add(
        m,
        proportion_diff="treatment_proportion - control_proportion",
        _z=f"CASE WHEN {tested} THEN (treatment_proportion - control_proportion) / sqrt({variance}) END",
        proportion_reasons=reason_list(
            ("(rows_t - n_t) + (rows_c - n_c) > 0", "non_finite_values_removed"),
            ("_empty", "invalid_proportion_inputs"),
            ("_few", "small_sample_size"),
            ("_thin", "expected_counts_too_small"),
            ("_ends", "degenerate_proportions")),
        proportion_blocked="_empty OR _few OR _thin OR _ends")
    m = add(m, _p=two_sided("_z"))
    m = add(m, proportion_z_stat="coalesce(_z, 0D)", proportion_p_value=valid_p("_p"))
    m = add(m, proportion_is_significant=f"proportion_p_value < {alpha}D AND NOT proportion_blocked")
    return m.drop("_empty", "_few", "_thin", "_ends", "_pool", "_pooled", "_own", "_z", "_p")


def sample_ratio(m: DataFrame, alpha: float = 0.05, expected: float = 0.5) -> DataFrame:
    """Chi-square check of the arm sizes against the planned split."""
    valid = 0.0 < expected < 1.0
    m = add(m, _n="rows_t + rows_c", srm_is_applicable=f"rows_t + rows_c > 0 AND {str(valid).lower()}",
            srm_expected_treatment_size=f"(rows_t + rows_c) * {expected!r}D",
            srm_expected_control_size=f"(rows_t + rows_c) * {(1.0 - expected)!r}D")
    gap = "(rows_t - srm_expected_treatment_size)"
    m = add(
        m,
        srm_chi2=f"""CASE WHEN srm_is_applicable THEN {gap} * {gap} / srm_expected_treatment_size
            + {gap} * {gap} / srm_expected_control_size ELSE 0D END""",
        srm_observed_treatment_ratio="CASE WHEN _n > 0 THEN rows_t / _n END",
        srm_observed_control_ratio="CASE WHEN _n > 0 THEN rows_c / _n END",
        srm_reason=f"""CASE WHEN _n <= 0 THEN 'no_observations'
            WHEN {str(not valid).lower()} THEN 'invalid_expected_ratio' END""")
    m = add(m, _p=two_sided("sqrt(srm_chi2)"))
    m = add(m, srm_p_value=f"CASE WHEN srm_is_applicable THEN {valid_p('_p')} ELSE 1D END")
    return add(m, srm_is_mismatch=f"srm_p_value < {alpha}D").drop("_n", "_p")


def significance(m: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significance flags after the sample-ratio veto."""
    return add(
        m,
        is_significant=f"p_value < {alpha}D AND NOT inference_blocked AND NOT srm_is_mismatch",
        proportion_is_significant="proportion_is_significant AND NOT srm_is_mismatch",
        inference_guardrail_triggered="size(inference_reasons) > 0 OR srm_is_mismatch",
        proportion_guardrail_triggered="size(proportion_reasons) > 0")


def combined_effects(m: DataFrame) -> DataFrame:
    """Mean effect plus conversion effect, per treated unit and in total."""
    m = add(m, proportion_effect_per_customer="""CASE WHEN proportion_is_significant AND proportion_diff > 0
        THEN proportion_diff * mean_c ELSE 0D END""",
            _mean_part="CASE WHEN is_significant THEN effect_size ELSE 0D END")
    return add(
        m,
        proportion_effect="proportion_effect_per_customer * rows_t",
        total_effect_per_customer="_mean_part + proportion_effect_per_customer",
        total_effect="(_mean_part + proportion_effect_per_customer) * rows_t").drop("_mean_part")


def variance_ratio(m: DataFrame) -> DataFrame:
    """Larger over smaller variance; passes below four, unknown at zero variance."""
    ratio = "greatest(var_t, var_c) / least(var_t, var_c)"
    return add(
        m,
        variance_ratio=f"CASE WHEN least(var_t, var_c) > 0 THEN {ratio} ELSE 0D END",
        variance_ratio_passed=f"CASE WHEN least(var_t, var_c) > 0 THEN {ratio} < 4 END")
