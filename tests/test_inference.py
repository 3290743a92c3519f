"""Tests, intervals and models against direct numpy fits and fixed cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlift.config import Options, Roles, Sequential, parse_covariates, resolve_covariates
from armlift.operators import inference as inf
from armlift.operators.arms import analysis_rows
from armlift.operators.bayes import bayesian_test, t_difference
from armlift.operators.covariates import covariate_model
from armlift.operators.duplicates import duplicate_units
from armlift.operators.families import metric_family
from armlift.operators.moments import aligned_rows, enough, failures, segment_moments
from armlift.operators.multiplicity import sequential
from armlift.operators.ratio import ratio_metric
from armlift.operators.robustness import dagostino_test, levene_test, outlier_sensitivity, robust_sums, shapiro_test
from armlift.session import stage

ROLES = Roles("grp", "y", "t", "c", segment="segment")


def arms(spark, t, c, segment="s", **more):
    df = pd.DataFrame({"segment": segment, "grp": ["t"] * len(t) + ["c"] * len(c), "y": np.r_[t, c].astype(float)})
    for k, v in more.items():
        df[k] = v
    return spark.createDataFrame(df)


def primary(spark, t, c, **options):
    rows = analysis_rows(arms(spark, t, c), ROLES)
    o = Options(**options)
    m = metric_family(enough(segment_moments(rows)), rows, o)
    return inf.primary_test(m, o).first()


def hc3(X, y, col=1):
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    u = (y - X @ b) / (1 - h)
    return b[col], math.sqrt((inv @ ((X.T * u**2) @ X) @ inv)[col, col])


def test_hc3_closed_form(spark):
    rng = np.random.default_rng(0)
    t, c = rng.normal(1, 2, 60), rng.normal(0, 1, 40)
    X = np.c_[np.ones(100), np.r_[np.ones(60), np.zeros(40)]]
    b, se = hc3(X, np.r_[t, c])
    row = primary(spark, t, c)
    assert row.model_type == "ols_hc3"
    assert row.effect_size == pytest.approx(b)
    assert row.t_statistic == pytest.approx(b / se)
    assert row.ci_upper == pytest.approx(b + 1.959963984540054 * se)


def test_families_and_guardrails(spark):
    rng = np.random.default_rng(1)
    assert primary(spark, rng.integers(0, 2, 50), rng.integers(0, 2, 50)).model_type == "glm_binomial"
    assert primary(spark, rng.poisson(3, 80), rng.poisson(2, 80)).model_type == "glm_poisson"
    assert primary(spark, rng.poisson(3, 80), rng.poisson(2, 80), count_model="negative_binomial").model_type \
        == "glm_negative_binomial"
    heavy = primary(spark, np.r_[rng.normal(0, 1, 60), 900.0], rng.normal(0, 1, 60))
    assert heavy.metric_type == "heavy_tail"
    small = primary(spark, [1.5, 2.5, 3.7], [1.1, 2.2, 9.5])
    assert small.inference_blocked and "small_sample_size" in small.inference_reasons


@pytest.mark.parametrize("t,c,p", [([10.0] * 20, [10.0] * 20, 1.0), ([11.0] * 20, [10.0] * 20, 0.0)])
def test_deterministic(spark, t, c, p):
    row = primary(spark, t, c)
    assert row.model_type == "deterministic" and row.p_value == p
    assert (row.t_statistic is None) == (p == 0.0)


def test_nulls_non_finite_and_failures(spark):
    df = spark.createDataFrame([
        ("a", "t", 1.0), ("a", "t", None), ("a", "t", float("nan")), ("a", "t", 2.0), ("a", "c", float("inf")),
        ("a", "c", 1.0), ("a", "c", 3.0), ("a", "other", 9.0), ("b", "t", 1.0), (None, "t", 5.0)],
        "segment string, grp string, y double")
    m = segment_moments(analysis_rows(df, ROLES)).collect()
    a = next(r for r in m if r.segment == "a")
    assert (a.rows_dropped, a.n_t, a.n_c, a.rows_c) == (2, 2, 2, 3)
    assert {r.segment for r in m} == {"a", "b"}
    lost = failures(segment_moments(analysis_rows(df, ROLES))).collect()
    assert [(r.segment, r.error) for r in lost] == [
        ("b", "segment 'b' has 1 treatment and 0 control rows; each arm needs two")]
    both = segment_moments(analysis_rows(df, ROLES, "both")).where("segment = 'Overall'").first()
    assert both.n_t == 4  # the row without a segment counts overall


def test_pre_period_alignment(spark):
    y = np.arange(12.0)
    x = y * 2
    x[0] = np.nan
    df = arms(spark, y[:6], y[6:], pre=x)
    roles = Roles("grp", "y", "t", "c", segment="segment", pre_effect="pre")
    m = segment_moments(analysis_rows(df, roles)).first()
    assert m.has_pre and m.n_t == 5 and m.post_n_t == 6
    assert m.dmean_t == pytest.approx(np.mean(y[1:6] - x[1:6]))
    lonely = arms(spark, y[:6], y[6:], pre=[1.0] + [np.nan] * 11)
    m = segment_moments(analysis_rows(lonely, roles)).first()
    assert not m.has_pre and m.n_t == 6


def test_cuped_matches_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(10, 3, 900)
    y = 0.9 * x + rng.normal(0, 1, 900)
    y[:400] += 0.5
    df = arms(spark, y[:400], y[400:], pre=x)
    roles = Roles("grp", "y", "t", "c", segment="segment", pre_effect="pre")
    m = inf.cuped_moments(enough(segment_moments(analysis_rows(df, roles)))).first()
    theta = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    adj = y - theta * (x - x.mean())
    assert m.cuped_theta == pytest.approx(theta)
    assert m.mean_t == pytest.approx(adj[:400].mean())
    assert m.var_c == pytest.approx(np.var(adj[400:], ddof=1))
    assert m.cuped_variance_reduction == pytest.approx(1 - np.var(adj, ddof=1) / np.var(y, ddof=1))
    assert m.cuped_variance_reduction > 0.5
    flat = inf.cuped_moments(enough(segment_moments(analysis_rows(arms(spark, y[:9], y[9:19], pre=1.0), roles)))).first()
    assert not flat.cuped_applied and flat.cuped_reason == "zero_variance"


def irls(X, y, family):
    b = np.zeros(X.shape[1])
    mu = (y + 0.5) / 2 if family == "binomial" else (y + y.mean()) / 2
    eta = np.log(mu / (1 - mu)) if family == "binomial" else np.log(mu)
    for _ in range(60):
        d = mu * (1 - mu) if family == "binomial" else mu
        w = d**2 / {"binomial": mu * (1 - mu), "poisson": mu, "nb": mu + mu**2}[family]
        cov = np.linalg.inv((X.T * w) @ X)
        b = cov @ X.T @ (w * (eta + (y - mu) / d))
        eta = X @ b
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
    return b[1], math.sqrt(cov[1, 1])


@pytest.mark.parametrize("kind", ["continuous", "binomial", "poisson"])
def test_covariate_models(spark, kind):
    rng = np.random.default_rng(7)
    n = 400
    x, g = rng.normal(50, 9, n), (np.arange(n) < 180).astype(float)
    z = -0.2 + 0.5 * g + 0.05 * (x - 50)
    y = {"continuous": z + rng.normal(0, 1, n), "binomial": (rng.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(float),
         "poisson": rng.poisson(np.exp(z)).astype(float)}[kind]
    X = np.c_[np.ones(n), g, x]
    b, se = hc3(X, y) if kind == "continuous" else irls(X, y, kind)
    roles = Roles("grp", "y", "t", "c", segment="segment", covariates=("x", "k"))
    o = Options(metric_type={"continuous": "continuous", "binomial": "binary", "poisson": "count"}[kind], count_model="poisson")
    rows = analysis_rows(arms(spark, y[:180], y[180:], x=x, k=3.0), roles, covariates=("x", "k"))
    m = stage(metric_family(enough(segment_moments(rows)), rows, o))
    row = covariate_model(aligned_rows(rows, m), m, ("x", "k"), o).first()
    assert row.covariates_used == ["x"]  # the constant one is dropped
    assert row.covariate_adjusted_effect == pytest.approx(b, rel=1e-7)
    assert row.covariate_adjusted_ci_upper == pytest.approx(b + 1.959963984540054 * se, rel=1e-7)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (3, "c"), (3, "c"), (3, "c"), (4, "c"), (None, "c"), (2, "c")],
                               "id int, grp string").withColumn("y", F.lit(1.0))
    row = duplicate_units(df, Roles("grp", "y", "t", "c", customer_id="id")).first()
    assert (row.unique_units, row.total_rows, row.within_arm_repeats, row.cross_arm_units) == (4, 9, 2, 1)
    assert row.has_duplicates and "2 unit(s) appear more than once" in row.warning and "BOTH" in row.warning
    assert not duplicate_units(df, Roles("grp", "y", "t", "c")).first().is_applicable


def test_ratio_reasons_and_joint_nulls(spark):
    df = spark.createDataFrame([("s", "t", 2.0, 1.0), ("s", "t", 4.0, 2.0), ("s", "t", 9.0, None), ("s", "c", 1.0, 1.0),
                                ("s", "c", 3.0, 3.0), ("z", "t", 1.0, 0.0), ("z", "t", 1.0, 0.0), ("z", "c", 1.0, 1.0),
                                ("z", "c", 1.0, 1.0), ("n", "t", 1.0, 1.0)], "segment string, grp string, a double, b double")
    rows = {r.segment: r for r in ratio_metric(df, Roles("grp", "a", "t", "c", segment="segment"), "a", "b", "segments").collect()}
    assert rows["s"].treatment_n == 2 and rows["s"].treatment_ratio == 2.0 and rows["s"].absolute_diff == 1.0
    assert rows["s"].reason == "zero_variance" and rows["s"].p_value == 1.0
    assert rows["z"].reason == "undefined_ratio" and rows["n"].reason == "insufficient_sample_size"


def test_shapiro_published_example(spark):
    # Shapiro and Wilk (1965): weights of eleven men.
    y = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = analysis_rows(arms(spark, y, [1.0, 2.0, 4.0]), ROLES)
    got = {r.arm: r for r in shapiro_test(rows).collect()}
    assert got["t"].statistic == pytest.approx(0.7888, abs=2e-4)
    assert got["t"].p_value == pytest.approx(0.0067, abs=2e-4)
    assert got["c"].statistic == pytest.approx(0.9643, abs=1e-4)
    assert got["c"].p_value == pytest.approx(0.6369, abs=1e-4)


def test_shapiro_level(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"segment": np.repeat([f"s{i}" for i in range(200)], 60), "grp": "t", "y": rng.normal(5, 2, 12000)})
    p = [r.p_value for r in shapiro_test(analysis_rows(spark.createDataFrame(df), ROLES)).collect()]
    assert 0.01 < np.mean(np.array(p) < 0.05) < 0.10


def test_dagostino_level(spark):
    rng = np.random.default_rng(9)
    df = pd.DataFrame({"segment": np.repeat([f"s{i}" for i in range(300)], 80), "grp": "t", "y": rng.normal(5, 2, 24000)})
    p = np.array([r.p_value for r in dagostino_test(analysis_rows(spark.createDataFrame(df), ROLES)).collect()])
    assert 0.02 < np.mean(p < 0.05) < 0.10


def test_levene_and_outliers(spark):
    rng = np.random.default_rng(10)
    t, c = np.r_[rng.normal(0, 1, 99), 250.0], rng.normal(0, 1.0, 101)
    rows = analysis_rows(arms(spark, t, c), ROLES)
    m = stage(enough(segment_moments(rows)))
    sums = robust_sums(rows)
    z = [np.abs(v - np.median(v)) for v in (t, c)]
    n, k = 201, 2
    grand = np.concatenate(z).mean()
    f = (n - k) * sum(len(v) * (v.mean() - grand) ** 2 for v in z) / sum(((v - v.mean()) ** 2).sum() for v in z)
    row = levene_test(m, sums).first()
    assert row.levene_f == pytest.approx(f)
    out = outlier_sensitivity(m, sums).first()

    def winsor(v):
        s = np.sort(v); j = int(len(v) * 0.05)
        return np.clip(v, s[j], s[len(v) - j - 1]).mean()

    def trim(v):
        j = int(len(v) * 0.1)
        return np.sort(v)[j:len(v) - j].mean()

    assert out.winsorized_effect == pytest.approx(winsor(t) - winsor(c))
    assert out.trimmed_effect == pytest.approx(trim(t) - trim(c))


def test_t_posterior_meets_the_normal_one_in_large_arms(spark):
    rng = np.random.default_rng(11)
    m = enough(segment_moments(analysis_rows(arms(spark, rng.normal(1, 3, 20_000), rng.normal(0.9, 3, 15_000)), ROLES)))
    normal, t = bayesian_test(m).first(), bayesian_test(m, posterior="t").first()
    for name in ("prob_treatment_better", "expected_loss_treatment", "expected_loss_control", "credible_lower", "credible_upper"):
        assert t[f"bayesian_{name}"] == pytest.approx(normal[f"bayesian_{name}"], abs=2e-5)


@pytest.mark.parametrize("s1, v1, s2, v2", [(1, 1, 1, 1), (2, 3, 0.5, 7), (0.01, 2, 5, 4), (1, 40, 1, 9), (3, 1, 1, 500), (1, 1e8, 2, 5)])
def test_difference_of_t_variables(s1, v1, s2, v2):
    mu = 0.7 * s1
    prob, loss_t, loss_c, lo, hi = (x[0] for x in t_difference(*([x] for x in (mu, s1, v1, s2, v2))))
    if v1 == v2 == 1:  # the sum of two Cauchy variables is one
        assert prob == pytest.approx(0.5 + math.atan(mu / (s1 + s2)) / math.pi, abs=1e-10)
        assert hi - mu == pytest.approx((s1 + s2) * math.tan(0.475 * math.pi), rel=1e-9)
    rng = np.random.default_rng(1)
    d = mu + s1 * rng.standard_t(v1, 2_000_000) - s2 * rng.standard_t(v2, 2_000_000)
    assert prob == pytest.approx(np.mean(d > 0), abs=2e-3)
    assert np.mean(d < lo) == pytest.approx(0.025, abs=5e-4) and np.mean(d > hi) == pytest.approx(0.025, abs=5e-4)
    if min(v1, v2) > 2:
        assert loss_c == pytest.approx(np.mean(np.maximum(d, 0)), rel=1e-2)
        assert loss_t == pytest.approx(np.mean(np.maximum(-d, 0)), rel=2e-2)
    assert math.isnan(loss_t) == (min(v1, v2) <= 1)


def test_sequential_options_and_decisions(spark):
    assert not Sequential.resolve(None).enabled and not Sequential.resolve({"enabled": False}).enabled
    assert Sequential.resolve(True).max_looks == 1
    s = Sequential.resolve({"interim_look": 9, "planned_looks": "4", "method": "weird", "futility_p_value_threshold": 7})
    assert (s.look_index, s.max_looks, s.method, s.futility_p) == (4, 4, "obrien_fleming", 1.0)
    df = spark.createDataFrame([("a", 0.0001, 1.0, 2.0), ("b", 0.9, -1.0, 1.0), ("c", 0.3, -1.0, 1.0)],
                               "segment string, p_value double, ci_lower double, ci_upper double")
    df = df.withColumns({"inference_blocked": F.lit(False), "srm_is_mismatch": F.lit(False)})
    got = {r.segment: r for r in sequential(df, Sequential.resolve({"look_index": 3, "max_looks": 4})).collect()}
    assert [got[k].sequential_decision for k in "abc"] == ["stop_efficacy", "stop_futility", "continue"]
    assert got["a"].is_significant and not got["b"].is_significant
    last = sequential(df, Sequential.resolve({"look_index": 4, "max_looks": 4})).collect()
    assert {r.sequential_decision for r in last} == {"final_accept", "final_reject"}


def test_covariate_names(spark):
    assert parse_covariates(" a, b,a ,, ") == ("a", "b") and parse_covariates(3) == ()
    df = spark.createDataFrame([("t", 1.0, 2.0, 3.0, "k")], "grp string, y double, pre double, age double, seg string")
    roles = Roles("grp", "y", "t", "c", pre_effect="pre", segment="seg", covariates=("age", "seg", "nope", "y"))
    assert resolve_covariates(df, roles) == ("age", "pre")


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def fits(spark, df, names, **options):
    roles = Roles("grp", "y", "t", "c", segment="segment", covariates=names)
    o = Options(**options)
    rows = analysis_rows(spark.createDataFrame(df), roles, covariates=names)
    m = stage(metric_family(enough(segment_moments(rows)), rows, o))
    return {r.segment: r for r in covariate_model(aligned_rows(rows, m), m, names, o).collect()}


def trial(n, seed, y, segment="s", **columns):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(50, 9, n), (np.arange(n) % 3 == 0).astype(float)
    df = pd.DataFrame({"segment": segment, "grp": np.where(g == 1, "t", "c"), "x": x})
    df["y"] = y(rng, g, (x - 50) / 9)
    for k, f in columns.items():
        df[k] = f(rng, x)
    return df


def test_huber_with_covariates_matches_reweighting(spark):
    df = trial(700, 5, lambda r, g, x: 3 + g + 2 * x + r.standard_t(2, 700) + 5 * (r.random(700) < 0.2),
               z=lambda r, x: r.exponential(2, len(x)))
    row = fits(spark, df, ("x", "z"), metric_type="heavy_tail")["s"]
    X = np.c_[np.ones(700), df.grp == "t", df.x, df.z].astype(float)
    y, b = df.y.to_numpy(), np.linalg.lstsq(np.c_[np.ones(700), df.grp == "t", df.x, df.z].astype(float), df.y, rcond=None)[0]
    for _ in range(400):
        r = y - X @ b
        s = np.median(np.abs(r)) / 0.6744897501960817
        w = np.minimum(1, 1.345 * s / np.abs(r))
        b = np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)
    r = (y - X @ b) / s
    share = np.mean(np.abs(r) <= 1.345)
    k = 1 + 4 / 700 * (share * (1 - share)) / share**2
    se = k * np.sqrt(np.sum(np.minimum(r * r, 1.345**2)) / 696 * s * s / share**2 * np.linalg.inv(X.T @ X)[1, 1])
    assert row.covariate_adjusted_model_type == "rlm_huber" and row.covariate_model_converged
    assert row.covariate_adjusted_effect == pytest.approx(b[1], abs=1e-6)
    assert row.covariate_adjusted_ci_upper == pytest.approx(b[1] + 1.959963984540054 * se, abs=1e-5)


def test_huber_with_covariates_on_hard_shapes(spark):
    bimodal = trial(600, 6, lambda r, g, x: np.where(r.random(600) < 0.5, -10, 10) + r.normal(size=600) + g, "bimodal")
    constant = trial(600, 7, lambda r, g, x: np.where(r.random(600) < 0.7, 4.0, 4 + r.exponential(9, 600)), "constant")
    got = fits(spark, pd.concat([bimodal, constant]), ("x",), metric_type="heavy_tail")
    for row in got.values():  # settled, or the linear model with the reason
        assert row.covariate_model_converged == (row.covariate_adjusted_model_type == "rlm_huber")
        assert row.covariate_model_converged or row.covariate_model_reason == "model_fit_failed_fallback_to_ols"
        assert math.isfinite(row.covariate_adjusted_ci_lower)


def test_marginal_effect_errors_match_the_delta_method(spark):
    rate = lambda g, x: 1 / (1 + np.exp(0.4 - 0.8 * g - 0.5 * x))
    df = trial(900, 8, lambda r, g, x: (r.random(900) < rate(g, x)).astype(float))
    row = fits(spark, df, ("x",), metric_type="binary")["s"]
    X = np.c_[np.ones(900), df.grp == "t", (df.x - 50) / 9].astype(float)
    b, y = np.zeros(3), df.y.to_numpy()
    for _ in range(30):
        m = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X.T * (m * (1 - m))) @ X, X.T @ (y - m))
    cov = np.linalg.inv((X.T * (m * (1 - m))) @ X)
    one, none = X.copy(), X.copy()
    one[:, 1], none[:, 1] = 1, 0
    d1, d0 = (1 / (1 + np.exp(-Z @ b)) for Z in (one, none))
    g = np.mean((d1 * (1 - d1))[:, None] * one - (d0 * (1 - d0))[:, None] * none, axis=0)
    raw, se = y[X[:, 1] == 1].mean() - y[X[:, 1] == 0].mean(), math.sqrt(g @ cov @ g)
    assert row.average_marginal_effect_se == pytest.approx(se, rel=1e-6)
    assert row.covariate_raw_ci_lower == pytest.approx(raw - 1.959963984540054 * se, rel=1e-6)

    df["y"] = np.exp(0.3 * X[:, 1] + 0.4 * X[:, 2] + np.random.default_rng(9).normal(0, 1, 900)) - 1
    row = fits(spark, df, ("x",), metric_type="heavy_tail", heavy_tail_strategy="log_transform")["s"]
    z = np.log(df.y.to_numpy() + 1)
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ z
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    u = (z - X @ b) / (1 - h)
    cov, smear = inv @ ((X.T * u**2) @ X) @ inv, np.mean(np.exp(z - X @ b))
    g = smear * np.mean(np.exp(one @ b)[:, None] * one - np.exp(none @ b)[:, None] * none, axis=0)
    assert row.covariate_adjusted_model_type == "ols_log1p_hc3"
    assert row.average_marginal_effect_se == pytest.approx(math.sqrt(g @ cov @ g), rel=1e-6)


@pytest.mark.parametrize("kind", ["complete", "quasi", "arm", "count"])
def test_separated_segments_leave_early(spark, kind):
    outcome = {
        "complete": lambda r, g, x: (x > 0.2).astype(float),
        "quasi": lambda r, g, x: np.where(x > 1, 1.0, (r.random(len(x)) < 0.4)).astype(float) * (x > -9),
        "arm": lambda r, g, x: np.where(g == 1, 1.0, (r.random(len(x)) < 0.4)).astype(float),
        "count": lambda r, g, x: np.where(g == 1, 0.0, r.poisson(2.0, len(x)))}[kind]
    mixed = trial(600, 3, lambda r, g, x: (r.random(600) < 0.4 + 0.1 * g).astype(float) if kind != "count" else r.poisson(3.0, 600), "mixed")
    split = trial(600, 4, outcome, "split")
    if kind == "quasi":
        for df in (mixed, split):
            df["x"] = (df.x > 59).astype(float)  # one cell without other outcomes
    options = {"metric_type": "count" if kind == "count" else "binary", "count_model": "poisson"}
    alone, few = jobs_of(spark, f"alone-{kind}", lambda: fits(spark, mixed, ("x",), **options))
    both, more = jobs_of(spark, f"both-{kind}", lambda: fits(spark, pd.concat([mixed, split]), ("x",), **options))
    assert both["mixed"].covariate_adjusted_effect == pytest.approx(alone["mixed"].covariate_adjusted_effect, rel=1e-9)
    assert both["split"].covariate_model_reason == "model_fit_failed_fallback_to_ols; separated_outcomes"
    assert both["split"].covariate_adjusted_model_type == "ols_hc3"
    assert more <= few + 3 * 5  # at most three passes beyond its neighbour


def test_rare_outcomes_are_not_taken_for_separated(spark):
    df = trial(30_000, 11, lambda r, g, x: (r.random(30_000) < 1 / (1 + np.exp(7 - 0.5 * g - 1.5 * x))).astype(float))
    row = fits(spark, df, ("x",), metric_type="binary")["s"]
    assert row.covariate_adjusted_model_type == "glm_binomial" and row.covariate_model_reason == ""


def test_collinear_covariates_are_named(spark):
    df = trial(300, 12, lambda r, g, x: g + x + r.normal(size=300), double=lambda r, x: 2 * x, other=lambda r, x: r.normal(size=len(x)),
               total=lambda r, x: x * 0 + 7)
    df["mix"] = df.x - 3 * df.other
    row = fits(spark, df, ("x", "double", "other", "mix", "total"), metric_type="continuous")["s"]
    assert row.covariates_used == ["x", "other"]
    assert row.covariate_model_reason == "constant_covariates:total; collinear_covariates:double,mix"
    b, se = hc3(np.c_[np.ones(300), df.grp == "t", df.x, df.other].astype(float), df.y.to_numpy())
    assert row.covariate_adjusted_effect == pytest.approx(b, rel=1e-8)
    assert row.covariate_adjusted_ci_upper == pytest.approx(b + 1.959963984540054 * se, rel=1e-8)


def test_covariate_fit_that_cannot_settle_falls_back(spark):
    from armlift.config import Options, Roles
    from armlift.plans.analysis import analyze

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        rows.append(("split", "t" if i % 2 else "c", float(x > 0), x, 1.0))  # the covariate decides the outcome
        rows.append(("mixed", "t" if i % 2 else "c", float(rng.random() < 0.4), x, 1.0))
    df = spark.createDataFrame(rows, "segment string, grp string, y double, x double, flat double")
    out = analyze(df, Roles("grp", "y", "t", "c", segment="segment", covariates=("x", "flat")),
                  Options(diagnostics=False)).results
    got = {r.segment: r for r in out.collect()}
    assert got["mixed"].covariate_adjusted_model_type == "glm_binomial" and got["mixed"].covariate_model_converged
    assert got["split"].covariate_adjusted_model_type == "ols_hc3" and not got["split"].covariate_model_converged
    assert "fallback_to_ols" in got["split"].covariate_model_reason and abs(got["split"].covariate_adjusted_effect) < 0.2
    assert got["mixed"].covariate_model_reason == "constant_covariates:flat"
