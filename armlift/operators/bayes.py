"""Posterior comparison of the arms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.functions.guards import add
from armlift.functions.normal import cdf, pdf, z_quantile
from armlift.functions.tails import lgamma, t_quantile, t_two_sided

# Fixed values.
LARGE_ARM = 30
VARIANCE_FLOOR = 1e-10

NODES = 81          # step of the trapezoid rule 0.7 at most; its error falls as exp(-2 pi^2 / step)
NODES_LONG = 241    # for one or two degrees of freedom, whose tails reach further
FALL = 39.0        # the mixing density is cut where its logarithm has fallen by this much
SEGMENTS = 200     # at a time, each with all nodes

_POSTERIOR = "prob double, loss_t double, loss_c double, lo double, hi double, diff double"


def _t_cdf(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    tail = t_two_sided(x, v) / 2
    return np.where(x > 0, 1 - tail, tail)


def _t_density(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Density at ``x`` with one row per number of degrees of freedom in ``v``."""
    large = np.minimum(v, 1e7)  # normal to 1e-8 from there on
    norm = lgamma((large + 1) / 2) - lgamma(large / 2) - 0.5 * np.log(large * math.pi)
    return np.exp(norm - (large + 1) / 2 * np.log1p(x * x / large))


def _mixture(s1, v1, s2, v2, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and scales that make s1 T(v1) - s2 T(v2) a mixture of t variables with v1 + v2 degrees of freedom.

    The two chi-squares are their sum, which gives the common t, and its share R, a beta variable that sets the scale. R is
    taken on the logit scale, where its density has exponential tails and the trapezoid rule is exact to rounding.
    """
    peak = np.log(v1 / v2)

    def drop(x):  # of the log density below its peak; log(R) = -log(1 + exp(-x))
        return v1 / 2 * (np.logaddexp(0, -x) - np.logaddexp(0, -peak)) + v2 / 2 * (np.logaddexp(0, x) - np.logaddexp(0, peak))

    ends = []
    for sign, v in ((-1, v1), (1, v2)):
        near, far = np.zeros_like(peak), 2 * FALL / v + np.abs(peak) + 4
        for _ in range(60):
            half = (near + far) / 2
            inside = drop(peak + sign * half) < FALL
            near, far = np.where(inside, half, near), np.where(inside, far, half)
        ends.append(peak + sign * far)
    x = ends[0][:, None] + (ends[1] - ends[0])[:, None] * np.linspace(0, 1, nodes)[None, :]
    v1, v2, s1, s2, peak = (y[:, None] for y in (v1, v2, s1, s2, peak))
    weight = np.exp(-drop(x))
    scale = np.sqrt((s1 * s1 * v1 * (1 + np.exp(-x)) + s2 * s2 * v2 * (1 + np.exp(x))) / (v1 + v2))
    return weight / weight.sum(axis=1, keepdims=True), scale


def t_difference(mu, s1, v1, s2, v2, mass: float = 0.95):
    """mu + s1 T(v1) - s2 T(v2) with independent t variables: P(> 0), E(-D)+, E(D)+ and the central interval.

    Expectations are infinite, given as nan, where an arm has one degree of freedom.
    """
    given = [np.asarray(x, float) for x in (mu, s1, v1, s2, v2)]
    out = np.empty((5, len(given[0])))
    long = np.minimum(given[2], given[4]) < 3
    for some, nodes in ((long, NODES_LONG), (~long, NODES)):
        if some.any():
            out[:, some] = _integrated(*(x[some] for x in given), mass, nodes)
    return tuple(out)


def _integrated(mu, s1, v1, s2, v2, mass: float, nodes: int):
    weight, scale = _mixture(s1, v1, s2, v2, nodes)
    df = (v1 + v2)[:, None]
    freedom = np.broadcast_to(df, scale.shape)

    def below(x):  # of the centred difference
        return (weight * _t_cdf(x[:, None] / scale, freedom)).sum(axis=1)

    at = mu[:, None] / scale
    gain = at * _t_cdf(at, freedom) + _t_density(at, df) * (df + at * at) / (df - 1)
    gain = np.where(np.minimum(v1, v2) > 1, (weight * scale * gain).sum(axis=1), np.nan)
    # the distribution is symmetric: one root, near that of Welch's approximation
    level = (1 + mass) / 2
    low = np.zeros(len(mu))
    high = 1.001 * (s1 * t_quantile(level, v1) + s2 * t_quantile(level, v2))
    a, b = s1 * s1, s2 * s2
    x = np.minimum(np.sqrt(a + b) * t_quantile(level, (a + b) ** 2 / (a * a / v1 + b * b / v2)), high)
    for _ in range(80):
        gap = below(x) - level
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        slope = (weight * _t_density(x[:, None] / scale, df) / scale).sum(axis=1)
        new = x - gap / np.maximum(slope, 1e-300)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        settled = np.all(np.abs(new - x) <= 1e-9 * np.abs(x))  # the step after it is its square
        x = new
        if settled:
            break
    return below(mu), gain - mu, gain, mu - x, mu + x


def _t_posterior(posterior: str):
    @F.pandas_udf(_POSTERIOR)
    def compare(mean_t: pd.Series, se_t: pd.Series, n_t: pd.Series, mean_c: pd.Series, se_c: pd.Series,
                n_c: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=mean_t.index, columns=["prob", "loss_t", "loss_c", "lo", "hi", "diff"])
        small = (n_t <= LARGE_ARM) | (n_c <= LARGE_ARM)
        wanted = np.flatnonzero((n_t >= 2) & (n_c >= 2) & (posterior != "normal") & (small | (posterior == "t")))
        for k in range(0, len(wanted), SEGMENTS):
            i = wanted[k : k + SEGMENTS]
            mu = (mean_t - mean_c).to_numpy()[i]
            found = t_difference(mu, se_t.to_numpy()[i], n_t.to_numpy()[i] - 1, se_c.to_numpy()[i], n_c.to_numpy()[i] - 1)
            out.iloc[i] = np.column_stack([*found, mu])
        return out.astype(object).where(out.notna(), None)

    return compare


def bayesian_test(m: DataFrame, posterior: str = "by_size") -> DataFrame:
    """Probability, expected losses, 95% interval, uplift and total effect.

    On changes (post - pre) when pre data is used, else on the outcome. The
    normal posterior is column arithmetic, the t posterior (the difference of two
    t variables) is integrated numerically; nothing is drawn. ``by_size`` takes
    the normal one where both arms have more than 30 units. An arm of two units
    has a t posterior without mean: its expected losses are null.
    """
    m = add(
        m,
        _mt="CASE WHEN has_pre THEN dmean_t ELSE mean_t END", _mc="CASE WHEN has_pre THEN dmean_c ELSE mean_c END",
        _vt="CASE WHEN has_pre THEN dvar_t ELSE var_t END", _vc="CASE WHEN has_pre THEN dvar_c ELSE var_c END",
        _exact={"normal": "true", "t": "false"}.get(posterior, f"n_t > {LARGE_ARM} AND n_c > {LARGE_ARM}"))
    m = add(
        m, _mu="_mt - _mc",
        _st=f"sqrt(greatest(_vt, {VARIANCE_FLOOR}D) / greatest(n_t, 1))", _sc=f"sqrt(greatest(_vc, {VARIANCE_FLOOR}D) / greatest(n_c, 1))",
        _case="""CASE WHEN n_t < 2 OR n_c < 2 THEN 'short' WHEN _vt = 0 AND _vc = 0 THEN 'fixed'
            WHEN _exact THEN 'exact' ELSE 't' END""")
    m = m.withColumn("_t", _t_posterior(posterior)(
        *[F.col(x).cast("double") for x in ("_mt", "_st", "n_t", "_mc", "_sc", "n_c")]))
    m = add(m, _sd="sqrt(_st * _st + _sc * _sc)")
    m = add(m, _r="_mu / _sd")
    m = add(m, _below=cdf("(-_r)"))
    m = add(m, _loss=f"_sd * {pdf('_r')} - _mu * _below")
    z = f"{z_quantile(0.975)!r}D"

    def choose(short: str, fixed: str, exact: str, integrated: str) -> str:
        return (f"CASE _case WHEN 'short' THEN {short} WHEN 'fixed' THEN {fixed} "
                f"WHEN 'exact' THEN {exact} ELSE _t.{integrated} END")

    m = add(
        m,
        bayesian_prob_treatment_better=choose("0.5D", "(1 + signum(_mu)) / 2", "1 - _below", "prob"),
        bayesian_expected_loss_treatment=choose("0D", "greatest(-_mu, 0D)", "_loss", "loss_t"),
        bayesian_expected_loss_control=choose("0D", "greatest(_mu, 0D)", "_loss + _mu", "loss_c"),
        bayesian_credible_lower=choose("0D", "_mu", f"_mu - {z} * _sd", "lo"),
        bayesian_credible_upper=choose("0D", "_mu", f"_mu + {z} * _sd", "hi"),
        _diff=choose("0D", "_mu", "_mu", "diff"),
        # On the change scale a vanishing control change falls back to the control level.
        _base=f"""CASE WHEN _case = 'fixed' OR NOT has_pre THEN _mc
            WHEN abs(_mc) < {VARIANCE_FLOOR}D THEN abs(mean_c) ELSE abs(_mc) END""")
    m = add(
        m,
        bayesian_relative_uplift="CASE WHEN _base <> 0 THEN _diff / _base ELSE 0D END",
        bayesian_total_effect="_diff * rows_t",
        bayesian_total_effect_per_customer="CASE WHEN rows_t > 0 THEN _diff ELSE 0D END",
        bayesian_is_significant="bayesian_prob_treatment_better > 0.95 OR bayesian_prob_treatment_better < 0.05")
    return m.drop("_mt", "_mc", "_vt", "_vc", "_exact", "_mu", "_st", "_sc", "_case", "_t", "_sd", "_r",
                  "_below", "_loss", "_diff", "_base")
