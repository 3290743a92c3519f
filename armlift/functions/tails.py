"""Student-t, F and non-central t on Arrow batches of segment rows.

The batches hold one row per segment (never raw data), so Python sees only a
handful of sufficient statistics; Spark decides how they are partitioned.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlift.functions.normal import TAIL_DENOMINATOR, TAIL_NUMERATOR, TAIL_SPLIT

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(160)
SERIES_DF = 200  # from here the quantile series is accurate to 1e-10
INTEGRAL_DF = 1000  # from here the t tail is integrated; below, the incomplete beta is as exact


def lgamma(x):
    x = np.asarray(x, dtype=float)
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def phi(x):
    """Normal CDF on arrays."""
    a = np.minimum(np.abs(x), 38.0)
    near = np.polyval(TAIL_NUMERATOR, a) / np.polyval(TAIL_DENOMINATOR, a)
    far = 1.0 / (math.sqrt(2 * math.pi) * (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))))
    tail = np.exp(-a * a / 2.0) * np.where(a < TAIL_SPLIT, near, far)
    return np.where(x > 0, 1.0 - tail, tail)


def incomplete_beta(a, b, x, steps: int = 600):
    """Regularised incomplete beta, continued fraction by modified Lentz."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    inner = np.clip(y, 1e-300, 1.0)
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(inner)
                       + q * np.log1p(-np.minimum(inner, 1.0 - 1e-16))) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1.0 - (p + q) * y / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for coef in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    value = np.where(y <= 0.0, 0.0, front * h)
    return np.where(swap, 1.0 - value, value)


def t_two_sided(t, df):
    """P(|T| > |t|)."""
    t, df = np.abs(np.asarray(t, dtype=float)), np.maximum(np.asarray(df, dtype=float), 1e-3)
    t, df = np.broadcast_arrays(t, df)
    out = np.empty(t.shape)
    large = df >= INTEGRAL_DF
    small, at = df[~large], t[~large]
    out[~large] = incomplete_beta(small / 2.0, 0.5, small / (small + at * at))
    out[large] = 2.0 * _upper_tail_integral(t[large], np.minimum(df[large], 1e18))
    return out


def _upper_tail_integral(t, v):
    """P(T > t) at large df: density at t times the integral of its decay, which never cancels."""
    x = v / 2.0
    # log(gamma(x + 1/2) / gamma(x)) - log(x) / 2
    ratio = -1 / (8 * x) + 1 / (192 * x**3) - 1 / (640 * x**5)
    density = np.exp(ratio - (v + 1) / 2 * np.log1p(t * t / v)) / math.sqrt(2 * math.pi)
    far = (v + t * t) * np.expm1(90.0 / (v + 1))  # the decay is exp(-45) where (t + s)^2 = t^2 + far
    reach = far / (t + np.sqrt(t * t + far))
    s = reach[:, None] / 2 * (_NODES[None, :] + 1)
    decay = np.exp(-(v[:, None] + 1) / 2 * np.log1p(s * (2 * t[:, None] + s) / (v + t * t)[:, None]))
    return density * (decay * _WEIGHTS[None, :]).sum(axis=1) * reach / 2


def t_quantile(p: float, df):
    """Upper quantile (p > 0.5): Cornish-Fisher series, Newton polish at small df."""
    df = np.asarray(df, dtype=float)
    v = np.maximum(df, 1e-2)
    z = NormalDist().inv_cdf(p)
    series = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) \
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3) \
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v**4)
    small = v < SERIES_DF
    if not small.any():
        return series
    out = series.copy()
    out[small] = _t_quantile_small(p, v[small], series[small])
    return out


def _t_quantile_small(p: float, v, start):
    lo, hi = np.zeros_like(v), np.maximum(start, 1.0)
    for _ in range(200):  # grow the bracket for heavy-tailed small df
        short = t_two_sided(hi, v) / 2.0 > 1.0 - p
        if not short.any():
            break
        hi = np.where(short, hi * 2.0, hi)
    x = np.where((start > lo) & (start < hi), start, (lo + hi) / 2.0)
    log_norm = lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * np.log(v * math.pi)
    for _ in range(60):
        gap = t_two_sided(x, v) / 2.0 - (1.0 - p)
        lo, hi = np.where(gap > 0, x, lo), np.where(gap > 0, hi, x)
        dens = np.exp(log_norm - (v + 1) / 2 * np.log1p(x * x / v))
        step = x + gap / np.maximum(dens, 1e-300)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2.0)
        done = np.all(np.abs(new - x) <= 1e-12 * np.maximum(1.0, np.abs(x)))
        x = new
        if done:
            break
    return x


def two_sample_power(d, n1, n2, alpha: float, crit=None):
    """Power of the two-sided two-sample t-test, by quadrature over the scale."""
    d, n1, n2 = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(d, n1, n2))
    df = np.maximum(n1 + n2 - 2.0, 1e-2)
    shift = np.abs(d) * np.sqrt(n1 * n2 / (n1 + n2))
    crit = t_quantile(1.0 - alpha / 2.0, df) if crit is None else crit
    v = np.minimum(df, 1e12)  # the scale is 1 to 1e-6 from there on, and the power no longer moves
    spread = 1.0 / np.sqrt(2.0 * v)
    low, high = np.maximum(1e-12, 1.0 - 12.0 * spread), 1.0 + 14.0 * spread
    half, mid = (high - low) / 2.0, (high + low) / 2.0
    s = mid[:, None] + half[:, None] * _NODES[None, :]
    vv = v[:, None]
    log_g = (math.log(2.0) + (vv / 2) * np.log(vv / 2) - lgamma(vv / 2)
             + (vv - 1) * np.log(s) - vv * s * s / 2)
    reach = phi(shift[:, None] - crit[:, None] * s) + phi(-shift[:, None] - crit[:, None] * s)
    total = (reach * np.exp(log_g) * _WEIGHTS[None, :]).sum(axis=1) * half
    return np.clip(total, 0.0, 1.0)


def _root(power_at, guess, floor, target: float):
    """Smallest argument reaching the target power, by bracketing and bisection."""
    lo, hi = np.maximum(guess * 0.5, floor), np.maximum(guess * 1.5, floor * 2)
    for _ in range(200):
        high = power_at(lo) >= target
        if not (high & (lo > floor)).any():
            break
        lo = np.where(high, np.maximum(lo / 2.0, floor), lo)
    for _ in range(200):
        short = power_at(hi) < target
        if not short.any():
            break
        hi = np.where(short, hi * 2.0, hi)
    for _ in range(60):
        if np.all(hi - lo <= 1e-12 * hi):
            break
        mid = (lo + hi) / 2.0
        short = power_at(mid) < target
        lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
    return hi


def solve_n(d, ratio, alpha: float, power: float):
    """Smallest real n1 with n2 = ratio * n1 that reaches the power."""
    d, ratio = np.broadcast_arrays(np.abs(np.asarray(d, float)), np.asarray(ratio, float))
    reach = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    guess = reach**2 * (1.0 + 1.0 / ratio) / d**2
    floor = (2.0 + 1e-9) / (1.0 + ratio)  # degrees of freedom stay positive
    return _root(lambda n: two_sample_power(d, n, n * ratio, alpha), guess, floor, power)


def solve_effect(n1, n2, alpha: float, power: float):
    """Smallest standardised effect detectable with the given arm sizes."""
    n1, n2 = np.broadcast_arrays(np.asarray(n1, float), np.asarray(n2, float))
    reach = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    guess = reach * np.sqrt(1.0 / n1 + 1.0 / n2)
    crit = t_quantile(1.0 - alpha / 2.0, n1 + n2 - 2.0)
    return _root(lambda d: two_sample_power(d, n1, n2, alpha, crit), guess, np.full(n1.shape, 1e-12), power)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value, null in gives null out."""

    @F.pandas_udf(T.DoubleType())
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index, dtype=float)
        if ok.any():
            out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.where(ok, None)

    return tail(t.cast("double"), df.cast("double"))


def t_critical(p: float, df: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        ok = df.notna()
        out = pd.Series(np.nan, index=df.index, dtype=float)
        if ok.any():
            out[ok] = t_quantile(p, df[ok].to_numpy())
        return out.where(ok, None)

    return quantile(df.cast("double"))


def power_of(d: Column, n1: Column, n2: Column, alpha: float) -> Column:
    """Achieved power; 0 for no effect or an arm of one unit or less."""

    @F.pandas_udf(T.DoubleType())
    def achieved(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        ok = d.notna() & (d != 0) & (n1 > 1) & (n2 > 1)
        out = pd.Series(0.0, index=d.index, dtype=float)
        if ok.any():
            out[ok] = two_sample_power(d[ok].to_numpy(), n1[ok].to_numpy(), n2[ok].to_numpy(), alpha)
        return out

    return achieved(d.cast("double"), n1.cast("double"), n2.cast("double"))


# Fixed value: the answer for "no effect to detect".
UNREACHABLE_N = 1_000_000_000


def required_n_of(d: Column, ratio: Column, alpha: float, power: float) -> Column:
    """Units per treatment arm for the target power."""

    @F.pandas_udf(T.LongType())
    def needed(d: pd.Series, ratio: pd.Series) -> pd.Series:
        ok = d.notna() & (d != 0) & (ratio > 0)
        out = pd.Series(UNREACHABLE_N, index=d.index, dtype="int64")
        if ok.any():
            solved = solve_n(d[ok].to_numpy(), ratio[ok].to_numpy(), alpha, power)
            out[ok] = np.ceil(np.minimum(solved, 9e18) - 1e-9).astype("int64")
        return out

    return needed(d.cast("double"), ratio.cast("double"))


def detectable_effect_of(n1: Column, n2: Column, alpha: float, power: float) -> Column:
    @F.pandas_udf(T.DoubleType())
    def smallest(n1: pd.Series, n2: pd.Series) -> pd.Series:
        ok = (n1 > 1) & (n2 > 1)
        out = pd.Series(0.0, index=n1.index, dtype=float)
        if ok.any():
            out[ok] = solve_effect(n1[ok].to_numpy(), n2[ok].to_numpy(), alpha, power)
        return out

    return smallest(n1.cast("double"), n2.cast("double"))
