"""Two-arm models that need the rows: robust and log fits.

Each pass is one grouped aggregation over all segments.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.operators.order_stats import LINEAR_STEPS, log_bucket
from armlift.session import attach, stage

# Fixed values of the robust fit.
HUBER_T = 1.345
MAD_SCALE = 0.6744897501960817
ZONE_REACH = 0.02
REACH_STEP = 0.05
SMALL_ZONE = 20_000
FLAT = 1e-9          # of the spread of all values
MAX_STEPS = 500      # of the fixed point on buckets; a fit beyond is given up
MAX_NARROWINGS = 20  # of the boundary buckets, likewise


# --- Huber location shift of two arms -------------------------------------------------

_FIT = ("segment string, kind string, arm string, b bigint, lo double, hi double, cnt bigint, "
        "mu_t double, mu_c double, scale double, psi2 double, inner double, n double, settled boolean")


def _weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(v, kind="stable")
    cum = np.cumsum(w[order])
    n = cum[-1]
    low = v[order][np.searchsorted(cum, (n + 1) // 2)]
    high = v[order][np.searchsorted(cum, n // 2 + 1)]
    return float((low + high) / 2.0)


def _huber_on_buckets(pdf: pd.DataFrame, reach: float = ZONE_REACH) -> pd.DataFrame:
    """Joint fixed point of arm locations and MAD scale on (count, mean) buckets.

    Reports the buckets that still straddle a clipping or median boundary, or lie
    within ``reach`` scales of one.
    """
    seg = pdf["segment"].iloc[0]
    arm = pdf["arm"].to_numpy() == "t"
    cnt = pdf["cnt"].to_numpy(dtype=float)
    mean, m2 = pdf["mean"].to_numpy(), pdf["m2"].to_numpy()
    lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
    bucket = pdf["b"].to_numpy()
    mu = np.array([np.average(mean[~arm], weights=cnt[~arm]), np.average(mean[arm], weights=cnt[arm])])
    centre = mu[arm.astype(int)]
    scale = _weighted_median(np.abs(mean - centre), cnt) / MAD_SCALE
    spread = float(np.sqrt((m2 + cnt * (mean - np.average(mean, weights=cnt)) ** 2).sum() / cnt.sum()))
    settled = False
    for _ in range(MAX_STEPS):
        if scale <= FLAT * spread:  # over half of the residuals vanish, but for rounding
            scale = 0.0
            break
        clip = HUBER_T * scale
        r = mean - centre
        mid = np.abs(r) <= clip
        new = mu.copy()
        for a in (0, 1):
            here = arm == bool(a)
            inside = here & mid
            n_in = cnt[inside].sum()
            push = cnt[here & (r > clip)].sum() - cnt[here & (r < -clip)].sum()
            if n_in > 0:
                new[a] = ((cnt * mean)[inside].sum() + clip * push) / n_in
        centre = new[arm.astype(int)]
        fresh = _weighted_median(np.abs(mean - centre), cnt) / MAD_SCALE
        moved = max(np.max(np.abs(new - mu)), abs(fresh - scale))
        mu, scale = new, fresh
        if moved <= 1e-12 * max(1.0, scale):
            settled = True
            break
    r = mean - centre
    clip = HUBER_T * scale
    mid = np.abs(r) <= clip
    psi2 = inner = 0.0
    if scale > 0:
        psi2 = float((m2 + cnt * r * r)[mid].sum() / scale**2 + HUBER_T**2 * cnt[~mid].sum())
        inner = float(cnt[mid].sum())
    fit = (seg, "fit", None, None, None, None, None, mu[1], mu[0], scale, psi2, inner, cnt.sum(), settled)
    rows = [fit]
    gap = reach * scale + 1e-12
    for edge in (clip, MAD_SCALE * scale):
        for sign in (-1.0, 1.0):
            at = centre + sign * edge
            for i in np.nonzero((lo < hi) & (lo - gap <= at) & (at <= hi + gap))[0]:
                rows.append((seg, "zone", "t" if arm[i] else "c", int(bucket[i]), lo[i], hi[i], int(cnt[i])) + (None,) * 7)
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _FIT.split(", ")])


def huber_shift(rows: DataFrame) -> DataFrame:
    """Huber location shift (MAD scale) per segment, with its H1 standard error.

    The rows are condensed map-side into value buckets of (count, mean, spread):
    a clipped row adds only a count and an unclipped one only to a sum, so buckets
    away from the clip and median boundaries are exact. Boundary buckets are split
    and re-read until they are single values; two or three scans in all, instead
    of one scan (and one median) per iteration. ``fit_converged`` is true where the
    fixed point settled on buckets none of which straddles a boundary; otherwise, and
    where more than half of the rows agree (scale 0), there is no effect.
    """
    keys = ["segment", "arm"]
    data = rows.select(*keys, "y")
    y = F.col("y")

    def condensed(by: list[Column | str], source: DataFrame) -> DataFrame:
        return source.groupBy(*by).agg(
            F.count(F.lit(1)).alias("cnt"), F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("m2"), F.min(y).alias("lo"), F.max(y).alias("hi"))

    data = data.withColumn("b", log_bucket(y).cast("bigint"))
    out_cols = [*keys, "b", "lo", "hi", "cnt", "mean", "m2"]
    buckets = stage(condensed([*keys, "b"], data).select(*out_cols))
    unsettled = None
    for step in range(MAX_NARROWINGS):
        # the boundaries settle, so the strip around them that is read again narrows
        solve = partial(_huber_on_buckets, reach=ZONE_REACH * REACH_STEP**step)
        solved = stage(buckets.groupBy("segment").applyInPandas(solve, _FIT))
        zones = solved.where("kind = 'zone'").select(*keys, "b", "lo", "hi", "cnt").distinct()
        zones = stage(zones)
        if zones.isEmpty():
            break
        # a row meets the zones of its own bucket only, and lies in one of them at most
        edge = zones.select(*keys, "b", F.col("lo").alias("z_lo"), F.col("hi").alias("z_hi"), F.col("cnt").alias("z_cnt"))
        inside = attach(data, edge, [*keys, "b"]).where(y.between(F.col("z_lo"), F.col("z_hi")))
        share = (y - F.col("z_lo")) / (F.col("z_hi") - F.col("z_lo"))
        piece = F.when(F.col("z_cnt") <= SMALL_ZONE, y).otherwise(F.floor(share * LINEAR_STEPS).cast("double"))
        fine = condensed([*keys, "b", "z_lo", "z_hi", piece.alias("piece")], inside).select(*out_cols)
        kept = buckets.join(zones.drop("cnt"), [*keys, "lo", "hi"], "left_anti")
        buckets = stage(kept.select(*out_cols).unionByName(fine))
    else:
        unsettled = zones.select("segment", F.lit(False).alias("exact")).distinct()
    fit = solved.where("kind = 'fit'").withColumn("exact", F.lit(True))
    if unsettled is not None:
        fit = fit.drop("exact").join(unsettled, "segment", "left")
    fit = fit.withColumn("fit_converged", F.col("settled") & F.coalesce("exact", F.lit(True)) & (F.col("scale") > 0))
    sizes = buckets.groupBy("segment").agg(
        F.sum(F.when(F.col("arm") == "t", F.col("cnt"))).alias("k_t"),
        F.sum(F.when(F.col("arm") == "c", F.col("cnt"))).alias("k_c"))
    c = F.col
    share = F.nullif(c("inner") / c("n"), F.lit(0.0))
    k = 1 + 2.0 / c("n") * (share * (1 - share)) / (share * share)
    var = k * k * (c("psi2") / F.nullif(c("n") - 2, F.lit(0.0)) * c("scale") * c("scale")) / (share * share) * (1 / c("k_t") + 1 / c("k_c"))
    return fit.join(sizes, "segment").select(
        "segment", F.when(c("fit_converged"), c("mu_t") - c("mu_c")).alias("fit_effect"),
        F.when(c("fit_converged"), F.sqrt(var)).alias("fit_se"), F.lit(None).cast("double").alias("fit_raw_se"),
        F.lit("rlm_huber").alias("fit_type"), c("scale").alias("fit_scale"), "fit_converged")


def log_shift(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Difference of mean logs with HC3 errors and Duan's smearing for the raw scale."""
    c = F.col
    plan = moments.select("segment", "mean_t", "mean_c", "n_t", "n_c", F.when(
        c("min") <= -1.0, F.abs("min") + 1.0).otherwise(1.0).alias("shift"))
    plan = stage(plan)
    logs = attach(rows.select("segment", "arm", "y"), plan.select("segment", "shift"), ["segment"])
    v = F.log(c("y") + c("shift"))
    agg = logs.groupBy("segment").agg(*[
        e for a in "tc" for e in (
            F.avg(F.when(c("arm") == a, v)).alias(f"l_{a}"),
            F.var_samp(F.when(c("arm") == a, v)).alias(f"lv_{a}"))])
    out = agg.join(plan, "segment")
    out = out.withColumns({f"s_{a}": c(f"lv_{a}") / F.nullif(c(f"n_{a}") - 1, F.lit(0)) for a in "tc"})
    # The mean of exp(residual) needs no second pass: exp(log(y + s)) = y + s.
    smear = sum(
        (c(f"n_{a}") * (c(f"mean_{a}") + c("shift")) * F.exp(-c(f"l_{a}")) for a in "tc"), F.lit(0.0)
    ) / (c("n_t") + c("n_c"))
    raw = smear * F.sqrt(F.exp(2 * c("l_t")) * c("s_t") + F.exp(2 * c("l_c")) * c("s_c"))
    return out.select(
        "segment", (c("l_t") - c("l_c")).alias("fit_effect"), F.sqrt(c("s_t") + c("s_c")).alias("fit_se"),
        raw.alias("fit_raw_se"), F.lit("ols_log1p_hc3").alias("fit_type"), smear.alias("fit_scale"))
