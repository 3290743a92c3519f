"""Treatment effects adjusted for covariates, one model per segment, all segments together.

One scan gives centred cross products, and with them the linear model of every segment. Fits that iterate read the rows
of open segments only: each pass is one grouped aggregation whose sums hold all that the next step needs, and a small
staged table with a row per segment says where each fit stands.

* GLM: Newton steps on the log-likelihood, summed in the same pass; a step that lowers it is halved. A direction along
  which no row's likelihood falls has no maximum: such a segment is separated and leaves at once.
* Huber: residuals go into a histogram of sizes with the cross products of each bucket, fine around the median and the
  clipping point of the last pass. So one pass gives the scale (median), the clipped score and the matrix of the step,
  with the strips narrowing until both are exact to the stopping tolerance.
* The last scan takes errors: HC3 meat, information at the solution, robust sums, gradient of the marginal effect.

Covariates that are constant, or a combination of earlier ones, are left out and named in the reason.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.config import Options
from armlift.functions.guards import VARIANCE_EPSILON, sanitize_p, zero_if_tiny
from armlift.functions.normal import two_sided, z_quantile
from armlift.operators.families import OVERDISPERSION
from armlift.operators.models import HUBER_T, MAD_SCALE
from armlift.session import BROADCAST_BYTES, BROADCAST_ROWS, attach, stage

COLLINEAR = 1e-10        # share of a column's variance that earlier columns must leave
MAX_PASSES = 30
MAX_HALVINGS = 25
NEWTON_STOP = 1e-6       # the step after this one is its square
SEPARATING = 1e-3        # a direction may fail a row by this share of its largest effect
HUBER_STOP = 1e-7        # of the scale
STRIP_STEPS = 1024       # buckets of the strips around median and clipping point
COARSE_STEPS = 32        # buckets per e-fold elsewhere
FIRST_STRIP = 0.5
GLM = ("binomial", "poisson", "nb")

c = F.col


def _triangle(values, p: int) -> np.ndarray:
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = values
    return a + np.triu(a, 1).T


def independent(corr: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Columns that earlier ones do not determine, by a Cholesky factor that grows column by column."""
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for j in np.flatnonzero(usable):
        row = np.linalg.solve(factor, corr[kept, j]) if kept else np.zeros(0)
        rest = corr[j, j] - row @ row
        if rest > COLLINEAR:
            factor = np.block([[factor, np.zeros((len(kept), 1))], [row[None, :], np.array([[np.sqrt(rest)]])]])
            kept.append(j)
    out = np.zeros(len(usable), bool)
    out[kept] = True
    return out


def _ordinary(p: int):
    """Linear model from means and covariances of (arm, covariates, target), on standardised covariates.

    ``scale`` is null for a covariate that is left out; its column is 0 in every later pass.
    """
    q = p - 1

    @F.pandas_udf("beta array<double>, inverse array<double>, scale array<double>, spread double")
    def solve(n: pd.Series, centre: pd.Series, cross: pd.Series, varies: pd.Series) -> pd.DataFrame:
        out = []
        for rows, mean, cov, moves in zip(n, centre, cross, varies, strict=True):
            a, mean = _triangle(np.asarray(cov, float), q + 1), np.asarray(mean, float)
            sd = np.sqrt(np.maximum(np.diag(a)[:q], 0.0))
            usable = np.r_[sd[0] > 0, np.asarray(moves, bool)] & (sd > 0)
            if not np.all(np.isfinite(a)) or not usable[0]:
                out.append((None, None, [None] * (q - 1), None))
                continue
            safe = np.where(sd > 0, sd, 1.0)
            live = independent(a[:q, :q] / np.outer(safe, safe), usable)
            unit = np.r_[1.0, np.where(live, safe, 1.0)[1:]]  # the arm keeps its 0 and 1
            m = np.zeros((p, p))
            m[0, 0], m[0, 1], m[1, 0] = 1.0, mean[0], mean[0]
            m[1:, 1:] = np.where(np.outer(live, live), a[:q, :q] / np.outer(unit, unit), 0.0)
            m[1, 1] += mean[0] ** 2
            at = np.ix_(np.r_[True, live], np.r_[True, live])
            inverse = np.zeros((p, p))
            inverse[at] = np.linalg.inv(m[at]) / rows
            slopes = np.zeros(q)
            slopes[live] = np.linalg.solve(a[:q, :q][np.ix_(live, live)], a[:q, q][live]) * unit[live]
            beta = np.r_[mean[q] - slopes[0] * mean[0], slopes]
            rest = a[q, q] - a[:q, q][live] @ (slopes[live] / unit[live])
            out.append((beta.tolist(), inverse.ravel().tolist(), [float(s) if ok else None for s, ok in zip(
                unit[1:], live[1:])], float(np.sqrt(max(rest, 0.0)))))
        return pd.DataFrame(out, columns=["beta", "inverse", "scale", "spread"])

    return solve


def _solve_live(m: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Solution on the columns that are in the model (others are 0 throughout); none if that fails."""
    live = np.diag(m) > 0
    out = np.zeros(len(v))
    if not live[:2].all():
        return None
    d = np.sqrt(np.diag(m)[live])
    try:
        out[live] = np.linalg.solve(m[np.ix_(live, live)] / np.outer(d, d), v[live] / d) / d
    except np.linalg.LinAlgError:
        return None
    return out if np.all(np.isfinite(out)) else None


def _newton(p: int):
    """Where the fit of a segment goes after a pass at ``beta``, which was reached by ``step``."""
    @F.pandas_udf("beta array<double>, step array<double>, best double, move double, tries int, status string")
    def update(beta: pd.Series, step: pd.Series, best: pd.Series, move: pd.Series, tries: pd.Series, passes: pd.Series,
               xx: pd.Series, score: pd.Series, ll: pd.Series, margin: pd.Series, along: pd.Series,
               reach: pd.Series) -> pd.DataFrame:
        out = []
        for b, d, top, was, k, n, m, g, now, sure, least, most in zip(
                beta, step, best, move, tries, passes, xx, score, ll, margin, along, reach, strict=True):
            b, d = np.asarray(b, float), np.asarray(d, float)
            if not np.isfinite(now) or now < top - 1e-9 * (1 + abs(top)):
                status = "open" if k < MAX_HALVINGS else "stuck"
                out.append((b - d / 2, d / 2, top, was, k + 1, status))
                continue
            new = _solve_live(_triangle(np.asarray(m, float), p), np.asarray(g, float))
            if new is None:
                out.append((b, d, now, was, k, "stuck"))
                continue
            size = float(np.max(np.abs(new) / (1 + np.abs(b))))
            status = "open"
            if size < NEWTON_STOP:
                status = "done"
            elif sure > 0 or (n >= 2 and size > 0.5 * was and least >= -SEPARATING * most):
                status = "separated"
            out.append((b + new, new, now, size, 0, status))
        return pd.DataFrame(out, columns=["beta", "step", "best", "move", "tries", "status"])

    return update


def huber_step(hist: pd.DataFrame, p: int) -> tuple[float, float, np.ndarray | None, float]:
    """Scale, its precision, Newton's step and the size of the score, from a histogram of residual sizes.

    The median and the clipping point lie in one bucket each; both are as exact as these buckets are narrow. The scale
    moves with the coefficients as the rows at the median do, which the matrix of the step takes in.
    """
    hist = hist.sort_values("mean")
    n, mean, lo, hi = (hist[x].to_numpy(float) for x in ("n", "mean", "lo", "hi"))
    xx, xr, xs = (np.array(hist[x].tolist(), float) for x in ("xx", "xr", "xs"))
    cum = np.cumsum(n)
    total = int(cum[-1])
    ranks = np.array([(total + 1) // 2, total // 2 + 1])
    middle = np.searchsorted(cum, ranks)
    # the first and the last value of a bucket are known, those between by their place
    place = (ranks - 1 - (cum - n)[middle]) / np.maximum(n[middle] - 1, 1)
    scale = (lo[middle] + place * (hi - lo)[middle]).mean() / MAD_SCALE
    clip = HUBER_T * scale
    inside = mean <= clip
    blur = max([*(hi - lo)[middle] * ((place > 0) & (place < 1)), hi[inside].max(initial=0.0) - clip,
                clip - lo[~inside].min(initial=np.inf)])
    clipped = xs[~inside].sum(axis=0)
    score = xr[inside].sum(axis=0) + clip * clipped
    at_median = (xs[middle] / n[middle][:, None]).mean(axis=0)
    plain = _triangle(xx[inside].sum(axis=0), p)
    step = _solve_live(plain + HUBER_T / MAD_SCALE * np.outer(clipped, at_median), score)
    if step is None:
        step = _solve_live(_triangle(xx.sum(axis=0), p), score)
    return scale, blur, step, float(np.max(np.abs(score)) / total)


def _huber_update(p: int):
    """Next coefficients of one segment; steps are damped while the score does not fall."""
    def update(hist: pd.DataFrame) -> pd.DataFrame:
        at = hist.iloc[0]
        beta = at[[f"beta_{i}" for i in range(p)]].to_numpy(float)
        scale, blur, step, size = huber_step(hist, p)
        strip, damping, status = 1.0, 1.0, "stuck"
        if scale > 0 and step is not None:
            damping = min(1.0, 2 * at["damping"]) if size < at["size"] else max(0.125, at["damping"] / 2)
            step = damping * step
            move = float(np.max(np.abs(step)))
            strip = min(FIRST_STRIP, max(4 * (move / scale + abs(scale / at["robust"] - 1) + blur / scale), 1e-9))
            status = "done" if move < HUBER_STOP * scale and blur < HUBER_STOP * scale else "open"
            beta = beta + step
        fixed = [at[[f"{name}_{i}" for i in range(k)]].to_numpy(float) for name, k in (("centre", p), ("scale", p - 2))]
        fixed[1] = [None if np.isnan(x) else x for x in fixed[1]]
        return pd.DataFrame([(at["segment"], beta, *fixed, scale, strip, size, damping, status)], columns=HUBER_STATE)

    return update


HUBER_STATE = ["segment", "beta", "centre", "scale", "robust", "strip", "size", "damping", "status"]
_HUBER = ("segment string, beta array<double>, centre array<double>, scale array<double>, robust double, strip double, "
          "size double, damping double, status string")


def _errors(p: int):
    """Variance of the treatment coefficient and of the average marginal effect."""
    @F.pandas_udf("coefficient double, marginal double")
    def variances(model: pd.Series, inverse: pd.Series, meat: pd.Series, info: pd.Series, gradient: pd.Series,
                  smear: pd.Series) -> pd.DataFrame:
        out = []
        for kind, inv, m, w, g, s in zip(model, inverse, meat, info, gradient, smear, strict=True):
            try:
                if kind in GLM:
                    whole = _triangle(np.asarray(w, float), p)
                    live = np.diag(whole) > 0
                    v = np.zeros((p, p))
                    v[np.ix_(live, live)] = np.linalg.inv(whole[np.ix_(live, live)])
                else:
                    a = np.asarray(inv, float).reshape(p, p)
                    v = a @ _triangle(np.asarray(m, float), p) @ a
            except (TypeError, ValueError, np.linalg.LinAlgError):
                out.append((None, None))
                continue
            g = np.asarray(g, float) * (s if kind == "log" else 1.0)
            out.append((v[1, 1], g @ v @ g if kind in (*GLM, "log") else None))
        return pd.DataFrame(out, columns=["coefficient", "marginal"], dtype=float)

    return variances


def _cross(xs: list[Column], w: Column) -> list[Column]:
    return [F.sum(w * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]


def _models(m: DataFrame, options: Options) -> DataFrame:
    """The model of each segment and the shift that keeps logs defined."""
    over = (c("mean_all") > VARIANCE_EPSILON) & (c("var_all") > OVERDISPERSION * c("mean_all"))
    wants_nb = {"negative_binomial": F.lit(True), "auto": over}.get(options.count_model, F.lit(False))
    fixed = (c("var_t") <= VARIANCE_EPSILON) & (c("var_c") <= VARIANCE_EPSILON)
    robust = "huber" if options.heavy_tail_strategy != "log_transform" else "log"
    model = (
        F.when(fixed | (c("n_t") < 2) | (c("n_c") < 2), "none")
        .when((c("metric_type") == "binary") & (c("mean_all") > 0) & (c("mean_all") < 1), "binomial")
        .when((c("metric_type") == "count") & (c("mean_all") > 0) & wants_nb, "nb")
        .when((c("metric_type") == "count") & (c("mean_all") > 0), "poisson")
        .when(c("metric_type") == "heavy_tail", robust)
        .otherwise("ols")
    )
    shift = F.when(c("min") <= -1.0, F.abs("min") + 1.0).otherwise(1.0)
    return m.select("segment", model.alias("model"), shift.alias("shift")).where(c("model") != "none")


class _Design:
    """Rows of some segments with their state and the columns of the model."""

    def __init__(self, rows: DataFrame, k: int, segments: int):
        self.rows, self.k, self.p = rows, k, k + 2
        # a state row holds a few arrays of p numbers and one of p * p
        self.near = segments <= BROADCAST_ROWS and segments * 8 * (self.p * self.p + 12 * self.p + 40) <= BROADCAST_BYTES

    def joined(self, state: DataFrame) -> DataFrame:
        if self.near:
            return self.rows.join(F.broadcast(state), "segment")
        return attach(self.rows, state, ["segment"])

    def columns(self) -> list[Column]:
        """1, arm, standardised covariates; covariates that are left out are 0."""
        xs = [F.coalesce((c(f"c{i}") - c("centre")[i + 1]) / c("scale")[i], F.lit(0.0)) for i in range(self.k)]
        return [F.lit(1.0), (c("arm") == "t").cast("double"), *xs]

    def with_columns(self, state: DataFrame) -> tuple[DataFrame, list[Column]]:
        data = self.joined(state).withColumns({f"x{i}": x for i, x in enumerate(self.columns())})
        return data, [c(f"x{i}") for i in range(self.p)]

    def dot(self, xs: list[Column], name: str) -> Column:
        total = c(name)[0] * xs[0]
        for i, x in enumerate(xs[1:], start=1):
            total = total + c(name)[i] * x
        return total


def _glm_fits(design: _Design, first: DataFrame) -> list[DataFrame]:
    """(segment, beta, status) of all GLM segments, as they finish."""
    p = design.p
    fixed = ("model", "centre", "scale")
    binomial = c("model") == "binomial"
    link = lambda m: F.when(binomial, F.log(m / (1 - m))).otherwise(F.log(m))
    possible = (c("mean_t") > 0) & (c("mean_c") > 0) & (~binomial | ((c("mean_t") < 1) & (c("mean_c") < 1)))
    mine = first.where(c("model").isin(*GLM)).withColumn("possible", F.coalesce(possible, F.lit(False)))
    # without covariates the fit is known; an arm without any or without other outcomes has none
    zeros = [F.lit(0.0)] * design.k
    start = mine.where("possible").select(
        "segment", *fixed, F.array(link(c("mean_c")), link(c("mean_t")) - link(c("mean_c")), *zeros).alias("beta"),
        F.array(*[F.lit(0.0)] * p).alias("step"), F.lit(float("-inf")).alias("best"), F.lit(float("inf")).alias("move"),
        F.lit(0).alias("tries"))
    found = [mine.where("NOT possible").select("segment", F.lit(None).cast("array<double>").alias("beta"), F.lit("separated").alias("status"))]
    y, open_ = c("y"), start
    for passes in range(MAX_PASSES):
        data, xs = design.with_columns(open_)
        data = data.withColumns({"eta": F.greatest(F.lit(-500.0), F.least(F.lit(500.0), design.dot(xs, "beta"))),
                                 "along": design.dot(xs, "step")})
        data = data.withColumn("mu", F.when(binomial, 1 / (1 + F.exp(-c("eta")))).otherwise(F.exp(c("eta"))))
        soft = F.greatest(c("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta")))  # log(1 + exp(eta))
        weight = F.when(binomial, c("mu") * (1 - c("mu"))).when(c("model") == "nb", (1 + y) * c("mu") / ((1 + c("mu")) * (1 + c("mu")))).otherwise(c("mu"))
        score = F.when(c("model") == "nb", (y - c("mu")) / (1 + c("mu"))).otherwise(y - c("mu"))
        ll = F.when(binomial, y * c("eta") - soft).when(c("model") == "nb", y * c("eta") - (y + 1) * soft).otherwise(
            y * c("eta") - c("mu"))
        no_worse = F.when(binomial, (2 * y - 1) * c("along")).when(y > 0, -F.abs("along")).otherwise(-c("along"))
        data = data.withColumns({"w": weight, "s": score})
        sums = data.groupBy("segment").agg(
            F.array(*_cross(xs, c("w"))).alias("xx"), F.array(*[F.sum(c("s") * x) for x in xs]).alias("score"),
            F.sum(ll).alias("ll"), F.min(F.when(binomial, (2 * y - 1) * c("eta")).otherwise(F.lit(-1.0))).alias("margin"),
            F.min(no_worse).alias("along"), F.max(F.abs("along")).alias("reach"),
            *[F.max(x).alias(x) for x in ("best", "move", "tries", "model")], *_carried(("beta", "step", "centre"), p),
            *_carried(("scale",), design.k))
        pack = lambda name, n: F.array(*[c(f"{name}_{i}") for i in range(n)])
        sums = sums.withColumns({"beta": pack("beta", p), "step": pack("step", p)})
        new = sums.withColumn("new", _newton(p)(
            "beta", "step", "best", "move", "tries", F.lit(passes), "xx", "score", "ll", "margin", "along", "reach"))
        state = stage(new.select("segment", "model", pack("centre", p).alias("centre"),
                                 (pack("scale", design.k) if design.k else F.array().cast("array<double>")).alias("scale"), "new.*"))
        found.append(state.where("status <> 'open'").select("segment", "beta", "status"))
        open_ = state.where("status = 'open'").drop("status")
        if open_.isEmpty():
            return found
    return [*found, open_.select("segment", "beta", F.lit("stuck").alias("status"))]


def _huber_fits(design: _Design, first: DataFrame) -> list[DataFrame]:
    """(segment, beta, robust scale, status) of all Huber segments, as they finish."""
    p, found = design.p, []
    open_ = first.where("model = 'huber'").select(
        "segment", "beta", "centre", "scale", (c("spread") * MAD_SCALE).alias("robust"), F.lit(FIRST_STRIP).alias("strip"),
        F.lit(float("inf")).alias("size"), F.lit(1.0).alias("damping"))
    for _ in range(MAX_PASSES):
        data, xs = design.with_columns(open_)
        data = data.withColumn("r", c("y") - design.dot(xs, "beta")).withColumn("u", F.abs("r") / c("robust"))
        u = c("u")
        # five zones in order of size: below, strip of the median, between, strip of the clipping point, above
        coarse = F.floor(F.log(F.greatest(F.least(u, F.lit(100.0)), F.lit(0.01))) * COARSE_STEPS)
        place = lambda at: (u / at - 1 + c("strip")) / (2 * c("strip")) * STRIP_STEPS
        low, high = place(MAD_SCALE), place(HUBER_T)
        bucket = (F.when(high >= STRIP_STEPS, 40_000 + coarse).when(high >= 0, 30_000 + F.floor(high))
                  .when(low >= STRIP_STEPS, 20_000 + coarse).when(low >= 0, 10_000 + F.floor(low)).otherwise(coarse))
        data = data.withColumn("bucket", F.when(c("robust") > 0, bucket).otherwise(F.signum(F.abs("r")).cast("bigint")))
        hist = data.groupBy("segment", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs("r")).alias("mean"), F.min(F.abs("r")).alias("lo"),
            F.max(F.abs("r")).alias("hi"), F.array(*_cross(xs, F.lit(1.0))).alias("xx"),
            F.array(*[F.sum(x * c("r")) for x in xs]).alias("xr"),
            F.array(*[F.sum(x * F.signum("r")) for x in xs]).alias("xs"),
            *[F.max(x).alias(x) for x in ("robust", "size", "damping")], *_carried(("beta", "centre"), p),
            *_carried(("scale",), design.k))
        state = stage(hist.groupBy("segment").applyInPandas(_huber_update(p), _HUBER))
        found.append(state.where("status <> 'open'").select("segment", "beta", "robust", "status"))
        open_ = state.where("status = 'open'").drop("status")
        if open_.isEmpty():
            return found
    return [*found, open_.select("segment", "beta", "robust", F.lit("stuck").alias("status"))]


def _carried(names: tuple[str, ...], k: int) -> list[Column]:
    """State of a segment through an aggregation, as numbers, so that it stays hash-based."""
    return [F.max(c(name)[i]).alias(f"{name}_{i}") for name in names for i in range(k)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def covariate_model(rows: DataFrame, moments: DataFrame, names: tuple[str, ...], options: Options) -> DataFrame:
    """Treatment effect adjusted for covariates, one row per segment.

    ``rows`` hold segment, arm, y and c0..; ``moments`` is staged with ``metric_type``. A fit without a maximum, or one
    that does not settle, is given up for the linear model; ``covariate_model_converged`` and ``covariate_model_reason``
    tell so, and which covariates were left out. Models on a log or logit scale also give the error of the average
    marginal effect and the interval of the raw difference with that error.
    """
    k = len(names)
    p = k + 2
    covs = [f"c{i}" for i in range(k)]
    complete = rows.where(" and ".join(f"{x} is not null" for x in ["y", *covs])).select("segment", "arm", "y", *covs)
    plan = stage(_models(moments, options))
    segments, kinds = plan.agg(F.count(F.lit(1)), F.collect_set("model")).first()  # at most six models
    design = _Design(complete, k, segments)

    # first scan: means and covariances, and with them the linear model
    target = F.when(c("model") == "log", F.log(c("y") + c("shift"))).otherwise(c("y"))
    treated = c("arm") == "t"
    data = design.joined(plan).withColumns({"t": treated.cast("double"), "z": target})
    parts = ["t", *covs, "z"]
    first = data.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.max("model").alias("model"), F.max("shift").alias("shift"),
        F.avg(F.when(treated, c("y"))).alias("mean_t"), F.avg(F.when(~treated, c("y"))).alias("mean_c"),
        F.array(*[F.avg(x) for x in parts]).alias("centre"),
        F.array(*[F.covar_pop(parts[i], parts[j]) for i in range(len(parts)) for j in range(i, len(parts))]).alias("cross"),
        F.array(*[F.min(x) < F.max(x) for x in covs]).cast("array<boolean>").alias("varies"))
    first = stage(first.withColumn("fit", _ordinary(p)("n", "centre", "cross", "varies")).select(
        "segment", "n", "model", "shift", "mean_t", "mean_c", "centre", "varies", "fit.*").where("beta IS NOT NULL"))

    fits = []
    if set(kinds) & set(GLM):
        fits.append(_union(_glm_fits(design, first)).withColumn("robust", F.lit(None).cast("double")))
    if "huber" in kinds:
        fits.append(_union(_huber_fits(design, first)))
    state = first.withColumns({"robust": F.lit(None).cast("double"), "status": F.lit("done")})
    if fits:
        done = _union(fits).withColumnsRenamed({"beta": "fitted", "robust": "fitted_scale", "status": "fitted_status"})
        state = first.join(done, "segment", "left")
        ok = F.coalesce("fitted_status", F.lit("done")) == "done"
        state = state.withColumns({
            "status": F.coalesce("fitted_status", F.lit("done")), "robust": F.when(ok, c("fitted_scale")),
            "beta": F.when(ok, F.coalesce("fitted", "beta")).otherwise(c("beta")),
            "model": F.when(ok, c("model")).otherwise("ols")}).drop("fitted", "fitted_scale", "fitted_status")
    state = stage(state)

    # last scan: HC3 meat, information at the solution, robust sums, gradient of the average marginal effect
    slim = state.select("segment", "model", "shift", "beta", "inverse", "centre", "scale", "robust")
    at, xs = design.with_columns(slim)
    at = at.withColumn("eta", design.dot(xs, "beta")).withColumn("e", F.when(
        c("model") == "log", F.log(c("y") + c("shift"))).otherwise(c("y")) - c("eta"))
    h = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            h = h + c("inverse")[i * p + j] * xs[i] * xs[j]
    at = at.withColumn("w3", c("e") * c("e") / F.nullif((1 - h) * (1 - h), F.lit(0.0)))

    def slope_at(eta: Column) -> Column:
        m = 1 / (1 + F.exp(-eta))
        return F.when(c("model") == "binomial", m * (1 - m)).when(
            c("model").isin("poisson", "nb", "log"), F.exp(eta)).otherwise(F.lit(1.0))

    r = c("e") / F.nullif(c("robust"), F.lit(0.0))
    inner = F.abs(r) <= HUBER_T
    b1 = c("beta")[1]
    at = at.withColumns({
        "d": slope_at(c("eta")), "d1": slope_at(c("eta") + b1 * (1 - xs[1])), "d0": slope_at(c("eta") - b1 * xs[1])})
    fisher = F.when(c("model") == "nb", c("d") / (1 + c("d"))).otherwise(c("d"))
    grads = [F.avg(c("d1") * (F.lit(1.0) if i == 1 else x) - c("d0") * (F.lit(0.0) if i == 1 else x))
             for i, x in enumerate(xs)]
    final = at.withColumn("fisher", fisher).groupBy("segment").agg(
        F.array(*_cross(xs, c("w3"))).alias("meat"), F.array(*_cross(xs, c("fisher"))).alias("info"),
        F.sum(F.when(inner, r * r).otherwise(HUBER_T * HUBER_T)).alias("psi2"),
        F.avg(inner.cast("double")).alias("inner"), F.array(*grads).alias("gradient"),
        F.avg(F.when(c("model") == "log", F.exp("e"))).alias("smear"))
    out = final.join(state, "segment").withColumn("error", _errors(p)(
        "model", "inverse", "meat", "info", "gradient", "smear"))

    share = F.nullif(c("inner"), F.lit(0.0))
    correction = 1 + (p * 1.0) / c("n") * (share * (1 - share)) / (share * share)
    h1 = (correction * correction * (c("psi2") / F.nullif(c("n") - p, F.lit(0)) * c("robust") * c("robust"))
          / (share * share) * c("inverse")[p + 1])
    variance = F.when(c("model") == "huber", h1).otherwise(c("error.coefficient"))

    def listed(keep) -> Column:
        found = [F.when(keep(i), F.lit(n)) for i, n in enumerate(names)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    kept = lambda i: c("scale")[i].isNotNull()
    out = out.withColumns({
        "used": listed(kept), "flat": listed(lambda i: ~c("varies")[i]),
        "same": listed(lambda i: c("varies")[i] & ~kept(i)), "_b": zero_if_tiny(b1), "_s": F.sqrt(variance),
        "_m": F.sqrt("error.marginal"), "_raw": zero_if_tiny(c("mean_t") - c("mean_c"))})
    named = lambda text, column: F.when(F.size(column) > 0, F.concat(F.lit(text), F.concat_ws(",", column)))
    converged = c("status") == "done"
    reason = F.concat_ws("; ", F.when(~converged, "model_fit_failed_fallback_to_ols"),
                         F.when(c("status") == "separated", "separated_outcomes"),
                         named("constant_covariates:", "flat"), named("collinear_covariates:", "same"))
    out = out.withColumn("_z", c("_b") / F.nullif(c("_s"), F.lit(0.0)))
    out = out.withColumn("_p", F.expr(two_sided("_z")))
    z = F.lit(z_quantile(1 - options.alpha / 2))
    scale_name = (F.when(c("model") == "binomial", "log_odds").when(c("model").isin("poisson", "nb"), "log_rate")
                  .when(c("model") == "log", "log_mean_difference").when(c("model") == "huber", "location_shift")
                  .otherwise("mean_difference"))
    type_name = (F.when(c("model") == "binomial", "glm_binomial").when(c("model") == "poisson", "glm_poisson")
                 .when(c("model") == "nb", "glm_negative_binomial").when(c("model") == "log", "ols_log1p_hc3")
                 .when(c("model") == "huber", "rlm_huber").otherwise("ols_hc3"))
    ratio = c("model").isin(*GLM, "log")
    lower, upper = c("_b") - z * c("_s"), c("_b") + z * c("_s")
    return out.select(
        "segment", (F.size("used") > 0).alias("covariate_adjustment_applied"), c("used").alias("covariates_used"),
        c("_b").alias("covariate_adjusted_effect"),
        sanitize_p(c("_p")).alias("covariate_adjusted_p_value"),
        lower.alias("covariate_adjusted_ci_lower"), upper.alias("covariate_adjusted_ci_upper"),
        type_name.alias("covariate_adjusted_model_type"), scale_name.alias("covariate_adjusted_effect_scale"),
        F.when(ratio, F.exp("_b")).otherwise(1.0).alias("covariate_adjusted_effect_exponentiated"),
        c("_m").alias("average_marginal_effect_se"),
        # on the scale of the raw difference, whatever the model's own scale
        F.coalesce(c("_raw") - z * c("_m"), lower).alias("covariate_raw_ci_lower"),
        F.coalesce(c("_raw") + z * c("_m"), upper).alias("covariate_raw_ci_upper"),
        c("n").alias("covariate_adjusted_rows"), converged.alias("covariate_model_converged"),
        reason.alias("covariate_model_reason"),
    )
