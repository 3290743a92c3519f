"""SQL building blocks for checking results in another database.

Distribution functions are written here by other methods (series, Simpson's
rule) than the ones the library uses, so that agreement means something.
"""

from __future__ import annotations

from statistics import NormalDist

Z975 = repr(NormalDist().inv_cdf(0.975))


def both_tails(z: str) -> str:
    """Two-sided normal p by the series of odd double factorials."""
    term = (f"exp((2*n+1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2*n+2) + n*ln(2) + lgamma(n+1))")
    series = f"list_sum(list_transform(range(0, 220), lambda n: {term}))"
    return (f"CASE WHEN abs({z}) > 8.5 THEN 0 ELSE greatest(0, 1 - 2 * exp(-({z})*({z})/2)"
            f" / sqrt(2*pi()) * {series}) END")


def normal_cdf(z: str) -> str:
    return f"CASE WHEN ({z}) > 0 THEN 1 - ({both_tails(z)})/2 ELSE ({both_tails(z)})/2 END"


def t_both_tails(t: str, v: str, steps: int = 400) -> str:
    """Two-sided Student-t p by Simpson's rule on the density."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    width = f"least(abs({t}), 60)"
    dens = f"exp(-(({v})+1)/2 * ln(1 + power({width} * i / {steps}, 2) / ({v})))"
    const = f"exp(lgamma((({v})+1)/2) - lgamma(({v})/2)) / sqrt(({v})*pi())"
    total = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {dens}))"
    return f"greatest(0, 1 - 2 * {const} * {width} / {steps} / 3 * {total})"


def moments(view: str, y: str = "y", x: str | None = None, by: str = "segment") -> str:
    """CTEs v and m: one row per segment with both arms' moments."""
    cols = []
    for a, label in (("t", "treatment"), ("c", "control")):
        f = f"FILTER (grp = '{label}' AND {y} IS NOT NULL" + (f" AND {x} IS NOT NULL)" if x else ")")
        cols += [f"count({y}) {f} AS n_{a}", f"avg({y}) {f} AS mean_{a}", f"var_samp({y}) {f} AS var_{a}",
                 f"count(*) FILTER (grp = '{label}' AND {y} <> 0" + (f" AND {x} IS NOT NULL)" if x else ")") + f" AS conv_{a}"]
        if x:
            cols += [f"avg({x}) {f} AS xmean_{a}", f"var_samp({x}) {f} AS xvar_{a}",
                     f"covar_samp({y}, {x}) {f} AS cov_{a}", f"avg({y}-{x}) {f} AS dmean_{a}",
                     f"var_samp({y}-{x}) {f} AS dvar_{a}"]
    both = f"FILTER ({y} IS NOT NULL" + (f" AND {x} IS NOT NULL)" if x else ")")
    cols += [f"avg({y}) {both} AS mean_all", f"var_samp({y}) {both} AS var_all"]
    if x:
        cols += [f"var_samp({x}) {both} AS xvar_all", f"avg({x}) {both} AS xmean_all",
                 f"covar_samp({y}, {x}) {both} AS cov_all"]
    return (f"WITH v AS ({view}), m AS (SELECT {by} AS segment, {', '.join(cols)} FROM v "
            f"WHERE {by} IS NOT NULL GROUP BY {by})")


HC3_SE = "sqrt(var_t/(n_t-1) + var_c/(n_c-1))"
RAW = "(mean_t - mean_c)"


def _t_critical(v: str) -> str:
    """Upper 2.5 % point of t by the expansion in 1/v; good to 1e-9 from v = 200 on."""
    z = float(Z975)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({Z975} + " + " + ".join(f"{t!r} / power({v}, {i})" for i, t in enumerate(terms, 1)) + ")"


def power_columns(base: str, target: float = 0.8, steps: int = 160) -> str:
    """CTEs from ``base`` (segment, d, n1, n2) to pw (segment, power, required_n, mde), for a two-sided 5 % t-test.

    The power is Simpson's rule over the scale of the error. The wanted size is the least whole number that reaches the
    target; the detectable effect is read off a short chord, as the curve is nearly straight there.
    """
    reach = float(Z975) + NormalDist().inv_cdf(target)
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(lo + (hi - lo) * i / {steps})"
    density = f"exp(ln(2) + v/2*ln(v/2) - lgamma(v/2) + (v-1)*ln({at}) - v*{at}*{at}/2)"
    inside = f"({normal_cdf(f'(shift - crit*{at})')}) + ({normal_cdf(f'(-shift - crit*{at})')})"
    total = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {density} * ({inside})))"
    return f"""{base}, pa AS (SELECT *, n2/n1 AS ratio, ceil({reach * reach!r} * (1 + n1/n2) / (d*d)) AS n0,
            {reach!r} * sqrt(1/n1 + 1/n2) AS d0 FROM base),
        pg AS (SELECT segment, 'at' AS kind, CAST(0 AS BIGINT) AS k, abs(d) AS d, n1, n2 FROM pa
            UNION ALL SELECT segment, 'n', k, abs(d), n0 + k, (n0 + k) * ratio FROM pa, range(-4, 9) t(k)
            UNION ALL SELECT segment, 'm', k, d0 * (1 + k * 0.0005), n1, n2 FROM pa, range(0, 3) t(k)),
        pv AS (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS v, d * sqrt(n1*n2/(n1 + n2)) AS shift FROM pg),
        pc AS (SELECT *, {_t_critical('v')} AS crit, greatest(1e-12, 1 - 9/sqrt(2*v)) AS lo, 1 + 9/sqrt(2*v) AS hi FROM pv),
        pp AS (SELECT *, (hi - lo) / {steps} / 3 * {total} AS p FROM pc),
        pw AS (SELECT segment, max(p) FILTER (kind = 'at') AS power,
            CAST(min(n1) FILTER (kind = 'n' AND p >= {target}) AS BIGINT) AS required_n,
            max(d) FILTER (kind = 'm' AND k = 0) + ({target} - max(p) FILTER (kind = 'm' AND k = 0))
            * (max(d) FILTER (kind = 'm' AND k = 2) - max(d) FILTER (kind = 'm' AND k = 0))
            / (max(p) FILTER (kind = 'm' AND k = 2) - max(p) FILTER (kind = 'm' AND k = 0)) AS mde
            FROM pp GROUP BY segment)"""


# Inverse of a symmetric 3 x 3 matrix s00..s22, over its determinant.
DET = "(s00*(s11*s22 - s12*s12) - s01*(s01*s22 - s12*s02) + s02*(s01*s12 - s11*s02))"
INVERSE = {
    "00": "(s11*s22 - s12*s12)", "01": "(s12*s02 - s01*s22)", "02": "(s01*s12 - s11*s02)",
    "11": "(s00*s22 - s02*s02)", "12": "(s01*s02 - s00*s12)", "22": "(s00*s11 - s01*s01)"}
SOLVED = [" + ".join(f"{INVERSE[''.join(sorted((i, j)))]}*r{j}" for j in "012") for i in "012"]
CROSS = ("s00", "1"), ("s01", "t"), ("s02", "x"), ("s11", "t*t"), ("s12", "t*x"), ("s22", "x*x")
THREE = """d AS (SELECT segment, CASE WHEN grp = 'treatment' THEN 1.0::DOUBLE ELSE 0.0 END AS t, CAST({y} AS DOUBLE) AS y,
            ({x} - avg({x}) OVER w)/stddev_pop({x}) OVER w AS x FROM raw WHERE {y} IS NOT NULL AND {x} IS NOT NULL
            WINDOW w AS (PARTITION BY segment))"""


def irls(view: str, y: str, x: str, kind: str, rounds: int = 14) -> str:
    """CTEs to f (segment, n, b, se, ame, raw): treatment coefficient of a GLM on arm and one covariate, by Newton steps,
    and the error of the average marginal effect by the delta method.

    ``kind`` is 'binomial' or 'nb' (log link, dispersion 1). The covariate is standardised, which changes none of them.
    """
    if kind == "binomial":
        mu, w, start, slope = "1/(1 + exp(-eta))", "mu*(1 - mu)", "ln(avg(y)/(1 - avg(y)))", "exp(-{e})/power(1 + exp(-{e}), 2)"
        z = "eta + (y - mu)/(mu*(1 - mu))"
    else:
        mu, w, z, start, slope = "exp(eta)", "mu/(1 + mu)", "eta + (y - mu)/mu", "ln(avg(y))", "exp({e})"
    sums = ", ".join(f"sum(w*{a}) AS {n}" for n, a in (*CROSS, ("r0", "z"), ("r1", "t*z"), ("r2", "x*z")))
    at = f"""(SELECT *, {z} AS z FROM (SELECT *, {w} AS w FROM (SELECT *, {mu} AS mu FROM (
        SELECT k, d.segment, t, x, y, b0 + b1*t + b2*x AS eta FROM it JOIN d ON d.segment = it.segment))))"""
    last = at.replace("FROM it JOIN d ON d.segment = it.segment", f"FROM it JOIN d ON d.segment = it.segment AND k = {rounds}")
    marginal = " + ".join(f"{1 if i == j else 2}*g{i}*g{j}*{INVERSE[i + j]}" for i in "012" for j in "012" if i <= j)
    return f"""WITH RECURSIVE raw AS ({view}), {THREE.format(y=y, x=x)},
        it(k, segment, b0, b1, b2) AS (
            SELECT 0, segment, {start}, 0.0::DOUBLE, 0.0::DOUBLE FROM d GROUP BY segment UNION ALL
            SELECT k + 1, segment, ({SOLVED[0]})/{DET}, ({SOLVED[1]})/{DET}, ({SOLVED[2]})/{DET}
            FROM (SELECT k, segment, {sums} FROM {at} GROUP BY k, segment) WHERE k < {rounds}),
        g AS (SELECT segment, count(*) AS n, {sums} FROM {last} GROUP BY segment),
        e AS (SELECT d.segment, t, x, y, {slope.format(e='(b0 + b1 + b2*x)')} AS d1, {slope.format(e='(b0 + b2*x)')} AS d0
            FROM it JOIN d ON d.segment = it.segment AND k = {rounds}),
        m AS (SELECT segment, avg(d1 - d0) AS g0, avg(d1) AS g1, avg((d1 - d0)*x) AS g2,
            avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS raw FROM e GROUP BY segment),
        f AS (SELECT g.segment, g.n, b1 AS b, sqrt({INVERSE['11']}/{DET}) AS se, sqrt(({marginal})/{DET}) AS ame, raw
            FROM g JOIN it ON it.segment = g.segment AND it.k = {rounds} JOIN m ON m.segment = g.segment)"""


def huber_fit(view: str, y: str, x: str, rounds: int = 60) -> str:
    """CTEs to f (segment, n, b, se): Huber fit with MAD scale on arm and one covariate, by reweighting all rows."""
    tune, mad = "1.345", "0.6744897501960817"
    sums = ", ".join(f"sum(w*{a}) AS {n}" for n, a in (*CROSS, ("r0", "y"), ("r1", "t*y"), ("r2", "x*y")))
    residual = "(d.y - b0 - b1*d.t - b2*d.x)"
    return f"""WITH RECURSIVE raw AS ({view}), {THREE.format(y=y, x=x)},
        a AS (SELECT segment, avg(y) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM d GROUP BY segment),
        it(k, segment, b0, b1, b2, s) AS (
            SELECT 0, d.segment, max(b0), max(b1), max(b2), median(abs({residual}))/{mad} FROM d JOIN a ON a.segment = d.segment
            GROUP BY d.segment UNION ALL
            SELECT k + 1, d.segment, max(b0), max(b1), max(b2), median(abs({residual}))/{mad} FROM (
                SELECT k, segment, ({SOLVED[0]})/{DET} AS b0, ({SOLVED[1]})/{DET} AS b1, ({SOLVED[2]})/{DET} AS b2 FROM (
                    SELECT k, segment, {sums} FROM (SELECT k, d.segment, t, x, y, least(1, {tune}*s/abs({residual})) AS w
                        FROM it JOIN d ON d.segment = it.segment WHERE k < {rounds}) GROUP BY k, segment)) q
            JOIN d ON d.segment = q.segment GROUP BY k, d.segment),
        e AS (SELECT d.segment, t, x, 1.0::DOUBLE AS w, b1, s, {residual}/s AS r FROM it JOIN d ON d.segment = it.segment
            AND k = {rounds}),
        g AS (SELECT segment, count(*) AS n, max(b1) AS b, max(s) AS s, avg(CASE WHEN abs(r) <= {tune} THEN 1.0 ELSE 0.0 END) AS sh,
            sum(least(r*r, {tune}*{tune})) AS psi2, {', '.join(f'sum(w*{q}) AS {n}' for n, q in CROSS)} FROM e GROUP BY segment),
        f AS (SELECT segment, n, b, (1 + 3.0/n*(sh*(1 - sh))/(sh*sh)) * sqrt(psi2/(n - 3)*s*s/(sh*sh)*{INVERSE['11']}/{DET}) AS se FROM g)"""


def huber(view: str, rounds: int = 60) -> str:
    """CTEs to h (segment, effect, se, scale): two-arm Huber location with MAD scale, iterated over the rows."""
    tune, mad = "1.345", "0.6744897501960817"
    centre = "CASE WHEN v.g = 1 THEN mt ELSE mc END"

    def moved(g: int) -> str:
        here = f"FILTER (v.g = {g} AND abs(v.y - {centre}) <= {tune}*s)"
        out = (f"count(*) FILTER (v.g = {g} AND v.y - {centre} > {tune}*s)"
               f" - count(*) FILTER (v.g = {g} AND v.y - {centre} < -{tune}*s)")
        return f"(sum(v.y) {here} + {tune}*max(s)*({out})) / count(*) {here}"

    return f"""WITH RECURSIVE v AS (SELECT segment, CASE WHEN grp = 'treatment' THEN 1 ELSE 0 END AS g, y FROM ({view})
            WHERE y IS NOT NULL),
        a AS (SELECT segment, avg(y) FILTER (g = 1) AS mt, avg(y) FILTER (g = 0) AS mc FROM v GROUP BY segment),
        it(k, segment, mt, mc, s) AS (
            SELECT 0, v.segment, max(mt), max(mc), median(abs(v.y - {centre}))/{mad} FROM v JOIN a ON a.segment = v.segment
            GROUP BY v.segment UNION ALL
            SELECT k + 1, v.segment, max(mt), max(mc), median(abs(v.y - {centre}))/{mad} FROM
            (SELECT k, v.segment, {moved(1)} AS mt, {moved(0)} AS mc FROM it JOIN v ON v.segment = it.segment
            WHERE k < {rounds} GROUP BY k, v.segment) q JOIN v ON v.segment = q.segment GROUP BY k, v.segment),
        e AS (SELECT v.segment, g, (v.y - {centre})/s AS r, mt, mc, s FROM it JOIN v ON v.segment = it.segment AND k = {rounds}),
        q AS (SELECT segment, max(mt) - max(mc) AS effect, max(s) AS scale, count(*) AS n, count(*) FILTER (g = 1) AS n_t,
            count(*) FILTER (g = 0) AS n_c, avg(CASE WHEN abs(r) <= {tune} THEN 1.0 ELSE 0.0 END) AS sh,
            sum(least(r*r, {tune}*{tune})) AS psi2 FROM e GROUP BY segment),
        h AS (SELECT segment, effect, scale, (1 + 2.0/n*(sh*(1 - sh))/(sh*sh))
            * sqrt(psi2/(n - 2)*scale*scale/(sh*sh)*(1.0/n_t + 1.0/n_c)) AS se FROM q)"""


def t_posterior(base: str, steps: int = 400, rounds: int = 16) -> str:
    """CTEs from ``base`` (segment, mu, st, vt, sc, vc) to b (segment, prob, loss_t, loss_c, lo, hi) for mu + st T(vt) - sc T(vc).

    A beta mixture of t variables with vt + vc degrees of freedom, by Simpson's rule over the logit and the finite series
    of t at whole degrees of freedom. The interval by Newton's method from the normal one, which lies inside.
    """
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    even = "list_sum(list_transform(range(0, CAST(floor(v/2) AS BIGINT)), lambda j: power(cos({a}), 2*j) * exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi())))"
    odd = ("coalesce(list_sum(list_transform(range(0, CAST(floor((v - 1)/2) AS BIGINT)), lambda j: power(cos({a}), 2*j + 1)"
           " * exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2)), 0)")

    def cdf(x: str) -> str:
        a = f"atan({x}/sqrt(v))"
        return (f"(0.5 + 0.5 * CASE WHEN v % 2 = 0 THEN sin({a}) * {even.format(a=a)} "
                f"ELSE 2/pi() * ({a} + sin({a}) * {odd.format(a=a)}) END)")

    def density(x: str) -> str:
        return f"exp(lgamma((v + 1)/2.0) - lgamma(v/2.0) - 0.5*ln(v*pi()) - (v + 1)/2.0*ln(1 + ({x})*({x})/v))"

    newton = " ".join(f"""q{k + 1} AS (SELECT g.segment, max(q) - (sum(w*{cdf('(q/s)')}) - 0.975) / sum(w/s*{density('(q/s)')}) AS q
        FROM g JOIN q{k} USING (segment) GROUP BY g.segment),""" for k in range(rounds))
    return f"""{base}, l AS (SELECT segment, mu, st, vt, sc, vc, CAST(vt + vc AS BIGINT) AS v, {weight} AS c,
            -84.0/vt + i*(84.0/vt + 84.0/vc)/{steps} AS x FROM base, range(0, {steps + 1}) t(i)),
        g0 AS (SELECT *, c*exp(-vt/2.0*ln(1 + exp(-x)) - vc/2.0*ln(1 + exp(x))) AS w0,
            sqrt((st*st*vt*(1 + exp(-x)) + sc*sc*vc*(1 + exp(x)))/v) AS s FROM l),
        g AS MATERIALIZED (SELECT segment, mu, v, least(vt, vc) AS least_v, s, w0/sum(w0) OVER (PARTITION BY segment) AS w FROM g0),
        p AS (SELECT segment, max(mu) AS mu, sum(w*{cdf('(mu/s)')}) AS prob, CASE WHEN max(least_v) > 1 THEN
            sum(w*(mu*{cdf('(mu/s)')} + s*{density('(mu/s)')}*(v + mu/s*mu/s)/(v - 1))) END AS gain FROM g GROUP BY segment),
        q0 AS (SELECT segment, {Z975}*sqrt(st*st + sc*sc) AS q FROM base), {newton}
        b AS (SELECT segment, prob, gain - mu AS loss_t, gain AS loss_c, mu - q AS lo, mu + q AS hi FROM p JOIN q{rounds} USING (segment))"""
