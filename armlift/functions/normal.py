"""Standard normal distribution as Spark SQL expressions.

Spark SQL has no ``erf``; these stay in the JVM, so p-values and intervals never
leave the executor for Python. Each function takes and returns expression text.
"""

from __future__ import annotations

import math
from statistics import NormalDist

# Hart (1968) rational approximation of the upper normal tail,
# highest power first, as published by West (2005).
TAIL_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SPLIT = 7.07106781186547

# Wichura (1988), algorithm AS 241, highest power first.
CENTRE_NUMERATOR = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
    45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
    133.14166789178437745, 3.3871328727963666080,
)
CENTRE_DENOMINATOR = (
    5226.4952788528545610, 28729.085735721942674, 39307.895800092710610,
    21213.794301586595867, 5394.1960214247511077, 687.18700749205790830,
    42.313330701600911252, 1.0,
)
EDGE_NUMERATOR = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2,
    2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504,
    5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734,
)
EDGE_DENOMINATOR = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4,
    1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187,
    1.0,
)


def z_quantile(p: float) -> float:
    """Normal quantile of a plan-time constant."""
    return NormalDist().inv_cdf(p)


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    """Horner form, highest power first."""
    acc = f"{coefficients[0]!r}D"
    for k in coefficients[1:]:
        acc = f"({acc} * {x} + {k!r}D)"
    return acc


def upper_tail(x: str) -> str:
    """P(Z > x) for x >= 0. ``x`` is evaluated once and bound in a lambda."""
    body = f"{polynomial('u', TAIL_NUMERATOR)} / {polynomial('u', TAIL_DENOMINATOR)}"
    fraction = "(u + 0.65D)"
    for k in (4, 3, 2, 1):
        fraction = f"(u + {k} / {fraction})"
    far = f"{1.0 / math.sqrt(2.0 * math.pi)!r}D / {fraction}"
    rule = f"exp(-u * u / 2) * CASE WHEN u < {TAIL_SPLIT!r}D THEN {body} ELSE {far} END"
    return f"element_at(transform(array({x}), u -> {rule}), 1)"


def cdf(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1 - {upper_tail(f'abs({x})')} ELSE {upper_tail(f'abs({x})')} END"


def pdf(x: str) -> str:
    return f"exp(-({x}) * ({x}) / 2) * {1.0 / math.sqrt(2.0 * math.pi)!r}D"


def two_sided(z: str) -> str:
    return f"2 * {upper_tail(f'abs({z})')}"


def quantile(p: str) -> str:
    """Normal quantile, accurate for 1e-11 < p < 1 - 1e-11."""
    c, r = f"(0.180625D - ({p} - 0.5D) * ({p} - 0.5D))", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6D)"
    centre = f"({p} - 0.5D) * {polynomial('u', CENTRE_NUMERATOR)} / {polynomial('u', CENTRE_DENOMINATOR)}"
    edge = f"signum({p} - 0.5D) * {polynomial('u', EDGE_NUMERATOR)} / {polynomial('u', EDGE_DENOMINATOR)}"
    near = f"abs({p} - 0.5D) <= 0.425D"
    return (f"CASE WHEN {near} THEN element_at(transform(array({c}), u -> {centre}), 1) "
            f"ELSE element_at(transform(array({r}), u -> {edge}), 1) END")
