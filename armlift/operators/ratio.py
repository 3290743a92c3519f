"""Ratio metrics compared with the delta method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.config import Roles
from armlift.functions.guards import add, not_nan
from armlift.functions.normal import two_sided, z_quantile
from armlift.operators.arms import arm_of, each_scope, scope_column

ZERO_DENOMINATOR = 1e-12


def ratio_metric(
    df: DataFrame, roles: Roles, numerator: str, denominator: str,
    scope: str = "overall", alpha: float = 0.05,
) -> DataFrame:
    """Ratio of means per arm, difference, z-test and interval, one row per segment.

    Rows need both columns; one grouped aggregation covers all segments and arms.
    """
    missing = [x for x in (numerator, denominator, roles.group) if x not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    if roles.treatment is None or roles.control is None:
        raise ValueError("Treatment/control labels not set")
    pairs = each_scope(df.select(
        scope_column(roles, scope), arm_of(roles).alias("arm"),
        not_nan(F.col(numerator)).alias("num"), not_nan(F.col(denominator)).alias("den"),
    )).where("segment is not null and arm is not null and num is not null and den is not null")
    exprs = []
    for a in "tc":
        num, den = F.when(F.col("arm") == a, F.col("num")), F.when(F.col("arm") == a, F.col("den"))
        exprs += [
            F.count(num).alias(f"n_{a}"), F.avg(num).alias(f"mn_{a}"), F.avg(den).alias(f"md_{a}"),
            F.var_samp(num).alias(f"vn_{a}"), F.var_samp(den).alias(f"vd_{a}"),
            F.covar_samp(num, den).alias(f"cv_{a}"),
        ]
    m = pairs.groupBy("segment").agg(*exprs)
    for a in "tc":
        m = add(m, **{f"r_{a}": f"CASE WHEN n_{a} >= 2 AND abs(md_{a}) >= {ZERO_DENOMINATOR}D THEN mn_{a} / md_{a} END"})
        m = add(m, **{f"v_{a}": f"""greatest(0D, (vn_{a} + r_{a} * r_{a} * vd_{a} - 2 * r_{a} * cv_{a})
            / (md_{a} * md_{a} * n_{a}))"""})
    m = add(m, reason="""CASE WHEN n_t < 2 OR n_c < 2 THEN 'insufficient_sample_size'
        WHEN r_t IS NULL OR r_c IS NULL THEN 'undefined_ratio' WHEN v_t + v_c = 0 THEN 'zero_variance' END""")
    known = "(reason IS NULL OR reason = 'zero_variance')"
    m = add(m, absolute_diff=f"CASE WHEN {known} THEN r_t - r_c ELSE 0D END",
            standard_error=f"CASE WHEN {known} THEN sqrt(v_t + v_c) ELSE 0D END")
    m = add(m, _z="CASE WHEN standard_error > 0 THEN absolute_diff / standard_error END")
    half = f"{z_quantile(1 - alpha / 2)!r}D * standard_error"
    out = m.selectExpr(
        "segment", "coalesce(r_t, 0D) AS treatment_ratio", "coalesce(r_c, 0D) AS control_ratio", "absolute_diff",
        "CASE WHEN r_c <> 0 THEN absolute_diff / r_c ELSE 0D END AS relative_diff", "standard_error",
        "coalesce(_z, 0D) AS z_statistic", f"coalesce({two_sided('_z')}, 1D) AS p_value",
        f"absolute_diff - {half} AS ci_lower", f"absolute_diff + {half} AS ci_upper",
        "n_t AS treatment_n", "n_c AS control_n", "reason")
    return add(out, is_significant=f"reason IS NULL AND p_value < {alpha}D")
