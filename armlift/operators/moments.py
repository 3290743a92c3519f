"""Sufficient statistics of every segment and arm in one grouped job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.functions.guards import add, sanitize_numeric
from armlift.operators.arms import OVERALL, each_scope, has_pooled
from armlift.session import attach, stage


def arm_moments(rows: DataFrame) -> DataFrame:
    """Long form: one row per (segment, arm) with the outcome and pre statistics."""
    rows = each_scope(rows)
    y = F.col("y")
    exprs = [
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.var_samp(y).alias("variance"),
        F.stddev_samp(y).alias("std"),
        F.sum(y).alias("sum"),
        F.sum(y * y).alias("sum_sq"),
        F.count_if(y != 0).alias("conversions"),
        F.count_if(y.isNull()).alias("rows_dropped"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    ]
    if "x" in rows.columns:
        x = F.when(y.isNotNull(), F.col("x"))
        exprs += [
            F.avg(x).alias("pre_mean"),
            F.var_samp(x).alias("pre_variance"),
            F.stddev_samp(x).alias("pre_std"),
            F.covar_samp(y, x).alias("pre_post_cov"),
        ]
    return rows.groupBy("segment", "arm").agg(*exprs)


def _view(prefix: str, keep: str, with_pre: bool) -> dict[str, str]:
    """Aggregates of one completeness view, for both arms and pooled, as SQL text."""
    finite = "y > -double('Infinity') AND y < double('Infinity')"
    out = {}
    for arm in ("t", "c"):
        here, p = f"arm = '{arm}' AND {keep}", f"{prefix}_{arm}"
        v = f"CASE WHEN {here} AND {finite} THEN y END"
        out |= {f"{p}_rows": f"count_if({here})", f"{p}_n": f"count({v})", f"{p}_mean": f"avg({v})",
                f"{p}_var": f"var_samp({v})", f"{p}_conv": f"count_if({here} AND {finite} AND y <> 0)"}
        if with_pre:
            x = f"CASE WHEN {here} AND {finite} THEN x END"
            d = f"CASE WHEN {here} AND {finite} THEN y - x END"
            out |= {f"{p}_xmean": f"avg({x})", f"{p}_xvar": f"var_samp({x})", f"{p}_cov": f"covar_samp({v}, {x})",
                    f"{p}_dmean": f"avg({d})", f"{p}_dvar": f"var_samp({d})"}
    pooled = f"CASE WHEN {keep} AND {finite} THEN y END"
    whole = "y >= 0 AND abs(y - round(y)) <= 1e-8D + 1e-5D * abs(round(y))"
    out |= {f"{prefix}_skew": f"skewness({pooled})", f"{prefix}_kurt": f"kurtosis({pooled})",
            f"{prefix}_min": f"min({pooled})", f"{prefix}_max": f"max({pooled})",
            f"{prefix}_is01": f"bool_and(CASE WHEN {keep} AND {finite} THEN y IN (0D, 1D) END)",
            f"{prefix}_whole": f"bool_and(CASE WHEN {keep} AND {finite} THEN {whole} END)"}
    return out


def merged_moments(wide: DataFrame, views: dict[str, tuple[str, bool]], by: str) -> DataFrame:
    """One row per ``by``, from the staged moments of its parts: central moments are moved to the common mean.

    Sums of squares, cross products and the third and fourth powers about the mean of a part turn into those about the
    common mean by the distance of the two, so nothing large is subtracted and no row is read again.
    """
    means, sums, out = {}, {}, {"rows_dropped": "rows_dropped"}
    sums["rows_dropped"] = "sum(rows_dropped)"
    weighted = lambda m, n: f"sum({n} * {m}) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN {n} END), 0)"
    for view, (_, pre) in views.items():
        for arm in "tc":
            p, n = f"{view}_{arm}", f"{view}_{arm}_n"
            sums |= {f"{p}_{x}": f"sum({p}_{x})" for x in ("rows", "n", "conv")}
            out |= {f"{p}_{x}": f"{p}_{x}" for x in ("rows", "n", "conv")}
            pairs = [("mean", "var"), *((("xmean", "xvar"), ("dmean", "dvar")) if pre else ())]
            for mean, var in pairs:
                means[f"all_{p}_{mean}"] = weighted(f"{p}_{mean}", n)
                gap = f"({p}_{mean} - all_{p}_{mean})"
                sums |= {f"{p}_{mean}": f"max(all_{p}_{mean})",
                         f"{p}_{var}_m2": f"sum(coalesce({p}_{var} * ({n} - 1), 0D) + {n} * {gap} * {gap})"}
                out |= {f"{p}_{mean}": f"{p}_{mean}", f"{p}_{var}": f"CASE WHEN {n} > 1 THEN {p}_{var}_m2 / ({n} - 1) END"}
            if pre:
                gap = f"({p}_mean - all_{p}_mean) * ({p}_xmean - all_{p}_xmean)"
                sums[f"{p}_cov_m2"] = f"sum(coalesce({p}_cov * ({n} - 1), 0D) + {n} * {gap})"
                out[f"{p}_cov"] = f"CASE WHEN {n} > 1 THEN {p}_cov_m2 / ({n} - 1) END"
        # both arms together: n, mean and powers about the mean of each segment
        means[f"all_{view}_mean"] = weighted(f"{view}_mean", f"{view}_n")
        gap = f"({view}_mean - all_{view}_mean)"
        sums |= {
            f"{view}_n": f"sum({view}_n)", f"{view}_m2": f"sum({view}_m2 + {view}_n * {gap} * {gap})",
            f"{view}_m3": f"sum({view}_m3 + 3 * {gap} * {view}_m2 + {view}_n * {gap} * {gap} * {gap})",
            f"{view}_m4": f"sum({view}_m4 + 4 * {gap} * {view}_m3 + 6 * {gap} * {gap} * {view}_m2 + {view}_n * power({gap}, 4))",
            f"{view}_min": f"min({view}_min)", f"{view}_max": f"max({view}_max)",
            f"{view}_is01": f"bool_and({view}_is01)", f"{view}_whole": f"bool_and({view}_whole)"}
        out |= {f"{view}_skew": f"CASE WHEN {view}_m2 > 0 THEN sqrt({view}_n) * {view}_m3 / power({view}_m2, 1.5D) END",
                f"{view}_kurt": f"CASE WHEN {view}_m2 > 0 THEN {view}_n * {view}_m4 / ({view}_m2 * {view}_m2) - 3 END"}
        out |= {f"{view}_{x}": f"{view}_{x}" for x in ("min", "max", "is01", "whole")}
    powers = wide
    for view in views:
        t, c = f"{view}_t", f"{view}_c"
        powers = add(powers, **{f"{view}_n": f"{t}_n + {c}_n"})
        powers = add(powers, **{
            f"{view}_mean": f"(coalesce({t}_n * {t}_mean, 0D) + coalesce({c}_n * {c}_mean, 0D)) / nullif({view}_n, 0)",
            f"{view}_m2": f"""coalesce({t}_var * ({t}_n - 1), 0D) + coalesce({c}_var * ({c}_n - 1), 0D) + coalesce(
                ({t}_mean - {c}_mean) * ({t}_mean - {c}_mean) * {t}_n * {c}_n / nullif({view}_n, 0), 0D)"""})
        powers = add(powers, **{
            f"{view}_m3": f"coalesce({view}_skew * power({view}_m2, 1.5D) / sqrt({view}_n), 0D)",
            f"{view}_m4": f"coalesce(({view}_kurt + 3) * {view}_m2 * {view}_m2 / {view}_n, 0D)"})
    common = powers.groupBy(by).agg(*[F.expr(e).alias(k) for k, e in means.items()])
    whole = powers.join(common, by).groupBy(by).agg(*[F.expr(e).alias(k) for k, e in sums.items()])
    return whole.select(by, *[F.expr(e).alias(k) for k, e in out.items()])


def segment_moments(rows: DataFrame) -> DataFrame:
    """Wide form: one row per segment, both arms side by side, and in scope ``both`` one of all rows.

    Completeness views (outcome; outcome and pre; outcome and covariates) are all
    aggregated in the same pass and the applicable one is chosen per segment, so
    the number of Spark jobs does not depend on the number of segments. The
    aggregation is partial on the map side, so a hot segment costs no skew.

    Rows with a column ``look``, the first look of a plan that sees them, give a row
    ``segment:look`` for that look and every later one, without being repeated.
    """
    covs = [c for c in rows.columns if c[0] == "c" and c[1:].isdigit()]
    has_pre = "x" in rows.columns
    known = "y IS NOT NULL"
    views = {"post": (known, False)}
    if has_pre:
        views["pair"] = (f"{known} AND x IS NOT NULL", True)
    own = [c for c in covs if not (has_pre and rows.schema[c].metadata.get("is_pre"))]
    if own:
        needed = [*covs, "x"] if has_pre else covs
        views["cov"] = (" AND ".join([known, *[f"{c} IS NOT NULL" for c in needed]]), has_pre)
    sums = {"rows_dropped": "count_if(y IS NULL)"}
    for name, (keep, pre) in views.items():
        sums |= _view(name, keep, pre)
    parts = ["segment", "look"] if "look" in rows.columns else ["segment"]
    wide = rows.groupBy(*parts).agg(*[F.expr(e).alias(k) for k, e in sums.items()])
    if "look" in rows.columns:
        # a look holds all rows that came before it: its moments are merged from those of the looks up to it
        wide = stage(wide)
        last = wide.agg(F.max("look")).scalar()
        upto = wide.withColumn("look", F.explode(F.sequence("look", last))).withColumn(
            "segment", F.concat_ws(":", "segment", F.col("look").cast("string"))).drop("look")
        wide = merged_moments(upto, views, "segment")
    if has_pooled(rows):
        wide = stage(wide)
        together = merged_moments(wide.withColumn("segment", F.lit(OVERALL)), views, "segment")
        wide = wide.where("segment IS NOT NULL").unionByName(together)
    order = [v for v in ("cov", "pair") if v in views]

    def usable(view: str) -> str:
        return f"{view}_t_rows >= 2 AND {view}_c_rows >= 2"

    def pick(suffix: str, pre: bool = False) -> str:
        """The value of the first usable view; pre-period values exist in some views only."""
        among = [v for v in order if views[v][1]] if pre else order
        last = "CAST(NULL AS DOUBLE)" if pre else f"post_{suffix}"
        whens = " ".join(f"WHEN {usable(v)} THEN {v}_{suffix}" for v in among)
        return f"CASE {whens} ELSE {last} END" if whens else last

    cols = {"segment": "segment", "rows_dropped": "rows_dropped", "post_n_t": "post_t_rows", "post_n_c": "post_c_rows"}
    for arm in ("t", "c"):
        cols |= {f"rows_{arm}": pick(f"{arm}_rows"), f"n_{arm}": pick(f"{arm}_n"),
                 f"mean_{arm}": f"coalesce({pick(f'{arm}_mean')}, 0D)", f"var_{arm}": f"coalesce({pick(f'{arm}_var')}, 0D)",
                 f"conv_{arm}": pick(f"{arm}_conv")}
        cols |= {f"{s}_{arm}": pick(f"{arm}_{s}", pre=True) for s in ("xmean", "xvar", "cov", "dmean", "dvar")}
    cols |= {s: pick(s) for s in ("skew", "kurt", "min", "max")}
    cols |= {s: f"coalesce({pick(s)}, false)" for s in ("is01", "whole")}
    whens = " ".join(f"WHEN {usable(v)} THEN '{v}'" for v in order)
    cols["view"] = f"CASE {whens} ELSE 'post' END" if whens else "'post'"
    cols["has_pre"] = usable("pair") if has_pre else "false"
    if has_pre:
        cols |= {f"aa_{new}_{a}": f"pair_{a}_{old}" for a in "tc" for new, old in (
            ("n", "rows"), ("mean", "xmean"), ("var", "xvar"))}
    chosen = wide.selectExpr(*[f"{e} AS {k}" for k, e in cols.items()])
    # Mean and variance of both arms together.
    chosen = add(chosen, mean_all="coalesce((n_t * mean_t + n_c * mean_c) / nullif(n_t + n_c, 0), 0D)")
    return add(chosen, var_all="""CASE WHEN n_t > 0 AND n_c > 0 THEN ((n_t - 1) * var_t + (n_c - 1) * var_c
        + (mean_t - mean_c) * (mean_t - mean_c) * n_t * n_c / (n_t + n_c)) / (n_t + n_c - 1) ELSE 0D END""")


def aligned_rows(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Finite rows of the completeness view each segment is analysed on.

    ``staged`` needs ``segment`` and ``view``; segments it lacks are left out.
    """
    rows = each_scope(rows)
    covs = [c for c in rows.columns if c[0] == "c" and c[1:].isdigit()]
    tagged = attach(rows, staged.select("segment", "view"), ["segment"])
    keep = sanitize_numeric(F.col("y")).isNotNull()
    if "x" in rows.columns:
        keep = keep & ((F.col("view") == "post") | F.col("x").isNotNull())
    for c in covs:
        keep = keep & ((F.col("view") != "cov") | F.col(c).isNotNull())
    return tagged.where(keep).drop("view")


def enough(m: DataFrame) -> DataFrame:
    return m.where((F.col("post_n_t") >= 2) & (F.col("post_n_c") >= 2))


def failures(m: DataFrame) -> DataFrame:
    """Segments that cannot be analysed, with the reason."""
    short = (F.col("post_n_t") < 2) | (F.col("post_n_c") < 2)
    text = F.format_string(
        "segment '%s' has %d treatment and %d control rows; each arm needs two",
        F.col("segment"), F.col("post_n_t"), F.col("post_n_c"),
    )
    return m.where(short).select("segment", text.alias("error"), F.lit("ValueError").alias("error_type"))


def conversion_rates(rows: DataFrame) -> DataFrame:
    """Share of rows with a positive outcome per segment and arm, over all rows of the arm."""
    agg = each_scope(rows).groupBy("segment").agg(
        F.count_if((F.col("arm") == "t") & (F.col("y") > 0)).alias("treatment_conversions"),
        F.count_if(F.col("arm") == "t").alias("treatment_n"),
        F.count_if((F.col("arm") == "c") & (F.col("y") > 0)).alias("control_conversions"),
        F.count_if(F.col("arm") == "c").alias("control_n"),
    )

    def share(arm: str) -> Column:
        n = F.col(f"{arm}_n")
        return F.when(n > 0, F.col(f"{arm}_conversions") / n).otherwise(0.0)

    return agg.withColumns({
        "treatment_rate": share("treatment"),
        "control_rate": share("control"),
        "rate_difference": share("treatment") - share("control"),
    })


def difference_in_differences(m: DataFrame) -> DataFrame:
    """Mean change per arm and their difference; the raw effect without pre data."""
    has = F.col("has_pre")
    return m.select(
        "segment",
        F.when(has, F.col("dmean_t")).otherwise(0.0).alias("did_treatment_change"),
        F.when(has, F.col("dmean_c")).otherwise(0.0).alias("did_control_change"),
        F.when(has, F.col("dmean_t") - F.col("dmean_c"))
        .otherwise(F.col("mean_t") - F.col("mean_c")).alias("did_effect"),
    )


def unit_rollup(rows: DataFrame, how: str = "sum") -> DataFrame:
    """One row per unit and arm: the remedy for repeated units.

    Two-level aggregation (partial on the map side) keeps a hot unit cheap.
    """
    if how not in ("sum", "avg"):
        raise ValueError("how must be 'sum' or 'avg'")
    fn = F.sum if how == "sum" else F.avg
    cols = [fn("y").alias("y"), F.count(F.lit(1)).alias("rows_merged")]
    if "x" in rows.columns:
        cols.append(fn("x").alias("x"))
    return each_scope(rows).where(F.col("unit").isNotNull()).groupBy("segment", "arm", "unit").agg(*cols)
