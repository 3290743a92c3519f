"""Registered queries: every operator over the given tables, with checking SQL.

A query takes (spark, folder) and returns a DataFrame; ``CHECKS`` holds the SQL
that must give the same rows elsewhere. Queries without one are iterative,
random or list-valued and are checked by the tests.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlift.config import Options, Roles, Sequential, resolve_covariates
from armlift.functions.guards import add, sanitize_numeric, sanitize_p, zero_if_tiny
from armlift.operators import inference as inf
from armlift.operators import presentation, profile
from armlift.operators.arms import analysis_rows, segment_slice, split_arms
from armlift.operators.balance import rebalance_control
from armlift.operators.bayes import bayesian_test
from armlift.operators.covariates import covariate_model
from armlift.operators.duplicates import duplicate_units
from armlift.operators.families import metric_family
from armlift.operators.models import huber_shift, log_shift
from armlift.operators.moments import (
    aligned_rows, arm_moments, conversion_rates, difference_in_differences, enough, failures,
    segment_moments, unit_rollup,
)
from armlift.operators.multiplicity import bh_fdr, sequential
from armlift.operators.ratio import ratio_metric
from armlift.functions.normal import polynomial
from armlift.operators.robustness import (
    ROYSTON_LARGE_MEAN, ROYSTON_LARGE_SD, ROYSTON_LAST, ROYSTON_SECOND,
    dagostino_test, levene_test, normality_test, outlier_sensitivity, robust_sums, shapiro_test,
)
from armlift.operators.summary import (
    assumption_findings, recommendations, recommended_segments, segment_flags, summarize,
)
from armlift.plans import checks, views
from armlift.plans.analysis import (
    RESULT_COLUMNS, analyze, auto_analyze, core_results, power_columns, sample_size_table,
)
from armlift.plans.roles import auto_configure, detect_columns, infer_labels
from armlift.session import stage
from armlift.sources import sinks
from armlift.sources.readers import describe_source, from_dataframe, read_experiment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

CONTINUOUS = Options(metric_type="continuous")
ROLES = views.roles()
c = F.col


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: comparable between engines."""
    def cell(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c(f.name), digits).alias(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c(f.name).cast("bigint").alias(f.name)
        return c(f.name)
    return df.select(*[cell(f) for f in df.schema.fields])


def r(digits: int = 6, **named: str) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in named.items())


def rows_of(spark, d, sql=views.EVENTS, roles=ROLES, scope="segments", **kw) -> DataFrame:
    return analysis_rows(views.view(spark, d, sql), roles, scope, **kw)


def moments_of(spark, d, sql=views.EVENTS, roles=ROLES, scope="segments") -> DataFrame:
    return enough(segment_moments(rows_of(spark, d, sql, roles, scope)))


EV = checks.moments(views.EVENTS)
OR = checks.moments(views.ORDERS)
LN = checks.moments(views.LINES)
CU = checks.moments(views.CUSTOMERS, "post", "pre")
US = checks.moments(views.USERS, "post", "pre")
PRE = views.roles(pre="pre", outcome="post")
Z = checks.Z975

# --- sources, sinks, projection ------------------------------------------------------


@query("read_experiment", f"""WITH v AS ({views.EVENTS}) SELECT segment, grp, count(*) AS n,
    {r(4, total='sum(y)')} FROM v GROUP BY segment, grp""")
def _(spark, d):
    df = from_dataframe(read_experiment(spark, f"{d}/events.parquet", "parquet"))
    df = df.withColumnsRenamed({"event_type": "segment"}).withColumn(
        "grp", F.when(c("user_id") % 2 == 0, "treatment").otherwise("control"))
    return rounded(df.groupBy("segment", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("describe_source", """SELECT * FROM (VALUES ('event_id','bigint'), ('ts','timestamp_ntz'), ('user_id','bigint'),
    ('event_type','string'), ('value','double'), ('props','string')) t("column", dtype),
    (SELECT count(*) AS row_count FROM events)""")
def _(spark, d):
    return describe_source(views.table(spark, d, "events")).select("column", "dtype", "row_count")


def _out(spark: SparkSession, name: str) -> str:
    """A new output folder: beside the shared checkpoints, or local in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="armlift-") + f"/{name}"


ARM_SQL = f"""WITH v AS ({views.EVENTS}) SELECT segment, left(grp, 1) AS arm, count(y) AS n,
    {r(6, mean='avg(y)')}, {r(4, variance='var_samp(y)', std='stddev_samp(y)', sum='sum(y)', sum_sq='sum(y*y)')},
    count(*) FILTER (y <> 0) AS conversions, count(*) FILTER (y IS NULL) AS rows_dropped,
    {r(6, min='min(y)', max='max(y)')} FROM v GROUP BY segment, grp"""


def _arm_table(m: DataFrame) -> DataFrame:
    out = rounded(m, 6)
    return out.withColumns({k: F.round(c(k), 4) for k in ("variance", "std", "sum", "sum_sq")})


@query("write_results", ARM_SQL)
def _(spark, d):
    path = _out(spark, "results")
    sinks.write_results(arm_moments(rows_of(spark, d)), path)
    return _arm_table(spark.read.parquet(path))


@query("write_results_partitioned", ARM_SQL)
def _(spark, d):
    path = _out(spark, "by_segment")
    sinks.write_results_partitioned(arm_moments(rows_of(spark, d)), path, "parquet", ["segment"])
    return _arm_table(spark.read.parquet(path)).select("segment", *[x for x in spark.read.parquet(path).columns if x != "segment"])


def _published(spark, d):
    df = views.view(spark, d, views.EVENTS)
    m = stage(segment_moments(analysis_rows(df, ROLES)))
    res = stage(bh_fdr(_core(m)))
    sinks.publish_tables(df, res, summarize(res, failures(m)), failures(m))


def _core(m: DataFrame, options: Options = CONTINUOUS, rows: DataFrame | None = None) -> DataFrame:
    """Inference from moments alone, for tables that need no row-level step."""
    m = metric_family(enough(m), rows, options)
    out = core_results(m, options).select(*RESULT_COLUMNS)
    return sequential(out, options.sequential, options.alpha)


@query("partition_overwrite", f"""WITH v AS ({views.EVENTS}) SELECT segment, left(grp, 1) AS arm,
    CASE WHEN segment = 'click' THEN 2 ELSE 1 END * count(y) AS n FROM v GROUP BY segment, grp""")
def _(spark, d):
    # one segment is written again with doubled counts; the others stay as they were
    path = _out(spark, "partitions")
    m = arm_moments(rows_of(spark, d)).select("segment", "arm", "n")
    sinks.write_results_partitioned(m, path, "parquet", ["segment"])
    again = m.where("segment = 'click'").withColumn("n", 2 * c("n"))
    sinks.write_results_partitioned(again, path, "parquet", ["segment"], "overwrite_partitions")
    return spark.read.parquet(path).select(c("segment").cast("string"), "arm", "n")


@query("publish_managed_tables", f"""{EV} SELECT segment, n_t AS treatment_size, {r(6, effect_size=checks.RAW)} FROM m""")
def _(spark, d):
    m = stage(segment_moments(rows_of(spark, d)))
    sinks.publish_tables(results=_core(m), managed=True, folder=_out(spark, "tables"))
    found = rounded(sinks.query_results(spark, f"SELECT segment, treatment_size, effect_size FROM {sinks.RESULTS}").data)
    found = stage(found)
    sinks.unpublish_tables(spark)
    return found


@query("publish_tables", f"""{EV} SELECT m.segment, n_t AS treatment_size, {r(6, effect_size=checks.RAW)},
    (SELECT count(*) FROM v WHERE v.segment = m.segment) AS raw_rows FROM m""")
def _(spark, d):
    _published(spark, d)
    return rounded(spark.sql(f"""SELECT r.segment, r.treatment_size, r.effect_size, count(*) AS raw_rows
        FROM {sinks.RESULTS} r JOIN {sinks.RAW} v ON v.segment = r.segment
        GROUP BY r.segment, r.treatment_size, r.effect_size"""))


@query("describe_tables")
def _(spark, d):
    _published(spark, d)
    return sinks.describe_tables(spark)


@query("query_results", f"""{EV} SELECT segment, {r(6, effect_size=checks.RAW)}, n_t + n_c AS units FROM m
    WHERE n_t > 0 ORDER BY effect_size DESC""")
def _(spark, d):
    _published(spark, d)
    return rounded(sinks.query_results(spark, f"""WITH best AS (SELECT segment, effect_size,
        treatment_size + control_size AS units FROM {sinks.RESULTS})
        SELECT * FROM best ORDER BY effect_size DESC""").data)


@query("filter_rows", f"""SELECT event_id, segment, grp, {r(6, y='y')} FROM ({views.EVENTS})
    WHERE y > 0 AND segment = 'purchase' ORDER BY y DESC, event_id""")
def _(spark, d):
    df = views.view(spark, d, views.EVENTS).orderBy(F.desc("y"), "event_id")
    return rounded(sinks.filter_rows(df, "y > 0 AND segment = 'purchase'").select("event_id", "segment", "grp", "y"))


@query("query_select", f"""SELECT segment, grp, count(*) AS n, {r(6, p90='quantile_cont(y, 0.9)')}
    FROM ({views.EVENTS}) GROUP BY segment, grp""")
def _(spark, d):
    df = views.view(spark, d, views.EVENTS)
    return rounded(sinks.query(df, f"""SELECT segment, grp, count(*) AS n, percentile(y, 0.9) AS p90
        FROM {sinks.DATA_VIEW} GROUP BY segment, grp"""))


@query("segment_slice", f"""SELECT grp, count(*) AS n, {r(6, mean='avg(y)')} FROM ({views.EVENTS})
    WHERE segment = 'click' GROUP BY grp""")
def _(spark, d):
    df = segment_slice(views.view(spark, d, views.EVENTS), ROLES, "click")
    return rounded(df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")))


@query("split_arms", f"""SELECT left(grp, 1) AS arm, segment, count(*) AS n FROM ({views.EVENTS}) GROUP BY 1, 2""")
def _(spark, d):
    return split_arms(views.view(spark, d, views.EVENTS), ROLES).groupBy("arm", "segment").agg(
        F.count(F.lit(1)).alias("n"))


@query("sanitize_numeric", f"""SELECT segment, count(*) FILTER (isfinite(y)) AS kept,
    count(*) FILTER (y IS NOT NULL AND NOT isfinite(y)) AS removed,
    {r(6, mean='avg(y) FILTER (isfinite(y))')} FROM ({views.EVENTS_BROKEN}) GROUP BY segment""")
def _(spark, d):
    from armlift.functions.guards import non_finite_count
    y = sanitize_numeric(c("y"))
    return rounded(views.view(spark, d, views.EVENTS_BROKEN).groupBy("segment").agg(
        F.count(y).alias("kept"), non_finite_count(c("y")).alias("removed"), F.avg(y).alias("mean")))


@query("sanitize_p", """SELECT event_type AS segment,
    round(sum(CASE WHEN value / 50 - 0.1 BETWEEN 0 AND 1 THEN value / 50 - 0.1 ELSE 1 END), 4) AS total_p,
    count(*) FILTER (abs(value - 10) < 1) AS snapped FROM events GROUP BY event_type""")
def _(spark, d):
    p = c("value") / 50 - 0.1
    near = zero_if_tiny(c("value") - 10, 1.0)
    return rounded(views.table(spark, d, "events").groupBy(c("event_type").alias("segment")).agg(
        F.sum(sanitize_p(p)).alias("total_p"), F.count_if(near == 0).alias("snapped")), 4)


# --- profiling and roles --------------------------------------------------------------

@query("profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) AS row_count, count(*) - count({n}) AS missing,
    {r(3, mean=f'avg({n})', std=f'stddev_samp({n})', min=f'CAST(min({n}) AS DOUBLE)', max=f'CAST(max({n}) AS DOUBLE)',
       p25=f'quantile_cont({n}, 0.25)', median=f'quantile_cont({n}, 0.5)', p75=f'quantile_cont({n}, 0.75)')} FROM orders"""
    for n in ("o_orderkey", "o_custkey", "o_totalprice")) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{n}', count(*), count(*) - count({n}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders"""
    for n in ("o_orderstatus", "o_orderdate", "o_orderpriority")) + ")")
def _(spark, d):
    return rounded(profile.profile(views.table(spark, d, "orders"), quartiles=True).select(
        "column", "row_count", "missing", "mean", "std", "min", "max", "p25", "median", "p75"), 3)


@query("column_stats", f"""SELECT count(value) AS count, {r(6, mean='avg(value)', std='stddev_samp(value)',
    min='min(value)', max='max(value)')}, count(*) - count(value) AS missing, {r(6, p25='quantile_cont(value, 0.25)',
    median='quantile_cont(value, 0.5)', p75='quantile_cont(value, 0.75)')} FROM events""")
def _(spark, d):
    return rounded(profile.column_stats(views.table(spark, d, "events"), "value"))


@query("column_values", """SELECT l_suppkey AS value, count(*) AS count,
    (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS distinct_values,
    greatest((SELECT count(DISTINCT l_suppkey) FROM lineitem) - 20, 0) AS omitted
    FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return rounded(profile.column_values(views.table(spark, d, "lineitem"), "l_suppkey", 20))


@query("distribution", f"""WITH v AS ({views.EVENTS})
    SELECT 'group' AS level, grp AS group_value, NULL AS segment, count(*) AS n FROM v GROUP BY grp
    UNION ALL SELECT 'segment', NULL, segment, count(*) FROM v GROUP BY segment
    UNION ALL SELECT 'group_segment', grp, segment, count(*) FROM v GROUP BY grp, segment""")
def _(spark, d):
    return profile.distribution(views.view(spark, d, views.EVENTS), ROLES)


@query("cross_tab", f"""SELECT segment, count(*) FILTER (grp = 'treatment') AS treatment,
    count(*) FILTER (grp = 'control') AS control FROM ({views.EVENTS}) GROUP BY segment""")
def _(spark, d):
    return profile.cross_tab(views.view(spark, d, views.EVENTS), ROLES)


@query("group_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, d):
    return profile.group_values(views.table(spark, d, "orders"), "o_orderpriority")


@query("detect_columns", """SELECT * FROM (VALUES ('customer_id', 0, 'user_id'), ('group', 0, 'experiment_group'),
    ('pre_effect', 0, 'pre_effect'), ('post_effect', 0, 'post_effect'), ('effect_value', 0, 'post_effect'),
    ('segment', 0, 'segment')) t(role, position, "column")""")
def _(spark, d):
    df = views.view(spark, d, views.USERS).withColumnsRenamed(
        {"grp": "experiment_group", "pre": "pre_effect", "post": "post_effect"})
    return detect_columns(df)


@query("auto_configure", """SELECT * FROM (VALUES ('group', 'experiment_group'), ('effect_value', 'post_effect'),
    ('treatment', 'treatment'), ('control', 'control'), ('post_effect', 'post_effect'), ('pre_effect', 'pre_effect'),
    ('segment', 'segment'), ('customer_id', 'user_id'), ('duration', 'None'), ('covariates', '()')) t(role, "value")""")
def _(spark, d):
    df = views.view(spark, d, views.USERS).withColumnsRenamed(
        {"grp": "experiment_group", "pre": "pre_effect", "post": "post_effect"})
    found = auto_configure(df)
    return spark.createDataFrame([(k, str(v)) for k, v in vars(found.roles).items()], "role string, value string")


@query("set_roles", f"""SELECT segment, count(*) FILTER (grp = 'treatment') AS treated, count(*) FILTER (grp = 'control') AS controls,
    count(DISTINCT user_id) AS units, 'y' AS outcome FROM ({views.EVENTS}) GROUP BY segment""")
def _(spark, d):
    df = views.view(spark, d, views.EVENTS)
    found = Roles.from_mapping({"group": "grp", "effect_value": "y", "segment": "segment", "customer_id": "user_id"})
    found = found.with_labels("treatment", "control").check(df)
    return split_arms(df, found).groupBy(c(found.segment).alias("segment")).agg(
        F.count_if(c("arm") == "t").alias("treated"), F.count_if(c("arm") == "c").alias("controls"),
        F.countDistinct(found.customer_id).alias("units"), F.lit(found.outcome).alias("outcome"))


@query("infer_labels", f"""WITH g AS (SELECT DISTINCT grp FROM ({views.EVENTS}))
    SELECT max(grp) FILTER (grp LIKE '%treat%') AS treatment, max(grp) FILTER (grp LIKE '%control%') AS control,
    'high' AS confidence FROM g""")
def _(spark, d):
    values = profile.group_values(views.view(spark, d, views.EVENTS), "grp")
    return infer_labels(values).select("treatment", "control", "confidence")


@query("infer_labels_by_order", """SELECT c[2] AS treatment, c[1] AS control, 'low' AS confidence
    FROM (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS c FROM customer)""")
def _(spark, d):
    values = profile.group_values(views.table(spark, d, "customer"), "c_mktsegment")
    return infer_labels(values).select("treatment", "control", "confidence")


@query("resolve_covariates", f"""SELECT 'c_acctbal' AS covariate, {r(6, mean='avg(c_acctbal)')} FROM ({views.CUSTOMERS})
    UNION ALL SELECT 'pre', {r(6, mean='avg(pre)')} FROM ({views.CUSTOMERS})""")
def _(spark, d):
    df = views.view(spark, d, views.CUSTOMERS)
    found = resolve_covariates(df, views.roles(pre="pre", outcome="post", covariates=("c_acctbal", "grp", "missing")))
    stats = df.agg(*[F.avg(n).alias(n) for n in found])
    return rounded(stats.unpivot([], list(found), "covariate", "mean"))


# --- aggregation ----------------------------------------------------------------------

@query("arm_moments", ARM_SQL)
def _(spark, d):
    return _arm_table(arm_moments(rows_of(spark, d)))


@query("overall_and_segments", f"""{EV}, o AS (SELECT * FROM m UNION ALL SELECT * FROM
    ({checks.moments(views.EVENTS, by="'Overall'").replace('WITH v AS', 'WITH v2 AS').replace('FROM v ', 'FROM v2 ')}
    SELECT * FROM m)) SELECT segment, n_t, n_c, {r(6, effect=checks.RAW)} FROM o""")
def _(spark, d):
    m = moments_of(spark, d, scope="both")
    return rounded(m.select("segment", "n_t", "n_c", (c("mean_t") - c("mean_c")).alias("effect")))


@query("rows_dropped", f"""SELECT segment, count(*) FILTER (y IS NULL) AS rows_dropped FROM ({views.EVENTS_WITH_GAPS})
    GROUP BY segment""")
def _(spark, d):
    return segment_moments(rows_of(spark, d, views.EVENTS_WITH_GAPS)).select("segment", "rows_dropped")


@query("segment_failures", f"""{checks.moments(views.EVENTS_WITH_GAPS)} SELECT segment,
    'segment ''' || segment || ''' has ' || n_t || ' treatment and ' || n_c || ' control rows; each arm needs two' AS error,
    'ValueError' AS error_type FROM m WHERE n_t < 2 OR n_c < 2""")
def _(spark, d):
    return failures(segment_moments(rows_of(spark, d, views.EVENTS_WITH_GAPS)))


FAMILY_SQL = f"""WITH u AS (SELECT 'value' AS metric, segment, y FROM ({views.EVENTS})
    UNION ALL SELECT 'late', segment, y FROM ({views.ORDERS}) UNION ALL SELECT 'quantity', segment, y FROM ({views.LINES})
    UNION ALL SELECT 'centred', segment, y - 100 FROM ({views.EVENTS})
    UNION ALL SELECT 'discount', segment, l_discount FROM ({views.LINES})),
    s AS (SELECT metric, segment, count(y) AS n, bool_and(y IN (0, 1)) AS b,
    bool_and(y >= 0 AND abs(y - round(y)) <= 1e-8 + 1e-5 * abs(round(y))) AS k, skewness(y) AS g1, kurtosis(y) AS g2,
    quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.95) AS p95, quantile_cont(y, 0.99) AS p99, stddev_samp(y) AS sd
    FROM u GROUP BY metric, segment)
    SELECT metric || ':' || segment AS segment, CASE WHEN b THEN 'binary' WHEN k THEN 'count'
    WHEN n >= 20 AND (abs(g1) > 2 OR g2 > 7) THEN 'heavy_tail'
    WHEN n >= 20 AND CASE WHEN abs(p50) <= 1e-12 THEN p99 - p95 > greatest(5 * sd, 1) ELSE abs(p99 / p50) > 15 END
    THEN 'heavy_tail' ELSE 'continuous' END AS metric_type FROM s"""


@query("metric_family", FAMILY_SQL)
def _(spark, d):
    parts = [("value", views.EVENTS, "y"), ("late", views.ORDERS, "CAST(y AS DOUBLE)"), ("quantity", views.LINES, "y"),
             ("centred", views.EVENTS, "y - 100"), ("discount", views.LINES, "l_discount")]
    df = None
    for name, sql, y in parts:
        one = views.view(spark, d, sql).selectExpr(f"concat('{name}:', segment) AS segment", "grp", f"{y} AS y")
        df = one if df is None else df.unionByName(one)
    rows = analysis_rows(df, ROLES)
    return metric_family(segment_moments(rows), rows, Options()).select("segment", "metric_type")


@query("duplicate_units", f"""WITH v AS ({views.EVENTS}), a AS (SELECT segment, grp, user_id, count(*) AS k FROM v
    GROUP BY 1, 2, 3), w AS (SELECT segment, user_id, count(*) FILTER (k > 1) AS rep, count(*) AS arms, sum(k) AS k
    FROM a GROUP BY 1, 2) SELECT segment, count(*) AS unique_units, CAST(sum(k) AS BIGINT) AS total_rows,
    CAST(sum(rep) AS BIGINT) AS within_arm_repeats, count(*) FILTER (arms > 1) AS cross_arm_units FROM w GROUP BY segment""")
def _(spark, d):
    return duplicate_units(views.view(spark, d, views.EVENTS), views.roles(customer_id="user_id"), "segments").select(
        "segment", "unique_units", "total_rows", "within_arm_repeats", "cross_arm_units")


@query("cross_arm_units", """WITH v AS (SELECT l_partkey AS u, l_returnflag AS segment, l_orderkey % 2 AS g
    FROM lineitem), a AS (SELECT u, g, count(*) AS k FROM v GROUP BY 1, 2),
    w AS (SELECT u, count(*) FILTER (k > 1) AS rep, count(*) AS arms FROM a GROUP BY 1)
    SELECT 'Overall' AS segment, count(*) AS unique_units, CAST(sum(rep) AS BIGINT) AS within_arm_repeats,
    count(*) FILTER (arms > 1) AS cross_arm_units FROM w""")
def _(spark, d):
    df = views.view(spark, d, "SELECT l_partkey, l_orderkey % 2 AS grp, l_quantity AS y FROM lineitem")
    return duplicate_units(df, views.roles(segment=None, customer_id="l_partkey")).select(
        "segment", "unique_units", "within_arm_repeats", "cross_arm_units")


CUPED_SQL = f"""{CU}, q AS (SELECT *, cov_all / xvar_all AS theta FROM m)"""


@query("cuped", CUPED_SQL + f""" SELECT segment, {r(6, cuped_theta='theta',
    cuped_variance_reduction='greatest(0, cov_all*cov_all/(xvar_all*var_all))')},
    {r(3, mean_t='mean_t - theta*(xmean_t - xmean_all)', mean_c='mean_c - theta*(xmean_c - xmean_all)')},
    {r(0, var_t='var_t + theta*theta*xvar_t - 2*theta*cov_t', var_c='var_c + theta*theta*xvar_c - 2*theta*cov_c')}
    FROM q""")
def _(spark, d):
    m = inf.cuped_moments(moments_of(spark, d, views.CUSTOMERS, PRE))
    return m.select("segment", *[F.round(c(k), n).alias(k) for k, n in (
        ("cuped_theta", 6), ("cuped_variance_reduction", 6), ("mean_t", 3), ("mean_c", 3), ("var_t", 0), ("var_c", 0))])


@query("cuped_rows", CUPED_SQL + f""" SELECT v.segment, grp, count(*) AS n,
    {r(2, mean='avg(post - theta * (pre - xmean_all))', std='stddev_samp(post - theta * (pre - xmean_all))')}
    FROM v JOIN q ON v.segment = q.segment WHERE post IS NOT NULL AND pre IS NOT NULL GROUP BY v.segment, grp""")
def _(spark, d):
    rows = rows_of(spark, d, views.CUSTOMERS, PRE)
    theta = stage(inf.cuped_moments(enough(segment_moments(rows))).select("segment", "cuped_theta", "pre_mean_all"))
    adjusted = inf.cuped_rows(rows.where("y IS NOT NULL AND x IS NOT NULL"), theta)
    name = F.when(c("arm") == "t", "treatment").otherwise("control").alias("grp")
    return rounded(adjusted.groupBy("segment", name).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_cuped").alias("mean"), F.stddev_samp("y_cuped").alias("std")), 2)


@query("outlier_sensitivity", f"""WITH v AS ({views.EVENTS}), k AS (SELECT segment, grp, y,
    row_number() OVER (PARTITION BY segment, grp ORDER BY y) AS i, count(*) OVER (PARTITION BY segment, grp) AS n FROM v),
    w AS (SELECT segment, grp, max(y) FILTER (i = floor(n*0.05) + 1) AS lo, max(y) FILTER (i = n - floor(n*0.05)) AS hi
    FROM k GROUP BY 1, 2),
    a AS (SELECT k.segment, k.grp, avg(least(greatest(y, lo), hi)) AS wm,
    avg(y) FILTER (i > floor(n*0.1) AND i <= n - floor(n*0.1)) AS tm, avg(y) AS rm
    FROM k JOIN w ON k.segment = w.segment AND k.grp = w.grp GROUP BY 1, 2),
    b AS (SELECT segment, sum(CASE WHEN grp = 'treatment' THEN wm ELSE -wm END) AS we,
    sum(CASE WHEN grp = 'treatment' THEN tm ELSE -tm END) AS te,
    sum(CASE WHEN grp = 'treatment' THEN rm ELSE -rm END) AS re FROM a GROUP BY 1),
    s AS (SELECT segment, stddev_samp(y) AS sd FROM v GROUP BY 1)
    SELECT b.segment, {r(6, raw_effect='re', winsorized_effect='we', trimmed_effect='te',
    sensitivity_score='greatest(abs(we-re), abs(te-re))/sd')}, greatest(abs(we-re), abs(te-re))/sd > 0.25
    AS is_outlier_sensitive FROM b JOIN s ON b.segment = s.segment""")
def _(spark, d):
    rows = rows_of(spark, d)
    m = stage(enough(segment_moments(rows)))
    return rounded(outlier_sensitivity(m, robust_sums(rows)).select(
        "segment", "raw_effect", "winsorized_effect", "trimmed_effect", "sensitivity_score", "is_outlier_sensitive"))


def _ratio_sql(view, num, den, by):
    arms = ", ".join(
        f"""count(*) FILTER (grp='{g}') AS n_{a}, avg({num}) FILTER (grp='{g}') AS mn_{a}, avg({den}) FILTER (grp='{g}') AS md_{a},
        var_samp({num}) FILTER (grp='{g}') AS vn_{a}, var_samp({den}) FILTER (grp='{g}') AS vd_{a},
        covar_samp({num}, {den}) FILTER (grp='{g}') AS cv_{a}""" for a, g in (("t", "treatment"), ("c", "control")))
    return f"""WITH v AS ({view}), m AS (SELECT {by} AS segment, {arms} FROM v WHERE {num} IS NOT NULL AND {den} IS NOT NULL
        GROUP BY 1), q AS (SELECT *, mn_t/md_t AS r_t, mn_c/md_c AS r_c FROM m),
        s AS (SELECT *, sqrt((vn_t + r_t*r_t*vd_t - 2*r_t*cv_t)/(md_t*md_t*n_t)
        + (vn_c + r_c*r_c*vd_c - 2*r_c*cv_c)/(md_c*md_c*n_c)) AS se FROM q), z AS (SELECT *, (r_t-r_c)/se AS z FROM s)
        SELECT segment, n_t AS treatment_n, n_c AS control_n, {r(6, treatment_ratio='r_t', control_ratio='r_c',
        absolute_diff='r_t - r_c', relative_diff='(r_t - r_c)/r_c', standard_error='se', z_statistic='z',
        p_value=checks.both_tails('z'), ci_lower=f'r_t-r_c-{Z}*se', ci_upper=f'r_t-r_c+{Z}*se')}, {checks.both_tails('z')} < 0.05 AS is_significant,
        CAST(NULL AS VARCHAR) AS reason FROM z"""


@query("ratio_metric", _ratio_sql(views.USERS, "total", "events", "segment"))
def _(spark, d):
    return rounded(ratio_metric(views.view(spark, d, views.USERS), ROLES, "total", "events", "segments"))


@query("ratio_metric_overall", _ratio_sql(views.CUSTOMERS, "post", "pre", "'Overall'"))
def _(spark, d):
    return rounded(ratio_metric(views.view(spark, d, views.CUSTOMERS), ROLES, "post", "pre"))


@query("unit_rollup", f"""SELECT segment, left(grp, 1) AS arm, CAST(user_id AS VARCHAR) AS unit, {r(4, y='sum(y)')},
    count(*) AS rows_merged FROM ({views.EVENTS}) GROUP BY segment, grp, user_id""")
def _(spark, d):
    return rounded(unit_rollup(rows_of(spark, d, roles=views.roles(customer_id="user_id"), unit=True)), 4)


@query("conversion_rates", f"""WITH v AS ({views.ORDERS}) SELECT segment,
    {r(6, treatment_rate="count(*) FILTER (grp='treatment' AND y > 0) / count(*) FILTER (grp='treatment')",
       control_rate="count(*) FILTER (grp='control' AND y > 0) / count(*) FILTER (grp='control')")},
    round(count(*) FILTER (grp='treatment' AND y > 0) / count(*) FILTER (grp='treatment')
    - count(*) FILTER (grp='control' AND y > 0) / count(*) FILTER (grp='control'), 6) AS rate_difference
    FROM v GROUP BY segment""")
def _(spark, d):
    return rounded(conversion_rates(rows_of(spark, d, views.ORDERS)).select(
        "segment", "treatment_rate", "control_rate", "rate_difference"))


# --- inference ------------------------------------------------------------------------

WELCH = """w AS (SELECT *, sqrt(var_t/n_t + var_c/n_c) AS se, (var_t/n_t + var_c/n_c)*(var_t/n_t + var_c/n_c)
    / ((var_t/n_t)*(var_t/n_t)/(n_t-1) + (var_c/n_c)*(var_c/n_c)/(n_c-1)) AS df FROM m), x AS
    (SELECT *, (mean_t - mean_c)/se AS t FROM w)"""


@query("welch_test", f"""{EV}, {WELCH} SELECT segment, {r(6, welch_t='t', welch_p=checks.t_both_tails('t', 'df'))},
    {r(4, welch_df='df')} FROM x""")
def _(spark, d):
    m = inf.welch_test(moments_of(spark, d))
    return m.select("segment", F.round("welch_t", 6).alias("welch_t"), F.round("welch_p", 6).alias("welch_p"),
                    F.round("welch_df", 4).alias("welch_df"))


PRIMARY = ["segment", "effect_size", "t_statistic", "p_value", "ci_lower", "ci_upper", "model_effect",
           "model_ci_lower", "model_ci_upper"]


def _primary_sql(start: str, coef: str, se: str, raw_se: str | None = None, digits: int = 6) -> str:
    raw_se = raw_se or se
    return f"""{start}, p AS (SELECT *, {coef} AS coef, {se} AS se, {raw_se} AS rse FROM m), z AS (SELECT *, coef/se AS z FROM p)
        SELECT segment, {r(digits, effect_size=checks.RAW, t_statistic='z', p_value=checks.both_tails('z'),
        ci_lower=f'{checks.RAW} - {Z}*rse', ci_upper=f'{checks.RAW} + {Z}*rse', model_effect='coef',
        model_ci_lower=f'coef - {Z}*se', model_ci_upper=f'coef + {Z}*se')} FROM z"""


def _primary(spark, d, sql, options, roles=ROLES):
    m = moments_of(spark, d, sql, roles)
    m = metric_family(m, None, options)
    return inf.primary_test(m, options)


@query("ols_hc3", _primary_sql(EV, checks.RAW, checks.HC3_SE))
def _(spark, d):
    return rounded(_primary(spark, d, views.EVENTS, CONTINUOUS).select(*PRIMARY))


@query("glm_binary", _primary_sql(
    OR, "ln(mean_t/(1-mean_t)) - ln(mean_c/(1-mean_c))", "sqrt(1/(n_t*mean_t*(1-mean_t)) + 1/(n_c*mean_c*(1-mean_c)))",
    "sqrt(mean_t*(1-mean_t)/n_t + mean_c*(1-mean_c)/n_c)"))
def _(spark, d):
    return rounded(_primary(spark, d, views.ORDERS, Options()).select(*PRIMARY))


@query("glm_count", _primary_sql(
    LN, "ln(mean_t) - ln(mean_c)", """CASE WHEN var_all > 1.5*mean_all THEN sqrt((1+mean_t)/(n_t*mean_t) + (1+mean_c)/(n_c*mean_c))
    ELSE sqrt(1/(n_t*mean_t) + 1/(n_c*mean_c)) END""",
    """CASE WHEN var_all > 1.5*mean_all THEN sqrt(mean_t*(1+mean_t)/n_t + mean_c*(1+mean_c)/n_c)
    ELSE sqrt(mean_t/n_t + mean_c/n_c) END"""))
def _(spark, d):
    return rounded(_primary(spark, d, views.LINES, Options()).select(*PRIMARY))


@query("glm_poisson", _primary_sql(
    LN, "ln(mean_t) - ln(mean_c)", "sqrt(1/(n_t*mean_t) + 1/(n_c*mean_c))", "sqrt(mean_t/n_t + mean_c/n_c)"))
def _(spark, d):
    return rounded(_primary(spark, d, views.LINES, Options(metric_type="count", count_model="poisson")).select(*PRIMARY))


@query("log_transform", _primary_sql(EV + """, l AS (SELECT segment, avg(ln(1+y)) FILTER (grp='treatment') AS l_t,
    avg(ln(1+y)) FILTER (grp='control') AS l_c, var_samp(ln(1+y)) FILTER (grp='treatment') AS lv_t,
    var_samp(ln(1+y)) FILTER (grp='control') AS lv_c FROM v GROUP BY segment),
    e AS (SELECT v.segment, avg(exp(ln(1+y) - CASE WHEN grp='treatment' THEN l_t ELSE l_c END)) AS smear
    FROM v JOIN l ON v.segment = l.segment GROUP BY 1),
    m2 AS (SELECT m.*, l_t, l_c, lv_t, lv_c, smear FROM m JOIN l USING (segment) JOIN e USING (segment))""",
    "l_t - l_c", "sqrt(lv_t/(n_t-1) + lv_c/(n_c-1))",
    "smear * sqrt(exp(2*l_t)*lv_t/(n_t-1) + exp(2*l_c)*lv_c/(n_c-1))").replace("rse FROM m)", "rse FROM m2)"))
def _(spark, d):
    options = Options(metric_type="heavy_tail", heavy_tail_strategy="log_transform")
    rows = rows_of(spark, d)
    m = stage(metric_family(enough(segment_moments(rows)), None, options))
    m = m.join(log_shift(aligned_rows(rows, m), m).drop("fit_scale"), "segment")
    return rounded(inf.primary_test(m, options).select(*PRIMARY))


@query("huber_shift", checks.huber(views.EVENTS) + f""" SELECT segment, {r(5, fit_effect='effect', fit_se='se', fit_scale='scale')},
    'rlm_huber' AS fit_type, true AS fit_converged FROM h""")
def _(spark, d):
    return rounded(huber_shift(rows_of(spark, d).where("y IS NOT NULL")).drop("fit_raw_se"), 5)


@query("degenerate_branches", """WITH v AS (SELECT event_type AS segment, CASE WHEN user_id % 2 = 0 THEN 'treatment' ELSE 'control' END AS grp,
    CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 5 + user_id % 2 ELSE 0 END AS y FROM events)
    SELECT segment, round(avg(y) FILTER (grp = 'treatment') - avg(y) FILTER (grp = 'control'), 6) AS effect_size,
    CASE WHEN segment = 'click' THEN 0.0 ELSE 1.0 END AS p_value, 'deterministic' AS model_type FROM v GROUP BY segment""")
def _(spark, d):
    sql = f"""SELECT event_type AS segment, {views.ARM.format(key='user_id')} AS grp,
        CASE event_type WHEN 'view' THEN 10D WHEN 'click' THEN CAST(5 + user_id % 2 AS DOUBLE) ELSE 0D END AS y FROM events"""
    return rounded(_primary(spark, d, sql, Options()).select("segment", "effect_size", "p_value", "model_type"))


def _prop_sql(variance: str) -> str:
    return f"""{OR}, p AS (SELECT *, conv_t/n_t AS p_t, conv_c/n_c AS p_c, (conv_t+conv_c)/(n_t+n_c) AS p FROM m),
        z AS (SELECT *, (p_t - p_c)/sqrt({variance}) AS z FROM p)
        SELECT segment, {r(6, treatment_proportion='p_t', control_proportion='p_c', proportion_diff='p_t - p_c',
        proportion_z_stat='z', proportion_p_value=checks.both_tails('z'))} FROM z"""


PROP = ["segment", "treatment_proportion", "control_proportion", "proportion_diff", "proportion_z_stat",
        "proportion_p_value"]


@query("proportion_score", _prop_sql("p*(1-p)*(1/n_t + 1/n_c)*(n_t+n_c)/(n_t+n_c-1)"))
def _(spark, d):
    return rounded(inf.proportion_test(moments_of(spark, d, views.ORDERS)).select(*PROP))


@query("proportion_wald", _prop_sql("p_t*(1-p_t)/n_t + p_c*(1-p_c)/n_c"))
def _(spark, d):
    return rounded(inf.proportion_test(moments_of(spark, d, views.ORDERS), method="wald").select(*PROP))


@query("proportion_guardrails", f"""{checks.moments(views.EVENTS_WITH_GAPS)} SELECT segment, concat_ws(',',
    CASE WHEN n_t < 8 OR n_c < 8 THEN 'small_sample_size' END,
    CASE WHEN least(conv_t, n_t-conv_t, conv_c, n_c-conv_c) < 5 THEN 'expected_counts_too_small' END,
    CASE WHEN (conv_t = n_t AND conv_c = n_c) OR (conv_t = 0 AND conv_c = 0) THEN 'degenerate_proportions' END) AS reasons,
    least(conv_t, n_t-conv_t, conv_c, n_c-conv_c) < 5 AS proportion_blocked FROM m WHERE n_t >= 2 AND n_c >= 2""")
def _(spark, d):
    m = inf.proportion_test(moments_of(spark, d, views.EVENTS_WITH_GAPS))
    return m.select("segment", F.concat_ws(",", "proportion_reasons").alias("reasons"), "proportion_blocked")


TINY = f"""SELECT CAST(user_id AS VARCHAR(20)) || ':' || event_type AS segment, CASE WHEN event_id % 2 = 0 THEN 'treatment' ELSE 'control' END AS grp,
    CASE WHEN user_id % 7 = 0 THEN 3.0 ELSE value END AS y FROM events"""


@query("inference_guardrails", f"""{checks.moments(TINY)} SELECT CAST(segment AS VARCHAR) AS segment, concat_ws(',',
    CASE WHEN n_t < 8 OR n_c < 8 THEN 'small_sample_size' END,
    CASE WHEN var_t <= 1e-12 OR var_c <= 1e-12 THEN 'degenerate_variance' END) AS reasons,
    n_t < 8 OR n_c < 8 AS inference_blocked FROM m WHERE n_t >= 2 AND n_c >= 2""")
def _(spark, d):
    m = _primary(spark, d, TINY, CONTINUOUS)
    return m.select("segment", F.concat_ws(",", "inference_reasons").alias("reasons"), "inference_blocked")


@query("cohens_d", f"""{EV} SELECT segment, round((mean_t - mean_c)
    / sqrt(((n_t-1)*var_t + (n_c-1)*var_c)/(n_t+n_c-2)), 6) AS cohens_d FROM m""")
def _(spark, d):
    return rounded(inf.cohens_d(moments_of(spark, d)).select("segment", "cohens_d"))


@query("did", f"""{US} SELECT segment, {r(6, did_treatment_change='dmean_t', did_control_change='dmean_c',
    did_effect='dmean_t - dmean_c')} FROM m""")
def _(spark, d):
    return rounded(difference_in_differences(moments_of(spark, d, views.USERS, PRE)))


@query("aa_test", f"""{US}, a AS (SELECT segment, n_t, n_c, xmean_t AS mean_t, xmean_c AS mean_c, xvar_t AS var_t,
    xvar_c AS var_c FROM m), {WELCH.replace('FROM m)', 'FROM a)')} SELECT segment, {r(6, aa_t_statistic='t',
    aa_p_value=checks.t_both_tails('t', 'df'), pre_effect_diff='mean_t - mean_c')}, {checks.t_both_tails('t', 'df')} > 0.05
    AS aa_test_passed FROM x""")
def _(spark, d):
    m = inf.aa_test(moments_of(spark, d, views.USERS, PRE))
    return rounded(m.select("segment", "aa_t_statistic", "aa_p_value", "pre_effect_diff", "aa_test_passed"))


# A fifth of the customers is treated; a fourth of the others had higher levels before.
SKEWED = views.CUSTOMERS.replace(views.ARM.format(key="o_custkey"), "CASE WHEN o_custkey % 5 = 1 THEN 'treatment' ELSE 'control' END").replace(
    "THEN o_totalprice END) AS pre", "THEN o_totalprice * (CASE WHEN o_custkey % 4 = 1 AND o_custkey % 5 <> 1 THEN 1.3 ELSE 1 END) END) AS pre")
DRAWS = 24  # two batches, where no replicate reaches the wanted p


@query("rebalance_control", f"""{checks.moments(SKEWED, "post", "pre")}, a AS (SELECT segment, n_t, n_c, xmean_t AS mean_t, xmean_c AS mean_c,
    xvar_t AS var_t, xvar_c AS var_c FROM m), {WELCH.replace('FROM m)', 'FROM a)')},
    f AS (SELECT *, {checks.t_both_tails('t', 'df')} AS p FROM x WHERE {checks.t_both_tails('t', 'df')} <= 0.05),
    u AS (SELECT v.segment, b, pre, ('0x' || substr(md5(o_custkey || ':' || b || ':42'), 1, 13))::BIGINT AS u
        FROM v JOIN f ON f.segment = v.segment AND n_c > n_t, range({DRAWS}) r(b) WHERE grp = 'control' AND pre IS NOT NULL AND post IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY segment, b ORDER BY u) AS i FROM u),
    s AS (SELECT k.segment, b, count(*) AS n_c, avg(pre) AS mean_c, var_samp(pre) AS var_c, max(f.n_t) AS n_t, max(f.mean_t) AS mean_t,
        max(f.var_t) AS var_t FROM k JOIN f ON f.segment = k.segment AND i <= f.n_t GROUP BY 1, 2),
    {WELCH.replace('w AS', 'w2 AS').replace('x AS', 'x2 AS').replace('FROM m)', 'FROM s)').replace('FROM w)', 'FROM w2)')},
    q AS (SELECT *, {checks.t_both_tails('t', 'df')} AS p FROM x2),
    z AS (SELECT segment, coalesce(min(b) FILTER (p >= 0.9), arg_max(b, p)) AS b FROM q GROUP BY segment)
    SELECT f.segment, {r(6, p_before='f.p', aa_p_value='coalesce(q.p, f.p)')}, z.b AS replicate, f.n_c AS original_control_size,
    coalesce(q.n_c, f.n_c) AS balanced_control_size, coalesce(z.b + 1, 1) AS bootstrap_iterations, coalesce(q.p, f.p) > 0.05 AS aa_test_passed
    FROM f LEFT JOIN z ON z.segment = f.segment LEFT JOIN q ON q.segment = z.segment AND q.b = z.b""")
def _(spark, d):
    rows = rows_of(spark, d, SKEWED, views.roles(pre="pre", outcome="post", customer_id="o_custkey"), unit=True)
    _, report = rebalance_control(rows, enough(segment_moments(rows)), DRAWS, target_p=0.9)
    return rounded(report)


@query("bayesian_test", f"""{US}, b AS (SELECT *, dmean_t - dmean_c AS mu, sqrt(dvar_t/n_t + dvar_c/n_c) AS sd FROM m),
    c AS (SELECT *, mu/sd AS z, sd*exp(-mu*mu/(2*sd*sd))/sqrt(2*pi()) - mu*({checks.normal_cdf('-mu/sd')}) AS lt FROM b)
    SELECT segment, {r(5, bayesian_prob_treatment_better=checks.normal_cdf('z'), bayesian_expected_loss_treatment='lt',
    bayesian_expected_loss_control='lt + mu', bayesian_credible_lower=f'mu - {Z}*sd',
    bayesian_credible_upper=f'mu + {Z}*sd', bayesian_relative_uplift='mu/abs(dmean_c)', bayesian_total_effect='mu*n_t')} FROM c""")
def _(spark, d):
    return rounded(bayesian_test(moments_of(spark, d, views.USERS, PRE)).select(
        "segment", "bayesian_prob_treatment_better", "bayesian_expected_loss_treatment",
        "bayesian_expected_loss_control", "bayesian_credible_lower", "bayesian_credible_upper",
        "bayesian_relative_uplift", "bayesian_total_effect"), 5)


@query("bayesian_draws", checks.t_posterior(f"""{checks.moments(TINY)}, base AS (SELECT CAST(segment AS VARCHAR) AS segment,
    {checks.RAW} AS mu, sqrt(greatest(var_t, 1e-10)/n_t) AS st, n_t - 1 AS vt, sqrt(greatest(var_c, 1e-10)/n_c) AS sc, n_c - 1 AS vc
    FROM m WHERE n_t >= 2 AND n_c >= 2 AND (var_t > 0 OR var_c > 0))""") + f""" SELECT segment, {r(
    5, bayesian_prob_treatment_better='prob', bayesian_expected_loss_treatment='loss_t', bayesian_expected_loss_control='loss_c',
    bayesian_credible_lower='lo', bayesian_credible_upper='hi')} FROM b UNION ALL SELECT CAST(segment AS VARCHAR),
    (1 + sign({checks.RAW}))/2, {r(5, a=f'greatest(-{checks.RAW}, 0) + 0', b=f'greatest({checks.RAW}, 0) + 0', c=checks.RAW, d=checks.RAW)}
    FROM m WHERE n_t >= 2 AND n_c >= 2 AND var_t = 0 AND var_c = 0""")
def _(spark, d):
    # the t posterior of small arms, by integration; the name is from when it was drawn
    return rounded(bayesian_test(moments_of(spark, d, TINY), posterior="t").select(
        "segment", "bayesian_prob_treatment_better", "bayesian_expected_loss_treatment", "bayesian_expected_loss_control",
        "bayesian_credible_lower", "bayesian_credible_upper"), 5)


D_SQL = "(mean_t - mean_c)/sqrt(((n_t-1)*var_t + (n_c-1)*var_c)/(n_t+n_c-2))"
POWER_SQL = checks.power_columns(f"""{EV}, o AS (SELECT * FROM m UNION ALL SELECT * FROM
    ({checks.moments(views.EVENTS, by="'Overall'").replace('WITH v AS', 'WITH v2 AS').replace('FROM v ', 'FROM v2 ')}
    SELECT * FROM m)), base AS (SELECT segment, {D_SQL} AS d, CAST(n_t AS DOUBLE) AS n1, CAST(n_c AS DOUBLE) AS n2 FROM o)""")


@query("power_analysis", POWER_SQL + f""" SELECT base.segment, {r(6, cohens_d='d', power='power')},
    required_n AS required_sample_size, {r(6, achieved_mde='mde')} FROM pw JOIN base ON base.segment = pw.segment""")
def _(spark, d):
    m = power_columns(inf.cohens_d(moments_of(spark, d, scope="both")), Options())
    return rounded(m.select("segment", "cohens_d", "power", "required_sample_size", "achieved_mde"))


@query("planning_effects", f"""WITH b AS (SELECT event_type AS segment, avg(value) AS m, stddev_samp(value) AS s FROM events
    GROUP BY 1) SELECT segment, {r(6, mde='CAST(e AS DOUBLE)', baseline_mean='m', baseline_std='s', standardized_effect='e/s')}
    FROM b, (VALUES (1.0), (2.0), (5.0)) g(e)""")
def _(spark, d):
    t = sample_size_table(views.table(spark, d, "events"), "value", [1.0, 2.0, 5.0], segment="event_type")
    return rounded(t.select("segment", "mde", "baseline_mean", "baseline_std", "standardized_effect"))


@query("planning_rates", f"""WITH b AS (SELECT segment, avg(y) AS p FROM ({views.ORDERS}) GROUP BY 1)
    SELECT segment, {r(6, mde='CAST(e AS DOUBLE)', baseline_rate='p',
    standardized_effect='2*asin(sqrt(p)) - 2*asin(sqrt(p+e))')} FROM b, (VALUES (0.01), (0.05)) g(e)""")
def _(spark, d):
    t = sample_size_table(views.view(spark, d, views.ORDERS), "y", [0.01, 0.05], "proportion", "segment")
    return rounded(t.select("segment", "mde", "baseline_rate", "standardized_effect"))


@query("sample_size_table", checks.power_columns("""WITH b AS (SELECT event_type AS s, avg(value) AS m, stddev_samp(value) AS sd,
    avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1),
    e AS (SELECT s || ':' || e AS segment, s, m, sd, rate, CAST(e AS DOUBLE) AS mde, e/sd AS d FROM b, (VALUES (1.0), (2.0), (5.0)) g(e)),
    base AS (SELECT segment, d, 1000.0::DOUBLE AS n1, 2000.0::DOUBLE AS n2 FROM e)""") + f""" SELECT s AS segment, {r(
    6, baseline_mean='m', baseline_std='sd', baseline_rate='rate', mde='e.mde', standardized_effect='d')},
    required_n AS treatment_n, 2 * required_n AS control_n, 3 * required_n AS total_n
    FROM pw JOIN e ON e.segment = pw.segment""")
def _(spark, d):
    return rounded(sample_size_table(views.table(spark, d, "events"), "value", [1.0, 2.0, 5.0], segment="event_type", ratio=2.0))


FULL = f"""{OR}, p AS (SELECT *, conv_t/n_t AS p_t, conv_c/n_c AS p_c, (conv_t+conv_c)/(n_t+n_c) AS pp,
    (ln(mean_t/(1-mean_t)) - ln(mean_c/(1-mean_c)))/sqrt(1/(n_t*mean_t*(1-mean_t)) + 1/(n_c*mean_c*(1-mean_c))) AS z,
    (n_t-n_c)*(n_t-n_c)/(n_t+n_c) AS chi FROM m),
    q AS (SELECT *, (p_t-p_c)/sqrt(pp*(1-pp)*(1/n_t+1/n_c)*(n_t+n_c)/(n_t+n_c-1)) AS pz FROM p),
    f AS (SELECT *, {checks.both_tails('z')} AS pv, {checks.both_tails('pz')} AS ppv, {checks.both_tails('sqrt(chi)')} AS sp FROM q),
    g AS (SELECT *, pv < 0.05 AND sp >= 0.05 AS sig, ppv < 0.05 AND sp >= 0.05 AS psig FROM f),
    h AS (SELECT *, CASE WHEN psig AND p_t > p_c THEN (p_t-p_c)*mean_c ELSE 0 END AS pe,
    CASE WHEN sig THEN {checks.RAW} ELSE 0 END AS te FROM g)"""


@query("combined_effects", FULL + f""" SELECT segment, {r(6, proportion_effect_per_customer='pe', proportion_effect='pe*n_t',
    total_effect_per_customer='pe + te', total_effect='(pe + te)*n_t')} FROM h""")
def _(spark, d):
    m = _core(segment_moments(rows_of(spark, d, views.ORDERS)), Options())
    return rounded(m.select("segment", "proportion_effect_per_customer", "proportion_effect",
                            "total_effect_per_customer", "total_effect"))


@query("sample_ratio", f"""{EV}, s AS (SELECT *, (n_t-n_c)*(n_t-n_c)/(n_t+n_c) AS chi FROM m) SELECT segment,
    {r(6, srm_chi2='chi', srm_p_value=checks.both_tails('sqrt(chi)'), srm_observed_treatment_ratio='n_t/(n_t+n_c)')},
    {checks.both_tails('sqrt(chi)')} < 0.05 AS srm_is_mismatch FROM s""")
def _(spark, d):
    return rounded(inf.sample_ratio(moments_of(spark, d)).select(
        "segment", "srm_chi2", "srm_p_value", "srm_observed_treatment_ratio", "srm_is_mismatch"))


# A third of the control rows is booked under the other arm.
MOVED = "CASE WHEN o_orderkey % 3 = 0 THEN 'treatment' ELSE grp END"


@query("sample_ratio_veto", FULL.replace("WITH v AS (", f"WITH v AS (SELECT * REPLACE ({MOVED} AS grp) FROM (").replace(
    "), m AS", ")), m AS", 1) + """ SELECT segment, sig AS is_significant,
    psig AS proportion_is_significant, sp < 0.05 AS srm_is_mismatch FROM h""")
def _(spark, d):
    df = views.view(spark, d, views.ORDERS).withColumn("grp", F.expr(MOVED))
    return _core(segment_moments(analysis_rows(df, ROLES)), Options()).select(
        "segment", "is_significant", "proportion_is_significant", "srm_is_mismatch")


# --- diagnostics ----------------------------------------------------------------------

@query("dagostino_test", f"""WITH v AS ({views.EVENTS}), s AS (SELECT segment, left(grp, 1) AS arm, count(*)::DOUBLE AS n,
    skewness(y) AS sk, kurtosis(y) AS ku FROM v GROUP BY 1, 2),
    a AS (SELECT *, sk*(n-2)/sqrt(n*(n-1)) AS g1, (ku*(n-2)*(n-3)/(n-1) - 6)/(n+1) AS g2 FROM s),
    b AS (SELECT *, g1*sqrt((n+1)*(n+3)/(6*(n-2))) AS yy, sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1
    AS w2, (g2 + 3 - 3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
    6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb FROM a),
    c AS (SELECT *, asinh(yy/sqrt(2/(w2-1)))/sqrt(ln(sqrt(w2))) AS z1, 6+8/sb*(2/sb+sqrt(1+4/(sb*sb))) AS aa FROM b),
    e AS (SELECT *, 1 + x*sqrt(2/(aa-4)) AS q FROM c), f AS (SELECT *, z1*z1 + power((1-2/(9*aa)
    - sign(q)*power((1-2/aa)/abs(q), 1.0/3))/sqrt(2/(9*aa)), 2) AS k2 FROM e)
    SELECT segment, arm, CAST(n AS BIGINT) AS n, {r(5, statistic='k2')}, {r(6, p_value='exp(-k2/2)')} FROM f""")
def _(spark, d):
    t = dagostino_test(rows_of(spark, d))
    return t.select("segment", "arm", "n", F.round("statistic", 5).alias("statistic"), F.round("p_value", 6).alias("p_value"))


def _shapiro_sql(view: str, y: str) -> str:
    """Royston's W over window ranks, for arms of more than eleven units."""
    plain = lambda text: re.sub(r"(?<=[0-9.])D\b", "", text)
    poly = lambda coefs, x: plain(polynomial(x, coefs[::-1]))
    root_n = "(1 / sqrt(n))"
    # normal scores by Newton's method on the distribution function
    newton = " ".join(f"""q{i} AS (SELECT *, m{i - 1} - ({checks.normal_cdf(f'm{i - 1}')} - pos)
        * sqrt(2*pi()) * exp(m{i - 1}*m{i - 1}/2) AS m{i} FROM q{i - 1}),""" for i in (1, 2, 3))
    return f"""WITH v AS (SELECT segment, left(grp, 1) AS arm, {y} AS y FROM ({view}) WHERE {y} IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY segment, arm ORDER BY y) AS i, avg(y) OVER w AS mean,
            CAST(count(*) OVER w AS DOUBLE) AS n, var_samp(y) OVER w AS v FROM v WINDOW w AS (PARTITION BY segment, arm)),
        p AS (SELECT *, (i - 0.375)/(n + 0.25) AS pos FROM k), q0 AS (SELECT *, (power(pos, 0.135) - power(1 - pos, 0.135))/0.1975 AS m0 FROM p), {newton}
        q AS (SELECT *, m3 AS m FROM q3),
        s AS (SELECT segment, arm, max(n) AS n, max(v) AS v, sum(m*m) AS mm, sum(m*(y - mean)) AS my, max(m) AS m1,
            max(m) FILTER (i = n - 1) AS m2, max(y) - min(y) AS g1,
            max(y) FILTER (i = n - 1) - max(y) FILTER (i = 2) AS g2 FROM q GROUP BY segment, arm),
        a AS (SELECT *, m1/sqrt(mm) + {poly(ROYSTON_LAST, root_n)} AS a1, m2/sqrt(mm) + {poly(ROYSTON_SECOND, root_n)} AS a2 FROM s),
        b AS (SELECT *, (my - m1*g1 - m2*g2)/sqrt((mm - 2*m1*m1 - 2*m2*m2)/(1 - 2*a1*a1 - 2*a2*a2)) + a1*g1 + a2*g2 AS b FROM a),
        w AS (SELECT *, b*b/((n - 1)*v) AS w, ln(n) AS ln_n FROM b),
        z AS (SELECT *, (ln(1 - w) - ({poly(ROYSTON_LARGE_MEAN, 'ln_n')}))/exp({poly(ROYSTON_LARGE_SD, 'ln_n')}) AS z FROM w)
        SELECT segment, arm, CAST(n AS BIGINT) AS n, round(w, 6) AS statistic,
            round(1 - ({checks.normal_cdf('z')}), 6) AS p_value FROM z"""


@query("shapiro_test", _shapiro_sql(views.USERS, "total"))
def _(spark, d):
    return rounded(shapiro_test(rows_of(spark, d, views.USERS, views.roles(outcome="total"))))


NORMALITY_SQL = """WITH shapiro AS ({shapiro}) SELECT segment, 'shapiro' AS normality_test,
    max(p_value) FILTER (arm = 't') AS treatment_normality_p_value, max(p_value) FILTER (arm = 'c') AS control_normality_p_value,
    max(p_value) FILTER (arm = 't') > 0.05 AS treatment_normality_passed,
    max(p_value) FILTER (arm = 'c') > 0.05 AS control_normality_passed FROM shapiro GROUP BY segment"""


@query("normality_test", NORMALITY_SQL.format(shapiro=_shapiro_sql(views.USERS, "total")))
def _(spark, d):
    rows = rows_of(spark, d, views.USERS, views.roles(outcome="total"))
    return rounded(normality_test(rows, stage(enough(segment_moments(rows)))))


@query("levene_test", f"""WITH v AS ({views.EVENTS}), e AS (SELECT segment, grp, median(y) AS med FROM v GROUP BY 1, 2),
    z AS (SELECT v.segment, v.grp, abs(y - med) AS z FROM v JOIN e ON v.segment = e.segment AND v.grp = e.grp),
    g AS (SELECT segment, grp, count(*) AS k, avg(z) AS zm, var_samp(z) AS zv FROM z GROUP BY 1, 2),
    w AS (SELECT a.segment, a.k AS k1, b.k AS k2, a.zm AS z1, b.zm AS z2, a.zv AS v1, b.zv AS v2 FROM g a JOIN g b
    ON a.segment = b.segment AND a.grp = 'treatment' AND b.grp = 'control'),
    f AS (SELECT *, CAST(k1 + k2 - 2 AS DOUBLE) AS df, (z1-z2)*(z1-z2)*k1*k2/(k1+k2)
    / (((k1-1)*v1 + (k2-1)*v2)/(k1+k2-2)) AS f FROM w)
    SELECT segment, {r(6, levene_f='f', levene_df='df', levene_p_value=checks.t_both_tails('sqrt(f)', 'df'))} FROM f""")
def _(spark, d):
    rows = rows_of(spark, d)
    m = stage(enough(segment_moments(rows)))
    return rounded(levene_test(m, robust_sums(rows)).select("segment", "levene_f", "levene_df", "levene_p_value"))


@query("variance_ratio", f"""{EV} SELECT segment, {r(6, variance_ratio='greatest(var_t, var_c)/least(var_t, var_c)')},
    greatest(var_t, var_c)/least(var_t, var_c) < 4 AS variance_ratio_passed FROM m""")
def _(spark, d):
    return rounded(inf.variance_ratio(moments_of(spark, d)).select("segment", "variance_ratio", "variance_ratio_passed"))


# --- covariates -----------------------------------------------------------------------

def _covariates(spark, d, sql, roles, names, options):
    df = views.view(spark, d, sql)
    rows = analysis_rows(df, roles, covariates=names)
    m = stage(metric_family(enough(segment_moments(rows)), rows, options))
    return covariate_model(aligned_rows(rows, m), m, names, options)


@query("covariate_ols", f"""WITH v AS ({views.CUSTOMERS}), d AS (SELECT segment, CASE WHEN grp = 'treatment' THEN 1.0 ELSE 0.0 END AS t,
    post AS y, c_acctbal AS x FROM v WHERE post IS NOT NULL AND c_acctbal IS NOT NULL),
    -- partial out the covariate (Frisch-Waugh), then HC3 with the full leverage
    a AS (SELECT segment, count(*) AS n, regr_slope(t, x) AS bt, regr_intercept(t, x) AS a0, regr_slope(y, x) AS by_,
    regr_intercept(y, x) AS ay, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM d GROUP BY 1),
    e AS (SELECT d.segment, t - a0 - bt*x AS rt, y - ay - by_*x AS ry, 1.0/n + (x-mx)*(x-mx)/sxx AS h0 FROM d JOIN a
    ON d.segment = a.segment),
    b AS (SELECT segment, sum(rt*ry)/sum(rt*rt) AS b, sum(rt*rt) AS s FROM e GROUP BY 1),
    f AS (SELECT e.segment, b, s, rt, (ry - b*rt)/(1 - h0 - rt*rt/s) AS u FROM e JOIN b ON e.segment = b.segment),
    g AS (SELECT segment, max(b) AS b, sqrt(sum(rt*rt*u*u))/max(s) AS se FROM f GROUP BY 1)
    SELECT segment, {r(3, covariate_adjusted_effect='b', covariate_adjusted_ci_lower=f'b - {Z}*se',
    covariate_adjusted_ci_upper=f'b + {Z}*se')}, {r(6, covariate_adjusted_p_value=checks.both_tails('b/se'))} FROM g""")
def _(spark, d):
    out = _covariates(spark, d, views.CUSTOMERS, views.roles(outcome="post", covariates=("c_acctbal",)),
                      ("c_acctbal",), Options(metric_type="continuous"))
    return out.select("segment", *[F.round(c(k), n).alias(k) for k, n in (
        ("covariate_adjusted_effect", 3), ("covariate_adjusted_ci_lower", 3), ("covariate_adjusted_ci_upper", 3),
        ("covariate_adjusted_p_value", 6))])


LATE = f"""SELECT o_orderkey, o_orderpriority AS segment, {views.ARM.format(key='o_custkey')} AS grp, o_totalprice AS price,
    CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders"""


def _adjusted_sql(name: str, model: str, scale: str, digits: int = 6, marginal: bool = True) -> str:
    more = (r(digits, average_marginal_effect_se="ame", covariate_raw_ci_lower=f"raw - {Z}*ame",
              covariate_raw_ci_upper=f"raw + {Z}*ame") if marginal else "CAST(NULL AS DOUBLE) AS average_marginal_effect_se, "
            + r(digits, covariate_raw_ci_lower=f"b - {Z}*se", covariate_raw_ci_upper=f"b + {Z}*se"))
    return f""" SELECT segment, true AS covariate_adjustment_applied, '{name}' AS covariates_used, {r(
        digits, covariate_adjusted_effect='b', covariate_adjusted_p_value=checks.both_tails('b/se'),
        covariate_adjusted_ci_lower=f'b - {Z}*se', covariate_adjusted_ci_upper=f'b + {Z}*se')},
        '{model}' AS covariate_adjusted_model_type, '{scale}' AS covariate_adjusted_effect_scale,
        {r(digits, covariate_adjusted_effect_exponentiated='exp(b)' if marginal else '1.0::DOUBLE')}, {more},
        n AS covariate_adjusted_rows, true AS covariate_model_converged, '' AS covariate_model_reason FROM f"""


def _adjusted(spark, d, sql, roles, name, options, digits: int = 6) -> DataFrame:
    found = _covariates(spark, d, sql, roles, (name,), options)
    return rounded(found.withColumn("covariates_used", F.concat_ws(",", "covariates_used")), digits)


@query("covariate_logit", checks.irls(LATE, "y", "price", "binomial") + _adjusted_sql("price", "glm_binomial", "log_odds"))
def _(spark, d):
    return _adjusted(spark, d, LATE, views.roles(covariates=("price",)), "price", Options())


@query("covariate_count", checks.irls(views.LINES, "y", "l_discount", "nb")
       + _adjusted_sql("l_discount", "glm_negative_binomial", "log_rate"))
def _(spark, d):
    return _adjusted(spark, d, views.LINES, views.roles(covariates=("l_discount",)), "l_discount", Options())


@query("covariate_huber", checks.huber_fit(views.CUSTOMERS, "post", "c_acctbal")
       + _adjusted_sql("c_acctbal", "rlm_huber", "location_shift", 3, marginal=False))
def _(spark, d):
    return _adjusted(spark, d, views.CUSTOMERS, views.roles(outcome="post", covariates=("c_acctbal",)), "c_acctbal",
                     Options(metric_type="heavy_tail"), 3)


# One segment's outcome is decided by the covariate, and a second covariate repeats the first.
SPLIT = f"""SELECT o_orderpriority AS segment, {views.ARM.format(key='o_custkey')} AS grp, o_totalprice AS price,
    2 * o_totalprice AS twice, CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END
    WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders"""


@query("covariate_fallbacks", checks.irls(SPLIT.replace("FROM orders", "FROM orders WHERE o_orderpriority NOT LIKE '1%'"),
                                          "y", "price", "binomial") + f""" SELECT segment, 'price' AS covariates_used,
    'glm_binomial' AS covariate_adjusted_model_type, {r(6, covariate_adjusted_effect='b')}, true AS covariate_model_converged,
    'collinear_covariates:twice' AS covariate_model_reason FROM f UNION ALL SELECT segment, 'price', 'ols_hc3',
    round((covar_pop(t, y) - covar_pop(t, x)*covar_pop(x, y)/var_pop(x)) / (var_pop(t) - covar_pop(t, x)*covar_pop(t, x)/var_pop(x)), 6),
    false, 'model_fit_failed_fallback_to_ols; separated_outcomes; collinear_covariates:twice'
    FROM (SELECT segment, CASE WHEN grp = 'treatment' THEN 1.0 ELSE 0.0 END AS t, price AS x, y FROM ({SPLIT}) WHERE segment LIKE '1%')
    GROUP BY segment""")
def _(spark, d):
    found = _covariates(spark, d, SPLIT, views.roles(covariates=("price", "twice")), ("price", "twice"), Options())
    return rounded(found.select("segment", F.concat_ws(",", "covariates_used").alias("covariates_used"),
                                "covariate_adjusted_model_type", "covariate_adjusted_effect", "covariate_model_converged",
                                "covariate_model_reason"))


# --- multiplicity, sequential, presentation -----------------------------------------------

MANY = f"""SELECT l_suppkey % 40 AS segment, {views.ARM.format(key='l_orderkey')} AS grp,
    l_extendedprice + CASE WHEN l_suppkey % 10 = 3 AND l_orderkey % 2 = 0 THEN 4000 ELSE 0 END AS y FROM lineitem"""
MANY_SQL = f"""{checks.moments(MANY)}, z AS (SELECT *, {checks.RAW}/{checks.HC3_SE} AS z FROM m),
    p AS (SELECT *, {checks.both_tails('z')} AS p FROM z), k AS (SELECT *, row_number() OVER (ORDER BY p, segment) AS i,
    count(*) OVER () AS n FROM p), a AS (SELECT *, least(1, min(p*n/i) OVER (ORDER BY p, segment
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM k)"""


@query("bh_fdr", MANY_SQL + f""" SELECT CAST(segment AS VARCHAR) AS segment, {r(6, p_value='p', p_value_adjusted='adj')},
    adj <= 0.05 AS is_significant_adjusted FROM a""")
def _(spark, d):
    rows = rows_of(spark, d, MANY)
    res = bh_fdr(_core(segment_moments(rows), Options(), rows))
    return rounded(res.select("segment", "p_value", "p_value_adjusted", "is_significant_adjusted"))


SEQ = """, s AS (SELECT *, look / 4.0 AS info FROM {source}), t AS (SELECT *, least(0.05, {spent}) AS spent FROM s),
    d AS (SELECT *, CASE WHEN look = 4 AND p <= 0.05 THEN 'final_accept' WHEN look = 4 THEN 'final_reject'
    WHEN p <= spent THEN 'stop_efficacy' WHEN info >= 0.75 AND p >= 0.5 AND abs(z) <= {z} THEN 'stop_futility'
    ELSE 'continue' END AS sequential_decision FROM t)"""
OBF, POCOCK = checks.both_tails(f"{Z}/sqrt(info)"), "0.05*ln(1 + (exp(1) - 1)*info)"


def _seq_sql(spent: str, look: int) -> str:
    p = EV + f", z AS (SELECT *, {checks.RAW}/{checks.HC3_SE} AS z FROM m), p AS (SELECT *, {checks.both_tails('z')} AS p, {look} AS look FROM z)"
    return p + SEQ.format(source="p", spent=spent, z=Z) + f""" SELECT segment, {r(6, sequential_alpha_spent='spent',
        sequential_information_fraction='info')}, sequential_decision FROM d"""


def _seq(spark, d, **kw):
    options = Options(metric_type="continuous", sequential=kw)
    return rounded(_core(segment_moments(rows_of(spark, d)), options).select(
        "segment", "sequential_alpha_spent", "sequential_information_fraction", "sequential_decision"))


@query("sequential_obrien_fleming", _seq_sql(OBF, 3))
def _(spark, d):
    return _seq(spark, d, look_index=3, max_looks=4)


@query("sequential_pocock", _seq_sql(POCOCK, 2))
def _(spark, d):
    return _seq(spark, d, current_look=2, planned_looks=4, method="pocock")


LOOKS = f"""SELECT event_type || ':' || look AS segment, event_type AS seg, look, {views.ARM.format(key='user_id')} AS grp, value AS y
    FROM events JOIN (SELECT explode(sequence(1, 4)) AS look)
    ON ts < TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(look * 8)"""


@query("sequential_looks", (checks.moments(
    LOOKS.replace("JOIN (SELECT explode(sequence(1, 4)) AS look)", "JOIN (SELECT unnest([1, 2, 3, 4]) AS look)")
    .replace("make_dt_interval(look * 8)", "to_days(CAST(look * 8 AS INTEGER))"))
    + f", z AS (SELECT *, {checks.RAW}/{checks.HC3_SE} AS z, CAST(right(segment, 1) AS INTEGER) AS look FROM m),"
      f" p AS (SELECT *, {checks.both_tails('z')} AS p FROM z)" + SEQ.format(source="p", spent=OBF, z=Z)
    + f" SELECT segment, {r(6, p_value='p', sequential_alpha_spent='spent')}, sequential_decision FROM d"))
def _(spark, d):
    # all looks of a plan from one grouped pass: a row is counted at the first look that sees it
    ev = views.table(spark, d, "events")
    first = F.greatest(F.lit(1), F.ceil((F.unix_micros(c("ts").cast("timestamp")) + 1 - F.unix_micros(
        F.lit("2024-01-01 00:00:00").cast("timestamp"))) / (8 * 86400e6)).cast("int"))
    df = ev.select(c("event_type").alias("segment"), F.when(c("user_id") % 2 == 0, "treatment").otherwise("control").alias("grp"),
                   c("value").alias("y"), first.alias("look")).where("look <= 4")
    rows = analysis_rows(df, ROLES, look="look")
    m = metric_family(enough(segment_moments(rows)), None, CONTINUOUS)
    out = core_results(m, CONTINUOUS).select(*RESULT_COLUMNS).withColumns({
        "look_index": F.substring_index("segment", ":", -1).cast("int"), "max_looks": F.lit(4)})
    return rounded(sequential(out, Sequential()).select("segment", "p_value", "sequential_alpha_spent", "sequential_decision"))


def _orders_result(spark, d):
    return stage(bh_fdr(_core(segment_moments(rows_of(spark, d, views.ORDERS)), Options())))


@query("summary", FULL + f""" SELECT count(*) AS total_segments_analyzed, count(*) FILTER (sig) AS t_test_significant_segments,
    count(*) FILTER (psig) AS prop_test_significant_segments, count(*) FILTER (sp < 0.05) AS srm_mismatch_segments,
    {r(6, t_test_significance_rate='count(*) FILTER (sig)/count(*)',
    t_test_avg_effect=f'coalesce(avg({checks.RAW}) FILTER (sig), 0)', t_test_total_effect='sum(te*n_t)',
    combined_total_effect='sum((te + pe)*n_t)', did_avg_effect=f'avg({checks.RAW})')},
    CAST(sum(n_t) AS BIGINT) AS total_treatment_customers, CAST(sum(n_c) AS BIGINT) AS total_control_customers,
    round(sum(n_t)/sum(n_c), 6) AS treatment_control_ratio FROM h""")
def _(spark, d):
    return rounded(summarize(_orders_result(spark, d)).select(
        "total_segments_analyzed", "t_test_significant_segments", "prop_test_significant_segments",
        "srm_mismatch_segments", "t_test_significance_rate", "t_test_avg_effect", "t_test_total_effect",
        "combined_total_effect", "did_avg_effect", "total_treatment_customers", "total_control_customers",
        "treatment_control_ratio"))


@query("summary_full")
def _(spark, d):
    return analyze(views.view(spark, d, views.EVENTS_WITH_GAPS), ROLES).summary


FULL_POWER = checks.power_columns(FULL + f""", base AS (SELECT segment, {D_SQL} AS d, CAST(n_t AS DOUBLE) AS n1,
    CAST(n_c AS DOUBLE) AS n2 FROM h)""")
RULES_SQL = FULL_POWER + """, k AS (SELECT count(*) AS total, count(*) FILTER (sp < 0.05) AS srm, count(*) FILTER (sig) AS sig,
    count(*) FILTER (sig AND mean_t > mean_c) AS pos, count(*) FILTER (sig AND mean_t < mean_c) AS neg,
    count(*) FILTER (greatest(n_t, n_c) > 2 * least(n_t, n_c)) AS skew,
    count(*) FILTER (power < 0.8) AS weak FROM h JOIN pw ON pw.segment = h.segment)"""


@query("recommendations", RULES_SQL + """ SELECT position, rule, segments FROM (
    SELECT 6 AS position, 'sample_ratio' AS rule, srm AS segments, srm > 0 AS fires FROM k
    UNION ALL SELECT 9, 'multiple_testing', total, total > 1 FROM k UNION ALL SELECT 10, 'positive', pos, pos > 0 FROM k
    UNION ALL SELECT 11, 'negative', neg, neg > 0 FROM k UNION ALL SELECT 12, 'none', sig, sig = 0 FROM k
    UNION ALL SELECT 13, 'sample_size', weak, weak > 0 FROM k
    UNION ALL SELECT 14, 'imbalance', skew, skew > 0 FROM k) WHERE fires""")
def _(spark, d):
    return rounded(recommendations(_orders_result(spark, d)).drop("recommendation"))


@query("recommended_segments", FULL_POWER + """ SELECT 'sample_size' AS rule, segment FROM pw WHERE power < 0.8
    UNION ALL SELECT 'sample_ratio' AS rule, segment FROM h WHERE sp < 0.05
    UNION ALL SELECT 'multiple_testing', segment FROM h WHERE (SELECT count(*) FROM h) > 1
    UNION ALL SELECT 'positive', segment FROM h WHERE sig AND mean_t > mean_c
    UNION ALL SELECT 'negative', segment FROM h WHERE sig AND mean_t < mean_c
    UNION ALL SELECT 'imbalance', segment FROM h WHERE greatest(n_t, n_c) > 2 * least(n_t, n_c)""")
def _(spark, d):
    return recommended_segments(_orders_result(spark, d)).drop("detail")


@query("segment_flags", f"""{EV}, s AS (SELECT segment, (n_t-n_c)*(n_t-n_c)/(n_t+n_c) AS chi FROM m)
    SELECT 'srm_mismatch' AS flag, segment FROM s WHERE {checks.both_tails('sqrt(chi)')} < 0.05
    UNION ALL SELECT 'guardrail', segment FROM m WHERE least(n_t, n_c) < 8
    OR least(conv_t, n_t-conv_t, conv_c, n_c-conv_c) < 5 OR least(var_t, var_c) <= 1e-12""")
def _(spark, d):
    return segment_flags(_core(segment_moments(rows_of(spark, d))))


QUALITY_SQL = f"""SELECT s.segment, srm_chi2, srm_p_value, srm_is_mismatch, normality_test, treatment_normality_p_value,
    control_normality_p_value, treatment_normality_passed, control_normality_passed, levene_p_value, levene_p_value > 0.05 AS equal_variance_passed,
    winsorized_effect, trimmed_effect, sensitivity_score, is_outlier_sensitive, unique_units, within_arm_repeats, cross_arm_units
    FROM ({CHECKS['sample_ratio']}) s JOIN ({CHECKS['outlier_sensitivity']}) o ON o.segment = s.segment
    JOIN ({CHECKS['levene_test']}) l ON l.segment = s.segment JOIN ({CHECKS['duplicate_units']}) u ON u.segment = s.segment
    JOIN ({NORMALITY_SQL.format(shapiro=_shapiro_sql(views.EVENTS, "y"))}) n ON n.segment = s.segment"""


@query("diagnostics_payload", QUALITY_SQL)
def _(spark, d):
    res = analyze(views.view(spark, d, views.EVENTS), views.roles(customer_id="user_id"), Options(metric_type="continuous")).results
    quality = res.select("segment", "diagnostics.experiment_quality.*")
    return rounded(quality.select(
        "segment", "srm.srm_chi2", "srm.srm_p_value", "srm.srm_is_mismatch", "assumptions.normality_test",
        "assumptions.treatment_normality_p_value", "assumptions.control_normality_p_value",
        "assumptions.treatment_normality_passed", "assumptions.control_normality_passed", "assumptions.levene_p_value",
        "assumptions.equal_variance_passed", "outlier_sensitivity.winsorized_effect", "outlier_sensitivity.trimmed_effect",
        "outlier_sensitivity.sensitivity_score", "outlier_sensitivity.is_outlier_sensitive", "duplicate_units.unique_units",
        "duplicate_units.within_arm_repeats", "duplicate_units.cross_arm_units"))


@query("assumption_findings", f"""WITH q AS ({QUALITY_SQL}) SELECT segment, 'normality' AS "check", 'treatment' AS detail FROM q
    WHERE NOT treatment_normality_passed UNION ALL SELECT segment, 'normality', 'control' FROM q WHERE NOT control_normality_passed
    UNION ALL SELECT segment, 'equal_variance', 'Levene' FROM q WHERE NOT equal_variance_passed
    UNION ALL SELECT segment, 'outliers', printf('%.4f', sensitivity_score) FROM q WHERE is_outlier_sensitive
    UNION ALL SELECT segment, 'duplicate_units', within_arm_repeats || ' unit(s) appear more than once in one arm: roll rows up to units before testing'
    FROM q WHERE within_arm_repeats > 0""")
def _(spark, d):
    return assumption_findings(analyze(views.view(spark, d, views.EVENTS), views.roles(customer_id="user_id"),
                                       Options(metric_type="continuous")).results)


@query("waterfall", FULL + f""", w AS (SELECT segment, (te + pe)*n_t AS k FROM h)
    SELECT segment, {r(6, contribution='k')}, 'relative' AS measure FROM w
    UNION ALL SELECT 'Total', round(sum(k), 6), 'total' FROM w""")
def _(spark, d):
    return rounded(presentation.waterfall(_orders_result(spark, d)))


SHARE_SE = "sqrt(mean_t*(1-mean_t)/n_t + mean_c*(1-mean_c)/n_c)"


@query("chart_effect_sizes", FULL + f""" SELECT segment, {r(6, effect_size=checks.RAW, error_minus=f'{Z}*{SHARE_SE}', error_plus=f'{Z}*{SHARE_SE}')}, CASE WHEN sig AND mean_t > mean_c THEN 'positive'
    WHEN sig AND mean_t < mean_c THEN 'negative' ELSE 'neutral' END AS direction FROM h""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "effects"))


@query("chart_p_values", FULL + f""" SELECT segment, {r(6, p_value='pv')}, 0.05::DOUBLE AS threshold,
    pv < 0.05 AS below_threshold FROM h""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "significance"))


@query("chart_cohens_d", f"""{EV}, d AS (SELECT segment, (mean_t - mean_c)/sqrt(((n_t-1)*var_t + (n_c-1)*var_c)/(n_t+n_c-2)) AS d
    FROM m) SELECT segment, {r(6, cohens_d='d')}, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium'
    WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS band FROM d""")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "cohen"))


@query("chart_sample_sizes", f"{EV} SELECT segment, n_t AS treatment_size, n_c AS control_size FROM m")
def _(spark, d):
    return presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "samples")


@query("chart_means", f"{EV} SELECT segment, {r(6, treatment_mean='mean_t', control_mean='mean_c')} FROM m")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "means"))


@query("chart_combined_effects", FULL + f""" SELECT segment, {r(6, t_test_effect='te*n_t', proportion_effect='pe*n_t',
    total_effect='(te+pe)*n_t')} FROM h""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "combined"))


@query("chart_proportions", FULL + f""" SELECT segment, {r(6, treatment_rate='p_t*100', control_rate='p_c*100')},
    psig AS proportion_is_significant FROM h""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "conversion"))


@query("chart_power", checks.power_columns(f"""{EV}, base AS (SELECT segment, {D_SQL} AS d, CAST(n_t AS DOUBLE) AS n1,
    CAST(n_c AS DOUBLE) AS n2 FROM m)""") + f""" SELECT segment, {r(6, power_percent='100*power')},
    80.0::DOUBLE AS target_percent, power >= 0.8 AS is_adequate FROM pw""")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "power"))


@query("chart_dashboard", FULL_POWER + f""" SELECT h.segment, {r(6, treatment_mean='mean_t', control_mean='mean_c',
    effect_size=checks.RAW, p_value='pv', power='power')}, n_t AS treatment_size, n_c AS control_size
    FROM h JOIN pw ON pw.segment = h.segment""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "dashboard"))


@query("chart_statistical_summary", FULL_POWER + f""" SELECT h.segment, n_t AS treatment_size, n_c AS control_size,
    {r(6, effect_size=checks.RAW, cohens_d=checks.RAW + """
    / sqrt(((n_t-1)*var_t + (n_c-1)*var_c)/(n_t+n_c-2))""", p_value='pv', total_effect='(te + pe)*n_t', power='power',
    bayesian_prob_treatment_better=checks.normal_cdf(checks.RAW + "/sqrt(var_t/n_t + var_c/n_c)"))}
    FROM h JOIN pw ON pw.segment = h.segment""")
def _(spark, d):
    return rounded(presentation.chart_table(_orders_result(spark, d), "statistical_summary"))


BAYES_EV = f"""{EV}, b AS (SELECT *, {checks.RAW} AS mu, sqrt(var_t/n_t + var_c/n_c) AS sd FROM m),
    c AS (SELECT *, {checks.normal_cdf('mu/sd')} AS pb,
    sd*exp(-mu*mu/(2*sd*sd))/sqrt(2*pi()) - mu*({checks.normal_cdf('-mu/sd')}) AS lt FROM b)"""


@query("chart_bayesian_probability", BAYES_EV + f""" SELECT segment, {r(5, probability_percent='pb*100')},
    CASE WHEN pb > 0.95 THEN 'positive' WHEN pb < 0.05 THEN 'negative' ELSE 'neutral' END AS direction FROM c""")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "probability"), 5)


@query("chart_credible_intervals", BAYES_EV + f""" SELECT segment, {r(6, effect_size='mu',
    bayesian_credible_lower=f'mu - {Z}*sd', bayesian_credible_upper=f'mu + {Z}*sd')},
    CASE WHEN (pb > 0.95 OR pb < 0.05) AND mu > 0 THEN 'positive' WHEN (pb > 0.95 OR pb < 0.05) AND mu < 0 THEN 'negative'
    ELSE 'neutral' END AS direction FROM c""")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "credible"))


@query("chart_expected_loss", BAYES_EV + f""" SELECT segment, {r(5, expected_loss='least(lt, lt + mu)')},
    CASE WHEN lt <= lt + mu THEN 'treatment' ELSE 'control' END AS preferred_arm FROM c""")
def _(spark, d):
    return rounded(presentation.chart_table(_core(segment_moments(rows_of(spark, d))), "loss"), 5)


@query("report_prepost", f"""{US}, a AS (SELECT segment, n_t, n_c, xmean_t AS mean_t, xmean_c AS mean_c, xvar_t AS var_t,
    xvar_c AS var_c FROM m), {WELCH.replace('FROM m)', 'FROM a)')} SELECT m.segment, {checks.t_both_tails('t', 'df')} > 0.05
    AS aa_test_passed, false AS bootstrapping_applied, {r(6, treatment_pre_mean='xmean_t', control_pre_mean='xmean_c',
    treatment_post_mean='m.mean_t', control_post_mean='m.mean_c', did_effect='dmean_t - dmean_c')}
    FROM m JOIN x ON x.segment = m.segment""")
def _(spark, d):
    res = analyze(views.view(spark, d, views.USERS), PRE).results
    return rounded(presentation.prepost_report(res))


@query("report_frequentist", FULL + f""" SELECT segment, n_t AS treatment_size, n_c AS control_size, {r(6, p_value='pv')},
    sig AS is_significant, {r(6, effect_size=checks.RAW, proportion_p_value='ppv')}, psig AS proportion_is_significant,
    {r(6, proportion_effect_per_customer='pe', total_effect='(te + pe)*n_t')} FROM h""")
def _(spark, d):
    return rounded(presentation.frequentist_report(_orders_result(spark, d)))


@query("report_bayesian", BAYES_EV + f""" SELECT segment, {r(5, bayesian_prob_treatment_better='pb',
    bayesian_credible_lower=f'mu - {Z}*sd', bayesian_credible_upper=f'mu + {Z}*sd', expected_loss='least(lt, lt + mu)',
    bayesian_total_effect='mu*n_t')}, pb > 0.95 OR pb < 0.05 AS bayesian_is_significant FROM c""")
def _(spark, d):
    return rounded(presentation.bayesian_report(_core(segment_moments(rows_of(spark, d)))), 5)


@query("truncated_rows", """SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    df = views.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return presentation.truncated(df, 20, order=[F.desc("n"), "l_suppkey"])[0]


@query("truncation_notice", """SELECT least(count(DISTINCT l_suppkey), 20) AS shown_rows, count(DISTINCT l_suppkey) AS total_rows,
    CASE WHEN count(DISTINCT l_suppkey) > 20 THEN 'showing first 20 of ' || count(DISTINCT l_suppkey) || ' rows' END
    AS notice FROM lineitem""")
def _(spark, d):
    df = views.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return presentation.truncated(df, 20)[1]


# --- whole flows ----------------------------------------------------------------------

FLOW_SQL = MANY_SQL + f""", f AS (SELECT *, (n_t-n_c)*(n_t-n_c)/(n_t+n_c) AS chi FROM a) SELECT CAST(segment AS VARCHAR) AS segment,
    n_t AS treatment_size, n_c AS control_size, {r(4, effect_size=checks.RAW)}, {r(6, p_value='p', p_value_adjusted='adj')},
    p < 0.05 AND {checks.both_tails('sqrt(chi)')} >= 0.05 AS is_significant FROM f"""


@query("segmented_analysis", FLOW_SQL)
def _(spark, d):
    res = analyze(views.view(spark, d, MANY), ROLES).results
    return res.select("segment", "treatment_size", "control_size", F.round("effect_size", 4).alias("effect_size"),
                      F.round("p_value", 6).alias("p_value"), F.round("p_value_adjusted", 6).alias("p_value_adjusted"),
                      "is_significant")


def _flow_sql(start: str, extra: str = "") -> str:
    return start + f""" SELECT segment, segment = 'Overall' AS is_overall, n_t AS treatment_size, n_c AS control_size,
        {r(6, treatment_mean='mean_t', control_mean='mean_c', effect_size=checks.RAW, cohens_d=f"""{checks.RAW}
        / sqrt(((n_t-1)*var_t + (n_c-1)*var_c)/(n_t+n_c-2))""", variance_ratio='greatest(var_t, var_c)/least(var_t, var_c)',
        srm_p_value=checks.both_tails('sqrt((n_t-n_c)*(n_t-n_c)/(n_t+n_c))'))}{extra} FROM o"""


def _flow(results: DataFrame, *extra: str) -> DataFrame:
    return rounded(results.select(
        "segment", "is_overall", "treatment_size", "control_size", "treatment_mean", "control_mean", "effect_size",
        "cohens_d", "variance_ratio", "srm_p_value", *extra))


POSTERIOR = {"bayesian_prob_treatment_better": checks.normal_cdf(f"{checks.RAW}/sqrt(var_t/n_t + var_c/n_c)"),
             "bayesian_credible_lower": f"{checks.RAW} - {Z}*sqrt(var_t/n_t + var_c/n_c)",
             "bayesian_credible_upper": f"{checks.RAW} + {Z}*sqrt(var_t/n_t + var_c/n_c)",
             "bayesian_relative_uplift": f"{checks.RAW}/mean_c", "bayesian_total_effect": f"{checks.RAW}*n_t"}
FITTED = {"p_value": checks.both_tails(f"{checks.RAW}/{checks.HC3_SE}"), "ci_lower": f"{checks.RAW} - {Z}*{checks.HC3_SE}",
          "ci_upper": f"{checks.RAW} + {Z}*{checks.HC3_SE}"}


def _by_family(name: str, robust: str) -> str:
    return f"round(CASE WHEN metric_type = 'heavy_tail' THEN {robust} ELSE a.{name} END, 5) AS {name}"


@query("analyze", f"""SELECT a.* EXCLUDE (p_value, ci_lower, ci_upper), coalesce(metric_type, 'continuous') AS metric_type,
    CASE WHEN metric_type = 'heavy_tail' THEN 'rlm_huber' ELSE 'ols_hc3' END AS model_type,
    {_by_family('p_value', checks.both_tails('b.effect/b.se'))}, {_by_family('ci_lower', f'b.effect - {Z}*b.se')},
    {_by_family('ci_upper', f'b.effect + {Z}*b.se')}, {r(6, power='power', achieved_mde='mde')},
    required_n AS required_sample_size, power >= 0.8 AS is_sample_adequate FROM ({_flow_sql(f"""{EV}, o AS (SELECT * FROM m UNION ALL SELECT * FROM
    ({checks.moments(views.EVENTS, by="'Overall'").replace('WITH v AS', 'WITH v2 AS').replace('FROM v ', 'FROM v2 ')}
    SELECT * FROM m))""", ", " + r(9, **FITTED) + ", " + r(6, **POSTERIOR))}) a JOIN (SELECT * FROM ({POWER_SQL} SELECT * FROM pw)) w ON w.segment = a.segment
    LEFT JOIN ({FAMILY_SQL}) f ON f.segment = 'value:' || a.segment LEFT JOIN ({checks.huber(views.EVENTS)} SELECT * FROM h) b ON b.segment = a.segment""")
def _(spark, d):
    # the default analysis, whole; shown are the columns that SQL can express
    res = analyze(views.view(spark, d, views.EVENTS), views.roles(customer_id="user_id"), Options(scope="both")).results
    res = res.withColumns({k: F.round(c(k), 5) for k in FITTED})
    return _flow(res, "metric_type", "model_type", "power", "achieved_mde", "required_sample_size", "is_sample_adequate",
                 *FITTED, *POSTERIOR)


@query("auto_analyze", _flow_sql(f"{US}, o AS (SELECT * FROM m)", ", " + r(
    6, did_treatment_change="dmean_t", did_control_change="dmean_c", did_effect="dmean_t - dmean_c")))
def _(spark, d):
    df = views.view(spark, d, views.USERS).withColumnsRenamed(
        {"grp": "experiment_group", "pre": "pre_effect", "post": "post_effect"})
    return _flow(auto_analyze(df).results, "did_treatment_change", "did_control_change", "did_effect")
