"""Metric family of each segment: binary, count, heavy-tailed or continuous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.config import Options
from armlift.functions.guards import VARIANCE_EPSILON
from armlift.operators.moments import aligned_rows
from armlift.operators.order_stats import percentiles, pooled
from armlift.session import attach, stage

# Fixed values of the family rules.
HEAVY_MIN_N = 20
HEAVY_SKEW = 2.0
HEAVY_KURTOSIS = 7.0
HEAVY_RATIO = 15.0
OVERDISPERSION = 1.5


def sample_skewness(skew: Column, n: Column) -> Column:
    """Spark's population skewness turned into the bias-corrected G1."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(kurt: Column, n: Column) -> Column:
    """Spark's population excess kurtosis turned into the bias-corrected G2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))


def with_shape(m: DataFrame) -> DataFrame:
    n = (F.col("n_t") + F.col("n_c")).cast("double")
    return m.withColumns({
        "g1": sample_skewness(F.col("skew"), n),
        "g2": sample_kurtosis(F.col("kurt"), n),
    })


def metric_family(m: DataFrame, rows: DataFrame | None, options: Options, hist: DataFrame | None = None) -> DataFrame:
    """Add ``metric_type``.

    Flags and moments from the single grouped job settle nearly every segment.
    Only segments that they leave open get exact percentiles, from ``rows`` and,
    where the caller shares it, the staged histogram of the analysed rows by arm.
    """
    if options.metric_type != "auto":
        return m.withColumn("metric_type", F.lit(options.metric_type))
    m = with_shape(m)
    n = F.col("n_t") + F.col("n_c")
    by_shape = (n >= HEAVY_MIN_N) & ((F.abs("g1") > HEAVY_SKEW) | (F.col("g2") > HEAVY_KURTOSIS))
    first = (
        F.when(F.col("is01"), "binary")
        .when(F.col("whole"), "count")
        .when(F.coalesce(by_shape, F.lit(False)), "heavy_tail")
    )
    flat = (n < HEAVY_MIN_N) | F.col("g1").isNull() | F.col("g2").isNull()
    first = first.when(flat, "continuous")
    m = m.withColumn("metric_type", first)
    if rows is None:
        # never guessed: a segment that its moments leave open stops the query
        return m.withColumn("metric_type", F.coalesce("metric_type", F.raise_error(F.concat(
            F.lit("rows are needed to tell the family of segment "), F.col("segment"))).cast("string")))
    m = stage(m)
    undecided = stage(m.where(F.col("metric_type").isNull()).select("segment", "view"))
    if undecided.isEmpty():
        return m
    part = aligned_rows(rows, undecided)
    if hist is not None:
        hist = pooled(attach(hist, undecided.select("segment"), ["segment"]), ["segment"])
    pct = percentiles(part, ["segment"], "y", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, hist)
    spread = F.sqrt("var_all")
    by_tail = F.when(
        F.abs("p50") <= VARIANCE_EPSILON,
        (F.col("p99") - F.col("p95")) > F.greatest(5.0 * spread, F.lit(1.0)),
    ).otherwise(F.abs(F.col("p99") / F.col("p50")) > HEAVY_RATIO)
    return (
        m.join(pct.drop("n"), "segment", "left")
        .withColumn("metric_type", F.coalesce(
            "metric_type", F.when(by_tail, "heavy_tail").otherwise("continuous")))
        .drop("p50", "p95", "p99")
    )
