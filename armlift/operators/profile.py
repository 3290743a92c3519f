"""Table profile, column statistics and group/segment distributions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlift.config import Roles
from armlift.functions.guards import sanitize_numeric
from armlift.operators.order_stats import percentiles, pooled

BUCKET_SHIFT = 43  # of a double's bits: 512 buckets from one power of two to the next
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, quartiles: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls and numeric summary.

    Everything but the quartiles is a single aggregation over all columns; the
    exact quartiles cost a few bounded-memory passes more and are optional.
    """
    numeric = set(numeric_columns(df))
    nothing = F.lit(None).cast("double")
    cells = []
    for i, f in enumerate(df.schema.fields):
        v = F.col(f"`{f.name}`")
        is_num = f.name in numeric
        d = v.cast("double")
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("row_count"), F.count(v).alias("non_null"),
            F.count_if(v.isNull()).alias("missing"),
            *[(e if is_num else nothing).alias(n) for n, e in (
                ("mean", F.avg(d)), ("std", F.stddev_samp(d)), ("min", F.min(d)), ("max", F.max(d)))]))
    out = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    if not quartiles or not numeric:
        return out
    return out.join(quartile_rows(df, sorted(numeric)), "column", "left")


def _bucket_counts(batches, names: list[str]):
    """Rows, least and greatest value per column and bucket of one task's rows.

    The bucket is the leading bits of the value: monotone, and the same on any machine.
    """
    import numpy as np
    import pyarrow as pa

    def reduced(b, cnt, lo, hi):
        order = np.argsort(b, kind="stable")
        b, cnt, lo, hi = b[order], cnt[order], lo[order], hi[order]
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
        if not len(at):
            return b, cnt, lo, hi
        return b[at], np.add.reduceat(cnt, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)

    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in names]
    for batch in batches:
        for j in range(len(names)):
            v = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
            bits = np.abs(v).view(np.int64) >> BUCKET_SHIFT
            new = reduced(np.where(v < 0, -bits, bits), np.ones(len(v), np.int64), v, v)
            held[j] = reduced(*(np.concatenate(x) for x in zip(held[j], new)))
    for name, (b, cnt, lo, hi) in zip(names, held):
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(b), pa.string()), *map(pa.array, (b, cnt, lo, hi))], ["column", "_b", "_cnt", "_lo", "_hi"])


def quartile_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact quartiles of numeric columns, one row per column.

    Two scans, however many columns: tasks count buckets side by side, then only the
    values inside the at most six buckets of a column that hold a wanted rank become
    rows. (A bucket of over ``order_stats.SMALL_BRACKET`` rows takes a scan more.)
    """
    values = df.select(*[sanitize_numeric(F.col(f"`{n}`")).alias(f"v{i}") for i, n in enumerate(columns)])
    parts = values.mapInArrow(partial(_bucket_counts, names=columns), "column string, _b bigint, _cnt bigint, _lo double, _hi double")
    hist = pooled(parts, ["column"])

    def open_values(todo: DataFrame) -> DataFrame:
        cells = []
        for row in todo.select("column", "_b", "_from", "_to").collect():  # six a column at most
            v = F.col(f"v{columns.index(row['column'])}")
            cells.append(F.when(v.between(row["_from"], row["_to"]), F.struct(
                F.lit(row["column"]).alias("column"), F.lit(row["_b"]).alias("_b"), v.alias("_v"))))
        return values.select(F.inline(F.array_compact(F.array(*cells))))

    return percentiles(open_values, ["column"], "v", QUARTILES, hist).drop("n")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, quartiles, deviation, range and missing values of a numeric column."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    if column not in numeric_columns(df):
        raise ValueError(f"Column '{column}' is not numeric (type: {df.schema[column].dataType.simpleString()})")
    v = sanitize_numeric(F.col(column))
    basic = df.agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("missing"))
    pct = quartile_rows(df, [column])
    # Both tables have one row; the quartiles enter as a scalar subquery.
    quart = pct.select(F.struct(*QUARTILES).alias("q")).scalar()
    return basic.withColumn("_q", quart).select("*", *[F.col(f"_q.{k}").alias(k) for k in QUARTILES]).drop("_q")


def column_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Values with counts, most frequent first; with a limit, also how many distinct values are not shown."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.count(F.lit(1)).alias("distinct_values"))
    top = counts.orderBy(F.desc("count"), "value")
    shown = top.withColumn("distinct_values", total.scalar())
    if limit is None:
        return shown.withColumn("omitted", F.lit(0).cast("bigint"))
    return shown.limit(limit).withColumn(
        "omitted", F.greatest(F.col("distinct_values") - limit, F.lit(0).cast("bigint")))


def distribution(df: DataFrame, roles: Roles) -> DataFrame:
    """Counts by group, by segment and by both, in one grouped pass.

    The pairs are counted first, so the grouping sets expand only the few pairs.
    """
    g = F.col(roles.group).cast("string").alias("group_value")
    if not roles.segment:
        return df.where(F.col(roles.group).isNotNull()).groupBy(g).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("group").alias("level"), "group_value", F.lit(None).cast("string").alias("segment"), "n")
    pairs = df.groupBy(g, F.col(roles.segment).cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    sets = pairs.groupingSets(
        [["group_value"], ["segment"], ["group_value", "segment"]], "group_value", "segment",
    ).agg(F.sum("n").alias("n"), F.grouping_id("group_value", "segment").alias("gid"))
    level = F.when(F.col("gid") == 1, "group").when(F.col("gid") == 2, "segment").otherwise("group_segment")
    complete = (
        F.when(F.col("gid") == 1, F.col("group_value").isNotNull())
        .when(F.col("gid") == 2, F.col("segment").isNotNull())
        .otherwise(F.col("group_value").isNotNull() & F.col("segment").isNotNull()))
    return sets.where(complete).select(level.alias("level"), "group_value", "segment", "n")


def cross_tab(df: DataFrame, roles: Roles) -> DataFrame:
    """Segments down, the two arms across."""
    return df.where(F.col(roles.segment).isNotNull()).groupBy(
        F.col(roles.segment).cast("string").alias("segment")).agg(
        F.count_if(F.col(roles.group) == F.lit(roles.treatment)).alias("treatment"),
        F.count_if(F.col(roles.group) == F.lit(roles.control)).alias("control"))


def group_values(df: DataFrame, group: str) -> DataFrame:
    return df.select(F.col(group).alias("value")).where("value is not null").distinct()
