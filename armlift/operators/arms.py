"""From any table to analysis rows: segment, arm, outcome and optional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.config import Roles
from armlift.functions.guards import not_nan, sanitize_numeric

OVERALL = "Overall"


def segment_slice(df: DataFrame, roles: Roles, segment=None) -> DataFrame:
    """Rows of one segment; without a segment the whole table."""
    if segment is None or not roles.segment:
        return df
    return df.where(F.col(roles.segment) == F.lit(segment))


def arm_of(roles: Roles) -> Column:
    """'t', 'c' or null for labels outside the experiment."""
    label = F.col(roles.group)
    return F.when(label == F.lit(roles.treatment), F.lit("t")).when(label == F.lit(roles.control), F.lit("c"))


def split_arms(df: DataFrame, roles: Roles) -> DataFrame:
    """Keep treatment and control rows, tagged with ``arm``."""
    return df.withColumn("arm", arm_of(roles)).where(F.col("arm").isNotNull())


def is_pooled(roles: Roles, scope: str) -> bool:
    """Whether the whole table stands beside its segments."""
    return scope == "both" and bool(roles.segment)


def scope_column(roles: Roles, scope: str) -> Column:
    """Segment label of a row. In scope ``both`` the pooled group is told by the column's metadata, and rows without a
    segment have a null label: they count in the pooled group only."""
    if scope == "overall" or not roles.segment:
        return F.lit(OVERALL).alias("segment")
    label = F.col(roles.segment).cast("string")
    if scope == "segments":
        return label.alias("segment")
    # a segment of that very name must not mix with the pooled rows
    label = F.when(label == OVERALL, f"{OVERALL} (segment)").otherwise(label)
    return label.alias("segment", metadata={"pooled": True})


def has_pooled(rows: DataFrame) -> bool:
    return bool(rows.schema["segment"].metadata.get("pooled"))


def each_scope(rows: DataFrame) -> DataFrame:
    """Rows once for every group they count in: for steps whose pooled result is no sum over segments."""
    if not has_pooled(rows):
        return rows
    groups = F.explode(F.array_compact(F.array("segment", F.lit(OVERALL))))
    return rows.select(groups.alias("segment", metadata={}), *[c for c in rows.columns if c != "segment"])


def mark_overall(results: DataFrame, pooled: bool) -> DataFrame:
    """``is_overall`` is true where a row pools the segments that stand beside it."""
    return results.withColumn("is_overall", (F.col("segment") == OVERALL) & F.lit(pooled))


def segment_rows(results: DataFrame) -> DataFrame:
    """Results without the pooled row, for everything that adds up or counts segments."""
    return results.where("NOT is_overall") if "is_overall" in results.columns else results


def analysis_rows(
    df: DataFrame,
    roles: Roles,
    scope: str = "segments",
    covariates: tuple[str, ...] = (),
    unit: bool = False,
    look: str | None = None,
) -> DataFrame:
    """Project the needed columns only: segment, arm, y[, x][, c0..][, unit][, look].

    Missing values stay null here; each operator decides which rows are complete. In
    scope ``both`` a row is still one row: moments of the pooled group are merged
    from those of the segments, other steps take :func:`each_scope`.
    """
    roles.check(df)
    cols = [scope_column(roles, scope), arm_of(roles).alias("arm"),
            not_nan(F.col(roles.outcome)).alias("y")]
    if roles.usable_pre(df):
        cols.append(sanitize_numeric(F.col(roles.pre_effect)).alias("x"))
    cols += [sanitize_numeric(F.col(c)).alias(f"c{i}", metadata={"is_pre": c == roles.pre_effect})
             for i, c in enumerate(covariates)]
    if unit and roles.customer_id:
        cols.append(F.col(roles.customer_id).cast("string").alias("unit"))
    if look:
        cols.append(F.col(look).cast("int").alias("look"))
    rows = df.select(*cols).where(F.col("arm").isNotNull())
    return rows if is_pooled(roles, scope) else rows.where(F.col("segment").isNotNull())
