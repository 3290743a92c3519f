"""Repeated units and units seen in more than one arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.config import Roles
from armlift.operators.arms import each_scope, has_pooled, scope_column

REPEAT_TEXT = "%d unit(s) appear more than once in one arm: roll rows up to units before testing"
CROSS_TEXT = "%d unit(s) were seen in BOTH arms: find out how units are assigned"


def duplicate_units(df: DataFrame, roles: Roles, scope: str = "overall") -> DataFrame:
    """Per segment: distinct units, rows, repeats within an arm, units in several arms.

    Three nested partial aggregations instead of a distinct count: a unit with a
    third of all rows is one counter per map task, and nothing is expanded. All
    values of the group column count, not only the two arms; null units do not.
    """
    if not roles.customer_id or roles.customer_id not in df.columns:
        base = df.select(scope_column(roles, scope))
        pooled = has_pooled(base)
        base = base.groupBy("segment").agg(F.count(F.lit(1)).alias("total_rows"))
        if pooled:
            base = each_scope(base).groupBy("segment").agg(F.sum("total_rows").alias("total_rows"))
        base = base.where("segment is not null")
        return base.select(
            "segment", F.lit(False).alias("is_applicable"), F.lit(0).cast("bigint").alias("unique_units"),
            "total_rows", F.lit(0).cast("bigint").alias("within_arm_repeats"),
            F.lit(0).cast("bigint").alias("cross_arm_units"), F.lit(False).alias("has_duplicates"),
            F.lit("").alias("warning"))
    slim = df.select(
        scope_column(roles, scope),
        F.col(roles.customer_id).alias("unit"),
        F.col(roles.group).alias("grp"),
    )
    per_arm = slim.groupBy("segment", "unit", "grp").agg(F.count(F.lit(1)).alias("k"))
    if has_pooled(slim):  # counts of the pooled group are sums of the segments' counts
        per_arm = each_scope(per_arm).groupBy("segment", "unit", "grp").agg(F.sum("k").alias("k"))
    per_arm = per_arm.where("segment is not null")
    named = F.col("grp").isNotNull()
    per_unit = per_arm.groupBy("segment", "unit").agg(
        F.sum("k").alias("k"),
        F.count_if(named & (F.col("k") > 1)).alias("repeats"),
        F.count_if(named).alias("arms"),
    )
    known = F.col("unit").isNotNull()
    out = per_unit.groupBy("segment").agg(
        F.count_if(known).alias("unique_units"),
        F.sum("k").alias("total_rows"),
        F.sum(F.when(known, F.col("repeats")).otherwise(0)).alias("within_arm_repeats"),
        F.count_if(known & (F.col("arms") > 1)).alias("cross_arm_units"),
    )
    repeats, cross = F.col("within_arm_repeats"), F.col("cross_arm_units")
    text = F.concat_ws(
        "; ",
        F.when(repeats > 0, F.format_string(REPEAT_TEXT, repeats)),
        F.when(cross > 0, F.format_string(CROSS_TEXT, cross)),
    )
    return out.select(
        "segment", (F.col("unique_units") > 0).alias("is_applicable"), "unique_units", "total_rows",
        "within_arm_repeats", "cross_arm_units", ((repeats > 0) | (cross > 0)).alias("has_duplicates"),
        text.alias("warning"))
