"""Column guards against non-finite numbers and invalid p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values shared by every test.
VARIANCE_EPSILON = 1e-12
TINY = 1e-12
MIN_SAMPLE = 8
MIN_CELL = 5


def not_nan(c: Column) -> Column:
    """NaN counts as missing, like null."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def sanitize_numeric(c: Column) -> Column:
    """Finite values only; NaN and infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def non_finite_count(c: Column) -> Column:
    """Aggregate: how many non-null values are NaN or infinite."""
    return F.count_if(c.isNotNull() & sanitize_numeric(c).isNull())


def sanitize_p(c: Column, fallback: float = 1.0) -> Column:
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0), c).otherwise(F.lit(fallback))


def zero_if_tiny(c: Column, tol: float = TINY) -> Column:
    return F.when(F.abs(c) < tol, F.lit(0.0)).otherwise(c)


# Text forms, for formulas over the segment statistics.

def valid_p(p: str, fallback: float = 1.0) -> str:
    """NaN is above every number in Spark's order, so BETWEEN excludes it."""
    return f"CASE WHEN {p} BETWEEN 0 AND 1 THEN {p} ELSE {fallback}D END"


def snapped(x: str, tol: float = TINY) -> str:
    return f"CASE WHEN abs({x}) < {tol}D THEN 0D ELSE {x} END"


def reason_list(*pairs: tuple[str, str]) -> str:
    """Array of the reasons whose condition holds, in the order given."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for cond, text in pairs)
    return f"array_compact(array({items}))"


def add(df: DataFrame, **columns: str) -> DataFrame:
    """Add or replace columns given as SQL text; all see the columns before the call."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})
