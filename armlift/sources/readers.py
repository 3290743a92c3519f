"""Reading experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from armlift.operators.profile import shape


def read_experiment(
    spark: SparkSession, path: str, format: str = "csv", schema: StructType | str | None = None, **options,
) -> DataFrame:
    """Lazy read of any Spark format. CSV gets a header; types are inferred only without a schema."""
    reader = spark.read.format(format)
    defaults = {"header": "true"} if format == "csv" else {}
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        defaults["inferSchema"] = "true"
    return reader.options(**{**defaults, **options}).load(path)


def from_dataframe(df: DataFrame) -> DataFrame:
    """An existing DataFrame as it is; the caller decides about persisting."""
    return df


def describe_source(df: DataFrame) -> DataFrame:
    """Columns with types, the row count and the schema text, one row per column."""
    rows = shape(df).select("row_count").scalar()
    fields = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(f.nullable).alias("nullable"))
        for i, f in enumerate(df.schema.fields)]))
    one = df.sparkSession.range(1).select(fields.alias("f")).select("f.*")
    return one.withColumn("row_count", rows)
