"""Writing results, publishing tables and reading them back with SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW, RESULTS = "raw_data", "analysis_segment_results"
SUMMARY, FAILURES = "analysis_summary", "analysis_segment_failures"
DATA_VIEW = "ab_test_data"

# Filters that select everything. Fixed values.
MATCH_ALL = ("*", "all", "true", "1 == 1", "1==1", "index == index", "index==index")
_NOT_READ = ("Command", "ParsedStatement", "InsertIntoStatement")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_results_partitioned(
    df: DataFrame, path: str, format: str = "delta", partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Any Spark sink format; Delta needs its package on the session's class path.

    With mode ``overwrite_partitions`` only the partitions that ``df`` has are
    replaced; other modes are Spark's own.
    """
    if mode == "overwrite_partitions":
        if not partition_by:
            raise ValueError("partitions can only be replaced where partition_by names them")
        writer = df.write.format(format).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = df.write.format(format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def publish_tables(
    raw: DataFrame | None = None, results: DataFrame | None = None, summary: DataFrame | None = None,
    failures: DataFrame | None = None, managed: bool = False, folder: str | None = None,
) -> list[str]:
    """Replace the four queryable tables, as temporary views or as tables of the catalog.

    Catalog tables are written to the warehouse, or below ``folder``. A view of the
    same name would hide such a table, so it is dropped.
    """
    done = []
    for name, df in ((RAW, raw), (RESULTS, results), (SUMMARY, summary), (FAILURES, failures)):
        if df is None:
            continue
        if managed:
            df.sparkSession.catalog.dropTempView(name)
            writer = df.write.mode("overwrite")
            (writer.option("path", f"{folder}/{name}") if folder else writer).saveAsTable(name)
        else:
            df.createOrReplaceTempView(name)
        done.append(name)
    return done


def unpublish_tables(spark: SparkSession) -> None:
    """Take the published views and tables out of the session's catalog."""
    for name in (RAW, RESULTS, SUMMARY, FAILURES):
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def describe_tables(spark: SparkSession) -> DataFrame:
    """One row per column of every published table that exists."""
    rows = []
    for name in (RAW, RESULTS, SUMMARY, FAILURES):
        if spark.catalog.tableExists(name):
            rows += [(name, i, f.name, f.dataType.simpleString())
                     for i, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column string, dtype string")


def _nodes(plan):
    yield plan
    inner = plan.children()
    for i in range(inner.size()):
        yield from _nodes(inner.apply(i))
    if plan.nodeName() == "UnresolvedWith":
        for i in range(plan.cteRelations().size()):
            yield from _nodes(plan.cteRelations().apply(i)._2())


def parsed_read(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables that one query reads; anything but a query is an error."""
    from py4j.java_gateway import is_instance_of

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # the JVM's parse error reaches Python under several names
        raise ValueError("not one readable query") from error
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    gateway = spark.sparkContext._gateway
    tables, defined = set(), set()
    for node in _nodes(plan):
        if any(is_instance_of(gateway, node, logical + kind) for kind in _NOT_READ):
            raise ValueError("the text changes or lists things; only queries are run")
        if node.nodeName() == "UnresolvedRelation":
            tables.add(node.tableName().replace("`", ""))
        if node.nodeName() == "UnresolvedWith":
            defined |= {node.cteRelations().apply(i)._1() for i in range(node.cteRelations().size())}
    return sorted(tables - defined)


def _limited(df: DataFrame, max_rows: int | None) -> DataFrame:
    if max_rows is None:
        return df
    if int(max_rows) <= 0:
        raise ValueError("max_rows must be positive")
    return df.limit(int(max_rows))


def filter_rows(df: DataFrame, where: str, max_rows: int | None = None) -> DataFrame:
    """Rows that meet a SQL condition; all of them unless the caller sets a limit.

    Empty and match-all filters are errors."""
    text = (where or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("no condition given")
    if text.lower() in MATCH_ALL:
        raise ValueError("the condition selects every row")
    try:
        chosen = df.where(F.expr(text))  # the parser takes one expression and nothing that writes
    except ParseException as error:
        raise ValueError(f"not a condition: {text}") from error
    return _limited(chosen, max_rows)


def query(df: DataFrame, sql: str, max_rows: int | None = None) -> DataFrame:
    """A SELECT over the view ``ab_test_data``, or a bare condition on it."""
    text = (sql or "").strip().rstrip(";").strip()
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        return filter_rows(df, text, max_rows)
    parsed_read(df.sparkSession, text)
    df.createOrReplaceTempView(DATA_VIEW)
    return _limited(df.sparkSession.sql(text), max_rows)


@dataclass(frozen=True)
class Answer:
    sql: str
    data: DataFrame
    source_tables: tuple[str, ...]

    @property
    def row_count(self) -> int:
        return self.data.count()


def query_results(spark: SparkSession, sql: str, max_rows: int | None = None) -> Answer:
    """A query over the published tables; all its rows unless the caller sets a limit."""
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("no query given")
    tables = parsed_read(spark, text)
    return Answer(text, _limited(spark.sql(text), max_rows), tuple(tables))
