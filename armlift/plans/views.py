"""Experiment views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armlift.config import Roles

# Each view is one SELECT, used as it is by Spark and by the checking database.
ARM = "CASE WHEN {key} % 2 = 0 THEN 'treatment' ELSE 'control' END"

EVENTS = f"""SELECT event_id, user_id, event_type AS segment, {ARM.format(key='user_id')} AS grp,
    value AS y, ts FROM events"""
EVENTS_WITH_GAPS = f"""SELECT event_id, user_id, {ARM.format(key='user_id')} AS grp,
    CASE WHEN event_id % 2500 = 7 THEN 'rare' || CAST(event_id AS VARCHAR(20)) ELSE event_type END AS segment,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS y FROM events"""
EVENTS_BROKEN = """SELECT event_id, event_type AS segment,
    CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 75 = 1 THEN CAST('Infinity' AS DOUBLE)
    WHEN event_id % 90 = 2 THEN NULL ELSE value END AS y FROM events"""
USERS = f"""SELECT user_id, event_type AS segment, {ARM.format(key='user_id')} AS grp,
    sum(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value END) AS pre,
    sum(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value END) AS post,
    count(*) AS events, sum(value) AS total FROM events GROUP BY user_id, event_type"""
CUSTOMERS = f"""SELECT o_custkey, c_mktsegment AS segment, c_acctbal, {ARM.format(key='o_custkey')} AS grp,
    avg(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN o_totalprice END) AS pre,
    avg(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN o_totalprice END) AS post
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment, c_acctbal"""
ORDERS = f"""SELECT o_orderkey, o_orderpriority AS segment, {ARM.format(key='o_custkey')} AS grp,
    CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders"""
LINES = f"""SELECT l_orderkey, l_linenumber, l_returnflag AS segment, {ARM.format(key='l_orderkey')} AS grp,
    l_quantity AS y, l_extendedprice, l_discount FROM lineitem"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def roles(pre: str | None = None, outcome: str = "y", segment: str | None = "segment", **more) -> Roles:
    return Roles("grp", outcome, "treatment", "control", pre_effect=pre, segment=segment, **more)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run a view's SELECT over the tables of one folder."""
    words = set(sql.replace("\n", " ").split())
    used = [t for t in TABLES if t in words]
    text = sql
    for t in used:
        text = " ".join(f"parquet.`{folder}/{t}.parquet`" if w == t else w for w in text.split())
    return spark.sql(text)
