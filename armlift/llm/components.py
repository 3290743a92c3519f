"""Connected components of an edge table by alternating large-star and small-star steps, all in joins of Spark.

Every step keeps connectivity and only moves edges towards smaller ends. The least neighbour of a node comes from partial
minima and is joined back by node and salt, so that a hub of any size is spread over tasks and never a list. Steps are written to the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.shared import save

SALTS = 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with ``m``, the least ``b`` of its ``a``. A hub's edges are spread over ``SALTS`` tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    least = salted.groupBy("a", "salt").agg(F.min("b").alias("m")).groupBy("a").agg(
        F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _with_least(down)
    moved = least.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): each node of an (a, b) edge table with the smallest node that it reaches; roots included."""
    now = save(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while True:
        now = save(_small_star(_large_star(now)), name)
        state, before = _state(now), state
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
