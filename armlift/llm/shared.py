"""Tables in the folder that driver and executors share, and small checks used by several operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once, read as often as needed: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a saved narrow table for broadcast only when its counted rows stay under the bound."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def worker_cache(key, make):
    """What ``make`` returns, made once per Python process. Functions may reach workers by value, with copies of their
    module's variables, so the store hangs on a module that every process has."""
    store = vars(sys).setdefault("_llm_worker_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def slices(sizes, limit: int):
    """Consecutive (start, stop) ranges of rows with about ``limit`` bytes each, one row at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def private(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Match rows of ``docs`` with keys (id_, hash_): a doc_id and a hash of the text."""
    return docs["doc_id"].cast("bigint").eqNullSafe(keys["id_"]) & (F.xxhash64(text_or_empty(docs["text"])) == keys["hash_"])


def without(docs: DataFrame, verdicts: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` that no verdict (doc_id, text_hash, kept) rejects, with their columns as they are."""
    gone = save(verdicts.where("NOT kept").select(
        F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct(), "rejected")
    return docs.join(broadcast_if_small(gone, max_rows), same_row(docs, gone), "left_anti")
