"""Exact duplicates with a heavy-hitter split, in DataFrame and SQL functions only.

Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.

1. One scan of the texts writes a narrow table (doc_id, row, SHA-256 of the normalised text, 64-bit key of it).
2. Misra-Gries summaries over the keys, one per hash shard, find the frequent digests. ``approx_top_k`` is Spark's mergeable
   summary of that family: a fixed number of counters, all lowered together when they run out. Summaries are made in
   the map tasks and merged shard by shard, so nothing grows with the copies of a digest.
3. Frequent digests are verified: their rows are counted exactly by full digest, and the winner is the largest (doc_id, row).
   At most ``SHARDS * TOP`` keys are frequent; the winners are broadcast behind a check of their number, and every copy of
   a frequent digest gets its verdict in the map task that reads it. No such row is shuffled.
4. The remaining digests are shuffled by digest. A digest that the summaries miss has less than about
   7 / ``CAPACITY`` of its shard's rows, so no hot group is left there.

Null text counts as empty. Repeated rows (same doc_id and text) are copies of each other: one of them stays. A null
doc_id is smaller than all others; where all doc_ids of a group are null, keep_id is null and one row stays. Extra
columns of any name are ignored by :func:`verdicts` and kept by :func:`deduplicate`. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlift.llm.shared import broadcast_if_small, save, text_or_empty

SHARDS = 64  # summaries of a map task; more than 128 groups would make Spark sort before it aggregates
CAPACITY = 16_384  # counters of a summary
TOP = 256  # frequent keys taken from a shard
MIN_COPIES = 64  # fewer copies are no skew
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased; all-ASCII texts by the faster built-in, which does the same to them."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def frequent_keys(prints: DataFrame, min_copies: int = MIN_COPIES) -> DataFrame:
    """64-bit keys that the merged Misra-Gries summaries report with ``min_copies`` rows or more."""
    summary = prints.groupBy(F.pmod("key", F.lit(SHARDS)).alias("shard")).agg(
        F.expr(f"approx_top_k(key, {TOP}, {CAPACITY})").alias("top"))
    found = summary.select(F.explode("top").alias("found"))
    return found.where(F.col("found.count") >= min_copies).select(F.col("found.item").alias("key"))


def _prints(docs: DataFrame) -> DataFrame:
    text = normalised(text_or_empty("text"))
    digest = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return save(digest.select("doc_id", F.monotonically_increasing_id().alias("row"), "digest",
                              F.xxhash64("digest").alias("key")), "prints")


def _judged(docs: DataFrame, min_copies: int) -> DataFrame:
    prints = _prints(docs)
    heavy = save(frequent_keys(prints, min_copies), "frequent")  # SHARDS * TOP rows at most
    winner = F.max(F.struct("doc_id", "row"))
    winners = save(prints.join(F.broadcast(heavy), "key", "left_semi").groupBy("digest").agg(
        winner.alias("best"), F.count("*").alias("group_size")), "winners")
    # one digest per key, unless 64-bit keys of different digests collide: counted before it is broadcast
    small = broadcast_if_small(winners, 4 * SHARDS * TOP)
    common = prints.join(small, "digest")
    rest = prints.join(small, "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("doc_id", "row", "digest", winner.over(group).alias("best"),
                       F.count("*").over(group).alias("group_size"))
    return common.select(rest.columns).union(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def verdicts(docs: DataFrame, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, min_copies)


def deduplicate(docs: DataFrame, min_copies: int = MIN_COPIES) -> DataFrame:
    """Rows of ``docs`` that stay, all their columns as they are. Of rows with one doc_id and text, which may differ in
    other columns, the smallest as JSON stays."""
    found = save(verdicts(docs, min_copies), "verdicts")
    losers = found.where("NOT kept").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_"),
                                           F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again_")).distinct()
    losers = save(losers, "losers")
    digest = F.sha2(normalised(text_or_empty(docs["text"])), 256)
    keys = broadcast_if_small(losers, 500_000)
    match = docs["doc_id"].cast("bigint").eqNullSafe(losers["id_"]) & (digest == losers["sha_"])
    once = docs.join(keys, match, "left_anti")
    if losers.where("again_").isEmpty():
        return once
    named = [f"c{i}" for i in range(len(docs.columns))]
    again = docs.join(keys, match & losers["again_"], "left_semi").toDF(*named)
    at = {name: F.col(named[docs.columns.index(name)]) for name in ("doc_id", "text")}
    whole = F.struct(*named)
    one = again.groupBy(at["doc_id"].alias("id_"), F.sha2(normalised(text_or_empty(at["text"])), 256).alias("sha_")).agg(
        F.min_by(whole, F.to_json(whole)).alias("one")).select("one.*").toDF(*docs.columns)
    return once.union(one)


def check_sql() -> str:
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts"""
