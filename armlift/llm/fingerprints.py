"""Document fingerprints: 128-bit SimHash in DataFrame operations only.

Each word votes with the square of its length (at most ``LONGEST`` letters) on the 128 bits of two 64-bit hashes. Two
bits share one running sum: ``(hash >> i) & 0x0000000100000001`` puts bits i and i + 32 into lanes of 32 bits, so 64 sums
count all votes in one pass (good for 2**31 / LONGEST**2 longest words in one text; beyond, Spark reports an overflow). A bit is set if the
votes for it are over half.

The next document by descending doc_id is found without one global window: doc_id quantiles (a list as long as the
number of partitions) give buckets; the first row of each bucket is also put at the end of the bucket before, and the
first of all at the very end. Texts are shuffled once; edited texts, votes and likenesses are made in that partitioning.

Fingerprints within any Hamming radius are found by permuted block tables: the 128 bits in ``BLOCKS`` blocks of 25 or 26;
of two fingerprints within the radius one block at least differs in no more than radius / BLOCKS bits. Each table holds
the distinct fingerprints with one block in front, so copies count as one entry with a number, and a query asks for its own
front and for those that differ in so few bits. A pair is taken in the first table that can find it, and so once. One
word in 200 changed flips 4 bits on average, a similarity of 0.75 on 5-word shingles about 9: RADIUS finds over nine in
ten of such pairs, and 1 in 100,000 unrelated ones.

Null texts are empty; a text without words has the fingerprint 0. Null doc_ids come last. Rows with one doc_id are
rows of their own, ordered by text. A single row is its own next document. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from armlift.llm.shared import save, text_or_empty

LONGEST = 16
LANES = 0x0000000100000001
BLOCKS = 5
RADIUS = 12
SPACE = "[\\x20\\x09-\\x0D]+"


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*map(F.lit, bounds))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, place, ghost, next): next is the following text by descending doc_id.

    A ghost repeats the first row of the bucket that follows; drop ghosts after looking ahead."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    # at most one row per bucket
    tops = dict(rows.groupBy("bucket").agg(F.max("key")).collect())
    order = sorted(tops)
    before = {b: a for b, a in zip(order, [*order[1:], order[0]])} if order else {}
    size = len(bounds) + 1
    top = F.array(*(F.lit(tops.get(b)).cast("bigint") for b in range(size)))
    target = F.array(*(F.lit(before.get(b, b)).cast("int") for b in range(size)))
    here = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("ghost"))
    there = F.struct(F.get(target, "bucket").alias("bucket"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("at", F.explode(F.when(
        F.col("key") == F.get(top, "bucket"), F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("doc_id", "text", "key", "at.bucket", "at.ghost")
    by = Window.partitionBy("bucket").orderBy("ghost", F.desc("key"), "text")
    return rows.withColumn("next", F.lead("text").over(by)).withColumn("place", F.row_number().over(by)).drop("key")


def _votes() -> list[Column]:
    words = ("h0", "h1")
    return [F.sum(F.expr(f"(shiftrightunsigned({h}, {i}) & {LANES}L) * weight")).alias(f"{h}_{i}")
            for h in words for i in range(32)] + [F.sum("weight").alias("total")]


def _bits(h: str) -> Column:
    low = [f"IF(2 * ({h}_{i} & 4294967295L) > total, {1 << i}L, 0L)" for i in range(32)]
    high = [f"IF(2 * shiftrightunsigned({h}_{i}, 32) > total, shiftleft(1L, {i + 32}), 0L)" for i in range(32)]
    return F.expr(" | ".join(low + high))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits of two fingerprints (each a pair of longs: ``<name>0``, ``<name>1``)."""
    return 1 - (F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0")))
                + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))) / 128


def as_text(name: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{name}0"), 16, "0"), F.lpad(F.hex(f"{name}1"), 16, "0")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row: n_chars, edited_sha256, both fingerprints and their likenesses, and the fingerprint as f0, f1."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr(
        "concat(substring(text, 1, CAST(n_chars - n_chars DIV 2 AS INT)), "
        "substring(coalesce(next, ''), 1, CAST(n_chars DIV 2 AS INT)))"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    # a ghost has no successor to be compared with, only its own fingerprint is wanted
    texts = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))))
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select(*keys, F.explode(texts).alias("e")).select(*keys, "e.which", "e.t")
    words = each.select(*keys, "which", F.explode(F.split("t", SPACE)).alias("word"))
    hashed = words.select(*keys, "which", F.xxhash64("word").alias("h0"), F.xxhash64("word", F.lit(1)).alias("h1"),
                          F.pow(F.least(F.char_length("word"), F.lit(LONGEST)), 2).cast("bigint").alias("weight"))
    prints = hashed.groupBy(*keys, "which").agg(*_votes()).select(
        *keys, "which", _bits("h0").alias("p0"), _bits("h1").alias("p1"))
    both = prints.groupBy(*keys).agg(*(
        F.max(F.when(F.col("which") == w, F.col(f"p{k}"))).alias(f"{name}{k}")
        for w, name in ((0, "f"), (1, "e")) for k in (0, 1)))
    by = Window.partitionBy("bucket").orderBy("place")
    ahead = both.withColumn("n0", F.lead("f0").over(by)).withColumn("n1", F.lead("f1").over(by)).where("NOT ghost")
    return ahead.select(
        "doc_id", "n_chars", "edited_sha256", as_text("f").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "n").alias("near_next"), "f0", "f1")


def _block(a: str, k: int) -> Column:
    """Block ``k`` of the fingerprint in columns ``<a>0``, ``<a>1``: bits from 128 * k / BLOCKS on."""
    low, high = 128 * k // BLOCKS, 128 * (k + 1) // BLOCKS
    parts = []
    for word in (0, 1):
        first, last = max(low, 64 * word), min(high, 64 * word + 64)
        if first < last:
            bits = f"shiftrightunsigned({a}{word}, {first - 64 * word}) & {(1 << last - first) - 1}L"
            parts.append(f"shiftleft({bits}, {first - low})")
    return F.expr(" | ".join(parts))


def _tables(prints: DataFrame, name: str, flips: int = 0) -> DataFrame:
    """One row per fingerprint, table and front; fronts are the block itself and all that differ in up to ``flips`` bits."""
    front = [F.struct(F.lit(k).alias("table"), _block(name, k).alias("front")) for k in range(BLOCKS)]
    found = prints.withColumn("_t", F.explode(F.array(*front))).select("*", "_t.table", "_t.front").drop("_t")
    if not flips:
        return found
    width = -(-128 // BLOCKS)
    masks = [sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(width), n)]
    listed = ", ".join(f"{mask}L" for mask in masks)
    return found.withColumn("_mask", F.expr(f"explode(array({listed}))")).withColumn("front", F.col("front").bitwiseXOR(F.col("_mask"))).drop("_mask")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0, q1, f0, f1, distance): all fingerprints within ``radius`` of each query fingerprint, each pair once."""
    flips = radius // BLOCKS
    mine = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    # a query is one small row before its fronts are made: its size says nothing, so neither side is broadcast
    asked, known = _tables(mine, "q", flips), _tables(prints.select("f0", "f1").distinct(), "f")
    found = asked.hint("merge").join(known.hint("merge"), ["table", "front"])
    distance = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    earlier = F.lit(False)  # whether a table before this one finds the pair as well
    for k in range(BLOCKS - 1):
        apart = F.bit_count(_block("q", k).bitwiseXOR(_block("f", k)))
        earlier = earlier | ((F.col("table") > k) & (apart <= flips))
    return found.withColumn("distance", distance).where((F.col("distance") <= radius) & ~earlier).select(
        "q0", "q1", "f0", "f1", "distance")


def count_near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0, q1, n_near): how many rows of ``prints`` lie within ``radius`` of each query fingerprint."""
    classes = prints.groupBy("f0", "f1").agg(F.count("*").alias("rows"))
    found = within_radius(queries, classes, radius).join(classes, ["f0", "f1"])
    return found.groupBy("q0", "q1").agg(F.sum("rows").alias("n_near"))


def fingerprint_report(docs: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """:func:`fingerprint_edits` and, for rows whose doc_id is divisible by ``every``, ``n_near``: the number of other
    rows with a fingerprint within ``radius``; null for the rest."""
    prints = save(fingerprint_edits(docs), "prints")
    asked = F.col("doc_id") % every == 0
    near = count_near(prints, prints.where(asked), radius)
    return prints.withColumn("asked", F.coalesce(asked, F.lit(False))).join(
        near, F.col("asked") & (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left").withColumn(
        "n_near", F.col("n_near") - 1).drop("f0", "f1", "q0", "q1", "asked")
