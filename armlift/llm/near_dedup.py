"""MinHash near-duplicate groups with min-max hashing, confirmed on full shingle sets.

1. One scan makes each document's set of distinct word shingles, its 64-bit content key (equal sets, equal keys) and a
   min-max signature: under each of ``PERMUTATIONS`` hash functions both the least and the greatest value are kept, so
   every evaluation serves two signature places. Places are banded; 128 of them, four bits each, make a sketch.
2. Copies collapse: one node per distinct set.
3. Nodes that share a band are compared by sketch inside the bucket; only a spanning forest of the pairs that may reach
   the threshold leaves the task. Connected parts of those pairs are the candidate groups.
4. Inside each group every pair is confirmed on full sets; again only a spanning forest of true links is written.
   Large buckets and groups are cut into blocks, so none must fit in one task: each block is compared beside a few pivots
   of its group, and only what is not joined to the rest of the group then meets all other blocks.
5. Components of the confirmed links give each document the smallest doc_id that it reaches.

With 48 bands of 4 places a pair at similarity 0.75 is missed with probability (1 - 0.75**4)**48 = 1e-8, and the sketch
bound lies more than five standard errors below the threshold. Nothing is capped, sampled or dropped.

Null texts and texts without words have an empty set: n_shingles 0, linked with nothing, component_id their own doc_id.
Rows with the same doc_id are rows of their own; a null doc_id is never the smallest unless it is alone, then
component_id is null and the row is kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.components import SALTS, components
from armlift.llm.shared import broadcast_if_small, save, slices
from armlift.llm.words import Words, mix, shingles

WIDTH = 5
PERMUTATIONS = 96
BAND = 4
SKETCH = 128
# Expected share of equal 4-bit places at similarity 0.54, over five standard errors below that at 0.75.
SKETCH_BOUND = (0.54 + 0.46 / 16) * SKETCH
BUCKET_BLOCK = 2048
GROUP_BLOCK = 1024
GROUP_BYTES = 8 << 20
PIVOTS = 8  # of a group, on average, chosen by a hash
SLICE_BYTES = 1 << 20
BROADCAST_NODES = 500_000  # 8-byte keys

SETS = "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, check bigint, sketch binary, bands array<bigint>"


def permutations(seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
    return factor, flip, rng.permutation(2 * PERMUTATIONS)


def signature(values: np.ndarray, factor: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Least and greatest hash value under each permutation, cut to 16 bits."""
    low = np.full(len(factor), (1 << 64) - 1, np.uint64)
    high = np.zeros(len(factor), np.uint64)
    for a in range(0, len(values), 2048):
        hashed = (values[a : a + 2048, None] ^ flip) * factor
        low = np.minimum(low, hashed.min(axis=0))
        high = np.maximum(high, hashed.max(axis=0))
    return (np.concatenate([low, high]) >> np.uint64(16)).astype(np.uint16)


def content_key(values: np.ndarray, salt: int) -> int:
    """A hash of a set, whatever the order; 63 bits."""
    with np.errstate(over="ignore"):
        total = mix(np.array([mix(values, salt).sum(dtype=np.uint64) + np.uint64(len(values))]), salt + 1)
    return int(total[0] >> np.uint64(1))


def _sets(batches, width: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    factor, flip, order = permutations()
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), SLICE_BYTES):
            words = Words(batch.column(2).slice(a, b - a))
            h = words.hashes()
            columns: list[list] = [[] for _ in range(6)]
            for i in range(b - a):
                values = shingles(h[words.first[i] : words.first[i + 1]], width)
                columns[0].append((part << 33) + row)
                row += 1
                columns[1].append(len(values))
                if len(values):
                    places = signature(values, factor, flip)
                    columns[2].append(content_key(values, 1))
                    columns[3].append(content_key(values, 3))
                    nibbles = (places[order[:SKETCH]] & 15).astype(np.uint8)
                    columns[4].append((nibbles[::2] | (nibbles[1::2] << 4)).tobytes())
                    bands = np.ascontiguousarray(places[order]).view(np.uint64)
                    columns[5].append(mix(bands ^ (np.arange(len(bands)).astype(np.uint64) << np.uint64(56))).view(np.int64))
                else:
                    for c in columns[2:]:
                        c.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), batch.column(0).slice(a, b - a),
                 batch.column(1).slice(a, b - a),
                 *(pa.array(c, t) for c, t in zip(columns[1:], (
                     pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))),
                 batch.column(2).slice(a, b - a)],
                ["row", "doc_id", "text_hash", "n_shingles", "node", "check", "sketch", "bands", "text"])


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index in each index's connected part, from a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = _roots(linked)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def _unpack(sketches: np.ndarray) -> np.ndarray:
    out = np.empty((len(sketches), SKETCH), np.uint8)
    out[:, ::2] = sketches & 15
    out[:, 1::2] = sketches >> 4
    return out


def _alike(sketches: np.ndarray) -> np.ndarray:
    """Which pairs of rows have enough equal places."""
    m = len(sketches)
    out = np.empty((m, m), bool)
    one_hot = [(sketches == v).astype(np.float32) for v in range(16)] if m > 64 else []
    if one_hot:
        total = np.zeros((m, m), np.float32)
        for x in one_hot:
            total += x @ x.T
        return total >= SKETCH_BOUND
    for i in range(m):
        out[i] = (sketches == sketches[i]).sum(axis=1) >= SKETCH_BOUND
    return out


def _bucket_links(batches):
    """Rows come sorted by bucket and block pair; out goes a forest of the pairs alike by sketch."""
    import pyarrow as pa

    def links(keys, nodes, sketches):
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        a_out, b_out = [], []
        two = np.flatnonzero(ends - starts == 2)
        if len(two):
            i = starts[two]
            hit = i[(_unpack(sketches[i]) == _unpack(sketches[i + 1])).sum(axis=1) >= SKETCH_BOUND]
            a_out.append(nodes[hit])
            b_out.append(nodes[hit + 1])
        for k in np.flatnonzero(ends - starts > 2):
            s, e = starts[k], ends[k]
            a, b = _forest(nodes[s:e], _alike(_unpack(sketches[s:e])))
            a_out.append(a)
            b_out.append(b)
        a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
        b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    held = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        nodes = batch.column(3).to_numpy(zero_copy_only=False)
        sketches = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH // 2)
        if held is not None:
            keys, nodes, sketches = (np.concatenate(x) for x in zip(held, (keys, nodes, sketches)))
        if not len(keys):
            continue
        last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])  # the open group waits for more rows
        if last:
            yield links(keys[:last], nodes[:last], sketches[:last])
        held = keys[last:], nodes[last:], sketches[last:]
    if held is not None:
        yield links(*held)


def _confirm(pdf, width: int, percent: int):
    """A forest of the true links among one group's (or pair of blocks') members."""
    import pandas as pd
    import pyarrow as pa

    nodes = pdf["node"].to_numpy()
    words = Words(pa.array(pdf["text"], pa.large_string()))
    h = words.hashes()
    sets = [shingles(h[a:b], width) for a, b in zip(words.first[:-1], words.first[1:])]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, (lo, lo + step))
        member = np.zeros((len(sets), step), np.float32)
        member[owner[a:b], place[a:b] - lo] = 1
        both += member @ member.T
    union = sizes[:, None] + sizes[None, :] - both
    a, b = _forest(nodes, 100 * both >= percent * union)
    return pd.DataFrame({"a": a, "b": b})


def _grouped_components(rows: DataFrame, key: str, compare: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(node, root): components of the links that ``compare`` finds among the members of each ``key``.

    ``rows`` has ``key``, ``node``, ``members``, ``blocks`` and what is compared. Keys of one block are compared whole.
    Larger ones first block by block, each beside the same few pivots, which join what the blocks hold of one family. Then
    only members outside a key's largest component (the rest) are compared with all others: pairs inside a component
    cannot change it. For m members and a rest of r that is about m * (1 + r / block) rows, not m * m / block.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("members")) < PIVOTS)
    first = rows.withColumn("block_a", F.explode(F.when(pivot, every).otherwise(F.array(own)))).withColumn(
        "block_b", F.lit(0).cast("bigint"))
    found = save(components(compare(first), name), name)
    large = rows.where("blocks > 1")
    tagged = large.select(key, "node").join(found, "node", "left").select(
        key, "node", F.coalesce("root", "node").alias("root"))
    sizes = tagged.groupBy(key, "root").agg(F.count("*").alias("size"))
    core = sizes.groupBy(key).agg(
        F.max_by("root", F.struct("size", "root")).alias("core"), (F.sum("size") - F.max("size")).alias("rest")).where("rest > 0")
    core = save(core, f"{name}-core")
    if core.isEmpty():
        return found
    large = large.join(broadcast_if_small(core, BROADCAST_NODES), key).join(found, "node", "left")
    large = large.withColumn("outside", F.coalesce("root", "node") != F.col("core")).withColumn(
        "rest_blocks", F.ceil(F.col("rest") * F.col("blocks") / F.col("members")))
    mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rest_blocks"))
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rest_blocks") - 1), lambda a: F.struct(
        a.alias("block_a"), own.alias("block_b")))
    places = F.when(F.col("outside"), F.array_union(places, F.transform(every, lambda b: F.struct(
        mine.alias("block_a"), b.alias("block_b"))))).otherwise(places)
    second = large.withColumn("place", F.explode(places)).select(*rows.columns, "place.*")
    again = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(compare(second))
    return save(components(again, name), name)


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """(row, root, doc_id, text_hash, n_shingles, component_id, kept) for every row; ``row`` tells apart rows with the same
    doc_id, ``root`` tells apart components, also where doc_ids are null or repeated, and is null without shingles."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    sets = save(rows.mapInArrow(partial(_sets, width=width), f"{SETS}, text string"), "sets")
    clash = sets.where("n_shingles > 0").groupBy("node").agg(
        (F.min("check") != F.max("check")).alias("clash")).where("clash").limit(1).count()
    if clash:
        raise RuntimeError("two different shingle sets have one 63-bit key")

    nodes = save(sets.where("n_shingles > 0").select("node", "sketch", "bands").dropDuplicates(["node"]), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = save(bands.join(buckets, "bucket"), "buckets")
    sketches = shared.join(nodes.select("node", "sketch"), "node").withColumn(
        "blocks", F.ceil(F.col("members") / BUCKET_BLOCK))
    groups = _grouped_components(sketches, "bucket", lambda placed: placed.select(
        "bucket", "block_a", "block_b", "node", "sketch").repartition("bucket", "block_a", "block_b").sortWithinPartitions(
        "bucket", "block_a", "block_b").mapInArrow(_bucket_links, "a bigint, b bigint"), "alike")

    texts = sets.join(broadcast_if_small(groups.withColumnRenamed("root", "group"), BROADCAST_NODES), "node").select(
        "node", "group", "text").dropDuplicates(["node"])
    texts = save(texts, "members")
    sizes = texts.groupBy("group").agg(F.count("*").alias("members"), F.ceil(F.greatest(
        F.count("*") / GROUP_BLOCK, F.sum(F.octet_length("text")) / GROUP_BYTES)).alias("blocks"))
    members = texts.join(broadcast_if_small(save(sizes, "sizes"), BROADCAST_NODES), "group")
    linked = _grouped_components(members, "group", lambda placed: placed.groupBy("group", "block_a", "block_b").applyInPandas(
        partial(_confirm, width=width, percent=percent), "a bigint, b bigint"), "links")

    own = sets.select("row", "doc_id", "text_hash", "n_shingles", "node").join(
        broadcast_if_small(linked, BROADCAST_NODES), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    own = save(own, "rooted")
    # the smallest doc_id comes back by root and salt: the rows of a large component are spread over tasks
    salted = own.withColumn("salt", F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("row"), F.lit(SALTS))))
    least = salted.where("n_shingles > 0").groupBy("root", "salt").agg(F.min("doc_id").alias("least")).groupBy("root").agg(
        F.min("least").alias("component_id"), F.collect_list("salt").alias("salts")).select(
        "root", "component_id", F.explode("salts").alias("salt"))
    out = salted.join(least, ["root", "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("row", "root", "doc_id", "text_hash", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def check_sql(width: int = WIDTH, percent: int = 75) -> str:
    """The same groups by a join on plain shingles, for another database and small tables."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
            WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')))
            END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * k >= {percent} * (x.n + y.n - k)),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reached) AS component_id,
            r.doc_id = min(reached) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""
