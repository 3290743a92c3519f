"""Phrases of two to five words whose parts occur together more often than alone.

Texts with A-Z lower-cased are split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at spaces and tabs into words. For every
language, f counts the contiguous occurrences of a phrase inside pieces. A phrase with f >= ``min_count`` is scored
floor(1000 * f * n / (f(first part) * f(rest))) at its weakest cut, n being the language's number of words; phrases that
a longer one contains in all their occurrences go.

1. Candidates. Every n-gram has a 64-bit hash (of language and words); it names a hash partition and a 32-bit key in it. Map
   tasks add up keys and send each hash partition one packed block; there a Misra-Gries summary merges the blocks:
   when it has more counters than ``capacity``, all are lowered by the first one beyond. Capacity exceeds the mass
   of the partition divided by ``min_count``, so the sum of all lowerings stays under ``min_count`` and every frequent
   key survives; a lowering that would break that is not made. What may be frequent after all (count + lowerings) is kept.
   Equal keys of different n-grams only add candidates. This is done twice: for one and two words, then for three
   and more where all pairs of neighbours survived, as an n-gram is never more frequent than its parts.
2. Survivors become a bit array of at most ``FILTER_BITS`` bits, put together in tasks: the one thing broadcast. Beyond
   its size more n-grams pass, and none is lost.
3. The second pass counts what passes exactly, by the words themselves. A task adds up all its slices and sends a phrase
   once; there are ``TASKS_PER_CORE`` tasks a core, more only from ``TASK_BYTES`` of text each, so that the rows sent do not
   grow as the product of slices and frequent phrases. Beyond ``HELD_BYTES`` a task sends its rarer phrases early.
4. Cuts, containment and ranks are joins and windows over the frequent phrases. Products are decimals of 38 digits.

No step depends on how many rows a language, source or phrase has: blocks carry a key once, counts are partial sums, the
lookup of parts is a broadcast behind a size check or a salted join, and ranks are cut before languages meet.
Long texts are cut between pieces, which no phrase crosses. Null text counts as empty, a null language as ``und``; repeated
rows count again; ties in rank go to the smaller phrase in byte order. Extra columns are ignored. An empty table, or one
without frequent phrases, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlift.llm.shared import broadcast_if_small, save, text_or_empty
from armlift.llm.words import Words, lower_table, mix

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
PARTITION_MASS = 1 << 24  # n-grams of a hash partition, by the bound that text length gives
MAX_PARTITIONS = 1 << 16
SLICE_BYTES = 1 << 21
BLOCK_KEYS = 1 << 22  # keys a map task adds up before it sends them
FILTER_BITS = 1 << 29
CHUNK_BITS = 1 << 13
PROBES = 4
TASKS_PER_CORE = 2
TASK_BYTES = 1 << 29
HELD_BYTES = 1 << 26  # partial counts that a task of the second pass holds
SENT_ROWS = 1 << 16
LOOKUP_ROWS = 400_000
SALTS = 32

_BREAK, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


class Pieces(Words):
    """Words of a slice of bytes; ``row`` and ``piece`` say where each one lies."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray):
        self.data = lower_table()[raw]
        breaks = _table(_BREAK)[raw]
        word = ~(breaks | _table(_SPACE)[raw])
        edge = np.zeros(len(raw) + 1, bool)
        edge[edges] = True
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(edges, self.start, side="right")
        self.piece = np.searchsorted(np.flatnonzero(breaks), self.start) + self.row

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        length = (self.end - self.start)[at]
        bounds = np.r_[0, np.cumsum(length)]
        inside = np.arange(bounds[-1]) + np.repeat(self.start[at] - bounds[:-1], length)
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(self.data[inside]))


def _after_break(raw: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on where no piece is cut: behind a break, or at the end of the text."""
    table = _table(_BREAK)
    for a in range(at, stop, 1 << 16):
        hit = np.flatnonzero(table[raw[a : min(stop, a + (1 << 16))]])
        if len(hit):
            return a + int(hit[0]) + 1
    return stop


def slices_of(batch, limit: int) -> Iterator[tuple[Pieces, np.ndarray]]:
    """Pieces, and the row in the batch of each word, of about ``limit`` bytes at a time; column 1 is the text."""
    text = batch.column(1).cast(pa.large_string())
    _, bounds, data = text.buffers()
    bounds = np.frombuffer(bounds, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return
    raw, bounds = np.frombuffer(data, np.uint8, size, int(bounds[0])), bounds - bounds[0]
    a = 0
    while a < size:
        b = size
        if a + limit < size:
            b = _after_break(raw, a + limit, int(bounds[np.searchsorted(bounds, a + limit)]))
        first = int(np.searchsorted(bounds, a, side="right")) - 1  # the last row that starts here or before
        inner = bounds[first + 1 : np.searchsorted(bounds, b, side="left")]
        words = Pieces(raw[a:b], inner - a)
        if len(words.start):
            yield words, first + words.row
        a = b


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                     for x in langs.to_pylist()], np.uint64)


class _Filter:
    """Whether an n-gram may be frequent: a Bloom filter over (hash partition, key)."""

    def __init__(self, lengths: tuple[int, ...], partitions: int, bits):
        self.lengths, self.partitions, self.bits = lengths, partitions, bits

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return _place(hashes, self.partitions)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bits = self.bits.value
        alive = np.arange(len(hashes))
        for place in _probes(self.keys(hashes), len(bits) * 8):
            place = place[alive]
            alive = alive[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), bool)
        out[alive] = True
        return out


def _place(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(partitions) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys, 1)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def _ngrams(words: Pieces, h: np.ndarray, filters: list[_Filter], max_words: int):
    """(length, starts, hashes) of n-grams inside pieces that pass the filters, as their parts do; shortest first."""
    starts, hashes = np.arange(len(h)), h
    for length in range(1, max_words + 1):
        if length > 1:
            whole = np.zeros(len(h) + 1, bool)
            whole[starts] = True
            last = starts + length - 1
            inside = last < len(h)
            # both parts one word shorter are there, and no piece ends in between
            ok = inside & whole[np.minimum(starts + 1, len(h))]
            ok[ok] = words.piece[starts[ok]] == words.piece[last[ok]]
            starts, hashes = starts[ok], mix(hashes[ok] * _MULTIPLIER + h[last[ok]])
        for known in filters:
            if length in known.lengths:
                ok = known.passes(hashes)
                starts, hashes = starts[ok], hashes[ok]
        yield length, starts, hashes


# --- first pass: keys of n-grams, Misra-Gries per hash partition ----------------------------------------------------


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising 32-bit keys as differences, and counts, byte plane by byte plane."""
    planes = np.concatenate([np.diff(keys, prepend=np.uint32(0)), counts.astype(np.uint32)]).astype("<u4").view(np.uint8)
    body = np.ascontiguousarray(planes.reshape(2, -1, 4).transpose(0, 2, 1)).tobytes()
    return len(keys).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    body = np.frombuffer(pa.Codec("zstd").decompress(block[4:], 8 * n, asbytes=True), np.uint8)
    planes = np.ascontiguousarray(body.reshape(2, 4, n).transpose(0, 2, 1)).view("<u4").reshape(2, n)
    return np.cumsum(planes[0], dtype=np.uint32), planes[1].astype(np.int64)


def _key_blocks(batches, lengths: tuple[int, ...], partitions: int, filters: list[_Filter]):
    held, size = [], 0

    def blocks():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) << np.uint64(32))
        at = np.flatnonzero(np.diff(bounds))
        packed = [_pack(keys[bounds[p] : bounds[p + 1]].astype(np.uint32), counts[bounds[p] : bounds[p + 1]]) for p in at]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["part", "block"])

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        salt, code = _lang_hashes(langs.dictionary), langs.indices.to_numpy()
        for words, row in slices_of(batch, SLICE_BYTES):
            h = mix(words.hashes() ^ salt[code[row]])
            for length, _, hashes in _ngrams(words, h, filters, max(lengths)):
                if length in lengths:
                    held.append(_place(hashes, partitions))
                    size += len(hashes)
            if size >= BLOCK_KEYS:
                yield blocks()
                held, size = [], 0
    if size:
        yield blocks()


class MisraGries:
    """Counts of 32-bit keys in at most ``capacity`` counters, too low by ``lowered`` at most; summaries merge."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.lowered = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in blocks)])
        counts = np.concatenate([self.counts, *(c for _, c in blocks)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            if self.lowered + cut < self.threshold:
                left = self.counts > cut
                self.keys, self.counts = self.keys[left], self.counts[left] - cut
                self.lowered += cut

    def frequent(self) -> np.ndarray:
        return self.keys[self.counts + self.lowered >= self.threshold]


def _summarise(capacity: int, threshold: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, size = MisraGries(capacity, threshold), [], 0
        for batch in batches:
            for block in batch.column(batch.schema.get_field_index("block")):
                held.append(_unpack(block.as_py()))
                size += len(held[-1][0])
                if size >= max(capacity, 1 << 20):
                    summary.merge(held)
                    held, size = [], 0
        summary.merge(held)
        found = summary.frequent().astype(np.int64) | (key[0].as_py() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    return run


def _filter_chunks(bits: int):
    def places(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_probes(keys, bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // CHUNK_BITS).astype(np.int32)), pa.array(
                (at % CHUNK_BITS).astype(np.int32))], ["chunk", "place"])

    def chunk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(CHUNK_BITS, bool)
        for batch in batches:
            on[batch.column(batch.schema.get_field_index("place")).to_numpy()] = True
        packed = np.packbits(on, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed])], ["chunk", "bits"])

    return places, chunk


def _as_filter(found: DataFrame, lengths: tuple[int, ...], partitions: int) -> _Filter:
    """Bits of all found keys; what reaches the driver is the bit array, FILTER_BITS at most."""
    rows = found.count()
    bits = CHUNK_BITS
    while bits < min(16 * rows, FILTER_BITS):
        bits *= 2
    places, chunk = _filter_chunks(bits)
    array = np.zeros(bits // 8, np.uint8)
    for r in found.mapInArrow(places, "chunk int, place int").groupBy("chunk").applyInArrow(
            chunk, "chunk int, bits binary").collect():
        array[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return _Filter(lengths, partitions, found.sparkSession.sparkContext.broadcast(array))


def survivors(texts: DataFrame, lengths: tuple[int, ...], filters: list[_Filter], min_count: int, length_sum: int) -> _Filter:
    """N-grams of these lengths that may occur ``min_count`` times. ``length_sum``: bytes and rows of all texts."""
    mass = max(1, len(lengths) * length_sum // 2)  # a word and what parts it from the next are two bytes at least
    partitions = min(MAX_PARTITIONS, -(-mass // PARTITION_MASS))
    capacity = mass // partitions // min_count + 1
    blocks = texts.mapInArrow(lambda batches: _key_blocks(batches, lengths, partitions, filters), "part int, block binary")
    found = save(blocks.groupBy("part").applyInArrow(_summarise(capacity, min_count), "key bigint"), "survivors")
    return _as_filter(found, lengths, partitions)


# --- second pass: exact counts of what survived ----------------------------------------------------------------------

COUNTS = "lang string, phrase string, words int, n bigint"


def _count_slices(batches, filters: list[_Filter], max_words: int):
    """Exact counts in a slice, by words; a row of 0 words has the language's number of words."""
    import pyarrow.compute as pc

    def rows(langs, code, phrases, length, counts):
        return pa.RecordBatch.from_arrays([
            langs.take(pa.array(code)).cast(pa.string()), phrases.cast(pa.string()),
            pa.array(np.full(len(counts), length, np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "n"])

    for batch in batches:
        encoded = batch.column(0).dictionary_encode()
        langs, code = encoded.dictionary, encoded.indices.to_numpy()
        salt = _lang_hashes(langs)
        for words, row in slices_of(batch, SLICE_BYTES):
            of = code[row]
            totals = np.bincount(of, minlength=len(langs))
            there = np.flatnonzero(totals)
            yield rows(langs, there, pa.nulls(len(there), pa.string()), 0, totals[there])
            h = mix(words.hashes() ^ salt[of])
            word = np.zeros(len(h), np.int64)  # number of the word in the slice's vocabulary
            before = np.zeros(len(h), np.int64)  # number of the phrase that is one word shorter
            for length, starts, _ in _ngrams(words, h, filters, max_words):
                if not len(starts):
                    break
                if length == 1:
                    spelled = words.strings(starts).dictionary_encode()
                    vocabulary, word[starts] = spelled.dictionary, spelled.indices.to_numpy()
                    key = word[starts] * len(langs) + of[starts]
                else:
                    key = before[starts] * len(vocabulary) + word[starts + length - 1]
                _, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                before[starts] = number
                at = starts[first]
                parts = [vocabulary.take(pa.array(word[at + k])) for k in range(length)]
                phrases = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]
                yield rows(langs, of[at], phrases, length, counts)


def _summed(held: list[pa.RecordBatch]) -> pa.Table:
    keys = ["lang", "phrase", "words"]
    sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return sums.select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _add_up(counts: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """A row per phrase of all slices. If the sums outgrow half of ``limit`` bytes, all but the most frequent quarter of
    the phrases are sent, and counted anew when they come again."""
    held, size = [], 0
    for batch in counts:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            sums = _summed(held)
            if sums.nbytes > limit // 2:
                sums = sums.sort_by([("n", "descending")])
                yield from sums.slice(len(sums) // 4).to_batches(SENT_ROWS)
                sums = sums.take(np.arange(len(sums) // 4))
            held, size = sums.to_batches(), sums.nbytes
    if held:
        yield from _summed(held).to_batches(SENT_ROWS)


def partial_counts(texts: DataFrame, filters: list[_Filter], max_words: int, length_sum: int) -> DataFrame:
    """Rows of COUNTS to be added up: one per phrase and task, as long as a task can hold its phrases."""
    tasks = max(TASKS_PER_CORE * texts.sparkSession.sparkContext.defaultParallelism, -(-length_sum // TASK_BYTES))
    return texts.coalesce(tasks).mapInArrow(
        lambda batches: _add_up(_count_slices(batches, filters, max_words), HELD_BYTES), COUNTS)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of one to ``max_words`` words with ``min_count`` occurrences, and for each
    language a row of 0 words with its number of words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))
    length_sum = texts.agg(F.sum(F.octet_length("text") + F.lit(1).cast("bigint"))).first()[0] or 0
    filters = [survivors(texts, tuple(range(1, min(2, max_words) + 1)), [], min_count, length_sum)]
    if max_words > 2:
        filters.append(survivors(texts, tuple(range(3, max_words + 1)), filters, min_count, length_sum))
    return partial_counts(texts, filters, max_words, length_sum).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(
        (F.col("words") == 0) | (F.col("n") >= min_count))


def _look_up(rows: DataFrame, counts: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the count of the phrase in ``column``; a common word is asked for by many rows, so these are salted."""
    table = counts.select("lang", F.col("phrase").alias(column), F.col("n").alias(name))
    known = broadcast_if_small(table, LOOKUP_ROWS)
    if known is not table:
        return rows.join(known, ["lang", column])
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return salted.join(table.withColumn("salt", salts), ["lang", column, "salt"]).drop("salt")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    counts = save(phrase_counts(docs, min_count, max_words), "phrase-counts")
    phrases = counts.where("words >= 2")
    # a phrase inside a longer one that is as frequent is so inside one that is longer by a word
    part = lambda k: F.expr(f"substring_index(phrase, ' ', {k})")
    longer = counts.where("words >= 3").select("lang", "n", F.explode(F.array(
        part("words - 1"), part("1 - words"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    alone = phrases.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("within") < F.col("n"), F.lit(True))).drop("within")
    cuts = alone.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn(
        "head", part("k")).withColumn("rest", part("k - words"))
    totals = counts.where("words = 0").select("lang", F.col("n").alias("all_words"))  # a row per language
    cuts = _look_up(_look_up(cuts, counts, "head", "l"), counts, "rest", "r").join(broadcast_if_small(totals, LOOKUP_ROWS), "lang")
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    weakest = cuts.withColumn("above", (F.lit(1000) * F.col("n")).cast("decimal(19,0)") * wide("all_words")).withColumn(
        "below", wide("l") * wide("r")).withColumn("score", F.expr("above div below")).groupBy(
        "lang", "phrase", F.col("n").alias("a"), F.col("all_words").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = weakest.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def check_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, size, w[i : i + size - 1] AS g
          FROM words, unnest(range(1, 6)) AS s(size), unnest(range(1, len(w) - size + 2)) AS p(i)),
counts AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY lang, size, g HAVING count(*) >= {min_count}),
longer AS (SELECT lang, g[i : i + part - 1] AS g, max(f) AS f
           FROM counts, unnest(range(2, size)) AS q(part), unnest(range(1, size - part + 2)) AS p(i)
           WHERE size > 2 GROUP BY ALL),
alone AS (SELECT c.* FROM counts c LEFT JOIN longer o ON o.lang = c.lang AND o.g = c.g
          WHERE c.size > 1 AND (o.f IS NULL OR 100 * o.f < 100 * c.f)),
cuts AS (SELECT a.lang, a.g, a.f AS a, k, l.f AS l, r.f AS r, t.n,
                CAST(1000 AS HUGEINT) * a.f * t.n // (CAST(l.f AS HUGEINT) * r.f) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM alone) a
         JOIN counts l ON l.lang = a.lang AND l.g = a.g[1 : k]
         JOIN counts r ON r.lang = a.lang AND r.g = a.g[k + 1 : a.size]
         JOIN totals t ON t.lang = a.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (
           PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM weakest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}"""
