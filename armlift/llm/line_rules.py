"""Quality rules: base statistics of each text and cross-document line frequency.

One scan computes the base statistics, a hash of each text's lines (its content), and for each line with a word a hash
of its lower-cased words and its number of words. Per host, a line's documents are the distinct contents that have it,
and the host's size is its number of distinct contents: rows whose lines have the same lower-cased words are one document,
all others are documents of their own, however much they share. Lines in more than ``max(MIN_DOCUMENTS, SHARE of the
host's documents)`` documents are above the limit. A document that is left with fewer than ``MIN_LEFT`` words or less than
``LEFT_SHARE`` of its words without them is depleted and rejected. :func:`judge` gives the counts and verdicts,
:func:`clean` the other documents without these lines.

Counting is a distinct and a count, both combined before the shuffle, so a line or host with a third of all rows costs
no skew. Null or empty texts have no words and fail the base rule. A null host is a host of its own. Repeated rows are
judged alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.shared import broadcast_if_small, private, save, slices, text_or_empty
from armlift.llm.words import Words, mix, windows

MIN_DOCUMENTS = 20
SHARE = 0.02
MIN_LEFT = 10
LEFT_SHARE = 0.1
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SLICE_BYTES = 1 << 20
BROADCAST_LINES = 500_000

MEASURES = ("row bigint, doc_id bigint, text_hash bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, "
            "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
            "content bigint, lines array<struct<hash:bigint,words:int,number:int>>")


def repeated_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` that occur twice or more, the first occurrence included."""
    found = windows(h, width)
    if len(found) < 2:
        return 0
    _, place, count = np.unique(found, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[place] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def line_heads(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number in its row's text from 0) of all lines with a word."""
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.start)
    head = np.ones(len(line), bool)
    head[1:] = line[1:] != line[:-1]
    head[words.first[:-1][words.first[:-1] < len(line)]] = True
    starts = np.flatnonzero(head)
    row = np.searchsorted(words.first, starts, side="right") - 1
    return starts, line[starts] - np.searchsorted(breaks, words.bounds[row])


def line_hashes(words: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line of each row, hash, content of the row, words) of all lines with a word; ``h`` are lower-case word hashes."""
    n = len(h)
    starts, _ = line_heads(words)
    counts = np.diff(np.r_[starts, n])
    first = np.searchsorted(starts, words.first)
    if not n:
        return first, np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    hashes = _in_order(h, starts, counts)
    rows = np.flatnonzero(first[1:] > first[:-1])
    lines = (first[1:] - first[:-1])[rows]
    return first, hashes, np.repeat(_in_order(hashes, first[:-1][rows], lines), lines), counts


def _in_order(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash per run of ``h``, of its values in their order."""
    place = np.arange(len(h)) - np.repeat(starts, counts)
    power = np.cumprod(np.full(int(counts.max()), 0x9E3779B97F4A7C15, np.uint64))
    return mix(np.add.reduceat(h * power[place], starts) ^ counts.astype(np.uint64))


def _measure(batches, max_repeat_percent: int, min_words: int):
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(3)).to_pylist(), SLICE_BYTES):
            text = batch.column(3).slice(a, b - a)
            raw, low = Words(text, lower=False), Words(text)
            exact = raw.hashes()
            first, hashes, contents, counts = line_hashes(low, low.hashes())
            content = np.zeros(b - a, np.uint64)  # of texts without words
            content[first[1:] > first[:-1]] = contents[first[:-1][first[1:] > first[:-1]]]
            n_words = np.diff(raw.first)
            points = np.r_[0, np.cumsum((raw.data & 0xC0) != 0x80)]
            in_word = np.r_[0, np.cumsum(points[raw.end] - points[raw.start])]
            marks = np.r_[0, np.cumsum(symbol[raw.data])]
            repeats = np.array([repeated_words(exact[x:y]) for x, y in zip(raw.first[:-1], raw.first[1:])], np.int64)
            failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
            lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int32)),
                 pa.array(line_heads(low)[1].astype(np.int32))], ["hash", "words", "number"]))
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + row + np.arange(b - a)), *(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(n_words),
                pa.array(in_word[raw.first[1:]] - in_word[raw.first[:-1]]),
                pa.array(marks[raw.bounds[1:]] - marks[raw.bounds[:-1]]),
                pa.array([repeated_lines(t) for t in text.to_pylist()], pa.int64()),
                pa.array(repeats), pa.array(failed), pa.array(content.view(np.int64)), lines], [f.split()[0] for f in MEASURES.split(", ")])
            row += b - a


def _verdicts(
    docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS,
    share: float = SHARE, min_left: int = MIN_LEFT, left_share: float = LEFT_SHARE, max_repeat_percent: int = 20,
    min_words: int = 10,
) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text")).select(
        "doc_id", "text_hash", "host", "text")
    measured = save(rows.mapInArrow(
        partial(_measure, max_repeat_percent=max_repeat_percent, min_words=min_words), MEASURES), "measures")
    lines = measured.select("row", "host", "content", F.explode("lines").alias("line")).select(
        "row", "host", "content", "line.*")
    sizes = measured.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counted = lines.select("host", "hash", "content").distinct().groupBy("host", "hash").agg(
        F.count("*").alias("documents")).where(F.col("documents") > min_documents)
    frequent = counted.join(sizes, counted["host"].eqNullSafe(sizes["host"])).where(
        F.col("documents") > share * F.col("texts")).select(counted["host"].alias("host_"), F.col("hash").alias("hash_"))
    frequent = broadcast_if_small(save(frequent, "frequent"), BROADCAST_LINES)
    removed = lines.join(
        frequent, F.col("host").eqNullSafe(F.col("host_")) & (F.col("hash") == F.col("hash_"))).groupBy("row").agg(
        F.sum("words").alias("removed"), F.collect_list("number").alias("removed_lines"))
    judged = measured.drop("lines", "content").join(removed, "row", "left").withColumn(
        "words_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    depleted = (F.col("words_left") < min_left) | (F.col("words_left") < left_share * F.col("n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row", "removed")


def judge(docs: DataFrame, host: str = "source", *limits, **named) -> DataFrame:
    """Base statistics, ``words_left`` after the removal of frequent lines, and ``kept`` for every row; limits are
    those of :func:`_verdicts`."""
    return _verdicts(docs, host, *limits, **named).drop("host", "removed_lines")


def _without_lines(batches, place: int):
    """Texts (at ``place``) without the lines numbered in the last column, which goes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for a, b in slices(pc.coalesce(pc.binary_length(whole.column(place)), 0).to_pylist(), SLICE_BYTES):
            batch = whole.slice(a, b - a)
            names, columns = batch.schema.names, batch.columns
            if columns[-1].null_count < len(batch):
                texts = columns[place].to_pylist()
                for i, numbers in enumerate(columns[-1].to_pylist()):
                    if numbers:
                        gone = set(numbers)
                        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], names[:-1])


def clean(docs: DataFrame, host: str = "source", *limits, **named) -> DataFrame:
    """Kept rows of ``docs``, their texts without frequent lines; other columns, and texts without such lines, stay."""
    # a verdict and its lines follow from host and text alone; the names of their columns clash with none of docs
    host_, hash_, kept, lines = (private(docs, f"rules_{name}") for name in ("host", "hash", "kept", "lines"))
    edits = save(_verdicts(docs, host, *limits, **named).where("NOT kept OR removed_lines IS NOT NULL").select(
        F.col("host").alias(host_), F.col("text_hash").alias(hash_), F.col("kept").alias(kept), F.expr(
            "IF(kept, removed_lines, NULL)").alias(lines)).dropDuplicates([host_, hash_]), "edits")
    size = edits.agg(F.count("*") + F.coalesce(F.sum(F.size(F.coalesce(lines, F.array()))), F.lit(0))).first()[0]
    match = docs[host].cast("string").eqNullSafe(edits[host_]) & (
        F.xxhash64(text_or_empty(docs["text"])) == edits[hash_])
    found = docs.join(F.broadcast(edits) if size <= BROADCAST_LINES else edits, match, "left").where(
        F.coalesce(edits[kept], F.lit(True))).select(*(docs[c] for c in docs.columns), edits[lines])
    return found.mapInArrow(partial(_without_lines, place=docs.columns.index("text")), docs.schema)
