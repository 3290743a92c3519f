"""Packing: concatenate and cut.

Pass 1 encodes every document (ids and the end id) in its scan task and writes the ids with each document's place
inside the partition. Partition token totals, one row per partition, become global offsets by a prefix sum. Pass 2
adds them and cuts at fixed windows; a document over a window's edge becomes several boundary records. Nothing is
shuffled but the totals, and no group exists that could be hot.

Order of concatenation: partitions in scan order, rows as read. Null or empty texts hold the end id alone. Null ids of
documents and repeated rows are packed like any other. Only the last sequence can be short: it is padded to the window
unless its fill is a power of two. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from armlift.llm.encoders import WORD_BPE, word_encoder
from armlift.llm.shared import save, slices, text_or_empty

END_ID = 2
BATCH_BYTES = 4 << 20

ENCODED = "doc_id bigint, part int, before bigint, n_tokens bigint, ids binary"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, padded_to bigint")


def _encode(batches, tokenizer: str, end_id: int):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    encoder = word_encoder(tokenizer)
    end = np.array([end_id], encoder.dtype).tobytes()
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        column = batch.column(1)
        sizes = [len(x) for x in column.to_pylist()] if batch.num_rows == 1 else _lengths(column)
        for a, b in slices(sizes, BATCH_BYTES):
            ids = [x + end for x in encoder.encode(column.slice(a, b - a).to_pylist())]
            counts = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts),
                pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n_tokens", "ids"])


def _lengths(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def encode_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids) of every document, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return save(rows.mapInArrow(partial(_encode, tokenizer=tokenizer, end_id=end_id), ENCODED), "encoded")


def with_part_offsets(rows: DataFrame, before: str, n_tokens: str) -> DataFrame:
    """Add ``part_start`` (ids of all earlier partitions) and ``total``, from one row of totals per partition."""
    totals = rows.groupBy("part").agg(F.max(F.col(before) + F.col(n_tokens)).alias("_size"))
    # One row per partition of the scan: bounded by the number of tasks, not by the documents.
    order = Window.orderBy("part")
    offsets = totals.select(
        "part", (F.sum("_size").over(order) - F.col("_size")).alias("part_start"),
        F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return rows.join(F.broadcast(offsets), "part")


def _cut(batches, window: int, width: int):
    import numpy as np
    import pyarrow as pa

    source = np.dtype(f"<u{width}")
    for batch in batches:
        rows = []
        for doc, at, total, ids in zip(*(c.to_pylist() for c in batch.columns)):
            wide = memoryview(np.frombuffer(ids, source).astype("<u4").tobytes())
            n, done = len(wide) // 4, 0
            while done < n:
                sequence, offset = divmod(at + done, window)
                length = min(window - offset, n - done)
                fill = min(window, total - sequence * window)
                padded = fill if fill & (fill - 1) == 0 else window
                rows.append((doc, done, length, zlib.crc32(wide[4 * done : 4 * (done + length)]), n, sequence,
                             offset, padded))
                done += length
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, window: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Boundary records of all documents concatenated and cut into sequences of ``window`` ids."""
    encoded = encode_documents(docs, tokenizer, end_id)
    width = word_encoder(tokenizer).dtype.itemsize
    placed = with_part_offsets(encoded, "before", "n_tokens")
    rows = placed.select("doc_id", (F.col("part_start") + F.col("before")).alias("at"), "total", "ids")
    return rows.mapInArrow(partial(_cut, window=window, width=width), PIECES)
