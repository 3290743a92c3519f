"""Token-id output: segments of concatenated ids with Elias-Fano coded document boundaries.

A segment is one self-contained binary record: ``EFT1``, id width, number of leading null doc_ids, the Elias-Fano list
of doc_ids, the Elias-Fano list of boundaries (0 first, all ids last), then the ids. Boundaries come back through
select structures; no table of 64-bit offsets is stored. Segments are written by Spark's own Parquet writer (one binary
column beside a few integers), so that the output commits atomically, survives lost executors and lies in any store.

Documents are ordered by doc_id: range partitions, sorted inside. A segment's place in its partition is written with
it; partition totals, one row each, give global starts. A segment ends at a document's end after ``SEGMENT_IDS`` ids.

Null texts are empty (the end id alone). Null doc_ids come first; rows with the same doc_id are ordered by text.
Extra columns are ignored; an empty table gives an empty file set and no rows.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.elias_fano import EliasFano
from armlift.llm.encoders import WORD_BPE, word_encoder
from armlift.llm.packing import BATCH_BYTES, END_ID, _lengths, with_part_offsets
from armlift.llm.shared import save, slices, text_or_empty

SEGMENT_IDS = 1 << 18
HEAD = "<4sHHI"
SEGMENTS = "part int, before bigint, n_docs bigint, n_tokens bigint, segment binary"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def build_segment(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    import numpy as np

    known = np.array([d for d in doc_ids if d is not None], np.int64)
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    head = struct.pack(HEAD, b"EFT1", width, 0, len(doc_ids) - len(known))
    return head + EliasFano.of(known).to_bytes() + EliasFano.of(ends).to_bytes() + b"".join(ids)


def open_segment(data: bytes):
    """(doc_ids, boundaries as Elias-Fano, ids as an array) of one segment."""
    import numpy as np

    magic, width, _, n_null = struct.unpack_from(HEAD, data)
    if magic != b"EFT1":
        raise ValueError("not a token segment")
    view = memoryview(data)[struct.calcsize(HEAD) :]
    docs, used = EliasFano.read(view)
    bounds, more = EliasFano.read(view[used:])
    doc_ids = [None] * n_null + docs.all().tolist()
    return doc_ids, bounds, np.frombuffer(view[used + more :], f"<u{width}")


def document_ids(data: bytes, i: int):
    """The ids of the i-th document of a segment, by two selects; the other boundaries are not decoded."""
    _, bounds, ids = open_segment(data)
    return ids[bounds.select(i) : bounds.select(i + 1)]


def _write(batches, tokenizer: str, end_id: int, segment_ids: int):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    encoder = word_encoder(tokenizer)
    width = encoder.dtype.itemsize
    end = np.array([end_id], encoder.dtype).tobytes()
    part, before = TaskContext.get().partitionId(), 0
    docs: list = []
    ids: list[bytes] = []
    held = 0

    def flush():
        nonlocal docs, ids, held, before
        row = [[part], [before], [len(docs)], [held], [build_segment(docs, ids, width)]]
        before, docs, ids, held = before + held, [], [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            ["part", "before", "n_docs", "n_tokens", "segment"])

    for batch in batches:
        for a, b in slices(_lengths(batch.column(1)), BATCH_BYTES):
            found = encoder.encode(batch.column(1).slice(a, b - a).to_pylist())
            for doc, x in zip(batch.column(0).slice(a, b - a).to_pylist(), found):
                docs.append(doc)
                ids.append(x + end)
                held += len(x) // width + 1
                if held >= segment_ids:
                    yield flush()
    if docs:
        yield flush()


def write_tokens(
    docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Encode in doc_id order and write the segments; returns the written segments as a table."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(
        partial(_write, tokenizer=tokenizer, end_id=end_id, segment_ids=segment_ids), SEGMENTS)
    return save(made, "tokens")


def _read(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs, bounds, ids = open_segment(data.as_py())
            cuts = bounds.all()
            wide = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(at + cuts[:-1]), pa.array(np.diff(cuts)),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(segments: DataFrame) -> DataFrame:
    """One row per document, from the segments alone."""
    placed = with_part_offsets(segments.select("part", "before", "n_tokens", "segment"), "before", "n_tokens")
    return placed.select((F.col("part_start") + F.col("before")).alias("at"), "segment").mapInArrow(_read, READ)
