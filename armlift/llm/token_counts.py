"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

Long texts are split at safe boundaries. No piece of the model has a space mark after another character, so no token
reaches over the place between a non-space and a space; the model adds a space mark before each text, which stands for
the one space left out at the cut. Parts of a text may land in different batches; their counts are added. A vocabulary
with pieces over that place (or without the added mark) is not split.

Null or empty texts have 0 bytes and 0 tokens. Repeated rows and null doc_ids are counted like any other; extra columns
are ignored.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.encoders import PIECE_BPE, load_tokenizer, tokenizer_path
from armlift.llm.shared import text_or_empty, worker_cache

BATCH_CHARS = 1 << 18
LONG_TEXT = 1 << 14
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
SAFE = re.compile("(?<=[^ ▁]) (?=.)", re.S)


def _may_split(model) -> bool:
    over = re.compile("[^▁]▁")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(over.search(p) for p in pieces) and model.encode("a", out_type=str)[0].startswith("▁")


def counter(name: str):
    """(function from texts to token counts, whether long texts may be split)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        return lambda texts: list(map(len, model.encode(texts, num_threads=1))), _may_split(model)
    tokenizer = load_tokenizer(name)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)], False


def split_text(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of at least ``size`` characters whose token counts add up to the text's; the space at a cut is left out."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def _count(batches, tokenizer: str, limit: int):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    count, may_split = worker_cache(("counter", tokenizer), lambda: counter(tokenizer))
    for batch in batches:
        totals = np.zeros(batch.num_rows, np.int64)
        owners: list[int] = []
        texts: list[str] = []
        held = 0
        for row, text in enumerate(batch.column(1)):
            text = text.as_py()
            for part in split_text(text) if may_split else [text]:
                owners.append(row)
                texts.append(part)
                held += len(part)
                if held >= BATCH_CHARS:
                    np.add.at(totals, owners, count(texts))
                    owners, texts, held = [], [], 0
        if texts:
            np.add.at(totals, owners, count(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.cast(pc.binary_length(batch.column(1)), pa.int64()), pa.array(totals),
             pa.array(totals > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, tokenizer: str = PIECE_BPE, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_count, tokenizer=tokenizer, limit=limit), COUNTS)
