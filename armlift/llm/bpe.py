"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a block of texts lie in one symbol array with links to the next and previous symbol. The
index maps each adjacent pair that has a merge (by its rank) to all its positions in the block. Active ranks are taken
in ascending order: all positions of the pair are merged at once, and only the pairs to their left and right get new
ranks and enter the lists of those ranks. A pair that a merge creates always ranks behind that merge (checked when the
file is loaded), so that one ascending pass merges every word as if it were alone.

Tokens do not reach over white space, so a text is the ids of its words in a row; words are remembered per worker up to
a bound. Decoding joins the token strings with spaces, as the file's tokenizer does (it names no decoder).

Null or empty texts have no ids and decode to "". Repeated rows, null doc_ids and very long texts need no special care;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlift.llm.encoders import (
    BYTE_LETTERS, LONGEST_WORD, PLAIN_WORD, WORD_BPE, load_tokenizer, tokenizer_path, words,
)
from armlift.llm.shared import slices, text_or_empty, worker_cache

BLOCK_BYTES = 5 << 20
NO_RANK = 1 << 30
MAX_WORDS = 200_000  # remembered words per worker
LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PairIndexBpe:
    """Ids of words by batch-wide merging; reads vocabulary, merges, pattern and special tokens from the file."""

    def __init__(self, name: str = WORD_BPE, max_words: int = MAX_WORDS):
        import numpy as np

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or spec["decoder"] is not None:
            raise ValueError(f"{name}: only lower-casing word BPE files without a decoder are understood")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.library = load_tokenizer(name)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        letter = [chr(BYTE_LETTERS.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in letter], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letter], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        made = np.full(len(self.tokens), -1, np.int64)
        made[self.product] = np.arange(len(merges))
        if (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{name}: a merge ranks before one that makes its parts")
        self.same = left == right
        keys = left * len(self.tokens) + right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        self.max_words = max_words
        self.known: dict[str, bytes] = {}

    def pretokens(self, word: str) -> list[str]:
        """Lower-case pieces that are merged alone; special tokens stay whole."""
        plain = PLAIN_WORD.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            return [letters.lower(), marks] if marks else [letters.lower()]
        out = []
        for part in self.cut.split(word) if self.special else [word]:
            if part in self.special:
                out.append(part)
            elif part:
                # the library's own normaliser and pattern, for its version of the Unicode tables
                part = self.library.normalizer.normalize_str(part)
                out += [p.translate(LETTER_BYTES).encode("latin-1").decode()
                        for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _ranks(self, a, b):
        import numpy as np

        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def merge(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit (the UTF-8 bytes of a pretoken) as bytes of ``dtype``."""
        import numpy as np

        if not units:
            return []
        data = np.frombuffer(b"".join(units), np.uint8)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        n = len(data)
        ends = np.cumsum(lengths)
        last = ends - 1
        symbol = self.inner[data]
        symbol[last] = self.final[data[last]]
        after = np.arange(1, n + 1)
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[ends - lengths] = -1
        rank = np.full(n, NO_RANK, np.int64)
        inside = np.flatnonzero(after >= 0)
        rank[inside] = self._ranks(symbol[inside], symbol[inside + 1])
        index: dict[int, list] = {}

        def enter(places, ranks):
            keep = ranks < NO_RANK
            places, ranks = places[keep], ranks[keep]
            if not len(places):
                return
            if len(places) > 1:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[[0, *cuts.tolist()]].tolist(), np.split(places, cuts) if len(cuts) else [places]):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    if active is not None:
                        heappush(active, r)

        active = None
        enter(inside, rank[inside])
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if self.same[r] and len(at) > 1:  # runs of one symbol: pairs from the left
                at.sort()
                taken = []
                free = -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != free:
                        taken.append(p)
                        free = q
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.product[r]
            symbol[gone] = -1
            rank[gone] = NO_RANK
            after[at] = beyond
            open_end = beyond >= 0
            before[beyond[open_end]] = at[open_end]
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[changed]
            ranks = np.full(len(changed), NO_RANK, np.int64)
            paired = right >= 0
            ranks[paired] = self._ranks(symbol[changed[paired]], symbol[right[paired]])
            rank[changed] = ranks
            enter(changed, ranks)
        alive = symbol >= 0
        counts = np.add.reduceat(alive, ends - lengths) if n else []
        flat = symbol[alive].astype(self.dtype).tobytes()
        width = self.dtype.itemsize
        bounds = [0, *(np.cumsum(counts) * width).tolist()]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        import numpy as np

        parts = [self.pretokens(w) for w in new]
        units = list({p for ps in parts for p in ps if p not in self.special})
        ids = dict(zip(units, self.merge([u.encode() for u in units])))
        ids.update({t: np.array([i], self.dtype).tobytes() for t, i in self.special.items()})
        return {w: b"".join(map(ids.__getitem__, ps)) for w, ps in zip(new, parts)}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [words(t) for t in texts]
        need = set().union(*split)
        new = need.difference(self.known)
        if len(self.known) + len(new) > self.max_words:
            self.known, new = {}, need
        self.known.update(self._learn(list(new)))
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        if len(self.known) > self.max_words:
            self.known.clear()
        for word in new:
            if len(word) > LONGEST_WORD:
                self.known.pop(word, None)
        return out

    def decode(self, ids) -> bytes:
        """The decoded text of integer ids, in UTF-8; unknown ids are left out."""
        top = len(self.tokens)
        return b" ".join([self.tokens[i] for i in ids if i < top and self.tokens[i]])


def _digest(batches, tokenizer: str):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    bpe = worker_cache(("bpe", tokenizer), lambda: PairIndexBpe(tokenizer))

    def done(block):
        table = pa.Table.from_batches(block).combine_chunks()
        docs, column = table.column(0), table.column(1).combine_chunks()
        counts, id_digests, text_digests = [], [], []
        for ids in bpe.encode(column.to_pylist()):
            values = np.frombuffer(ids, bpe.dtype)
            counts.append(len(values))
            id_digests.append(hashlib.sha256(values.astype("<u4").tobytes()).hexdigest())
            text_digests.append(hashlib.sha256(bpe.decode(values.tolist())).hexdigest())
        return pa.RecordBatch.from_arrays(
            [docs.combine_chunks(), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    block, held = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_pylist()
        for a, b in slices(sizes, BLOCK_BYTES):
            block.append(batch.slice(a, b - a))
            held += sum(sizes[a:b])
            if held >= BLOCK_BYTES:
                yield done(block)
                block, held = [], 0
    if block:
        yield done(block)


def encode_decode(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the text that they decode to."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_digest, tokenizer=tokenizer), DIGESTS)
