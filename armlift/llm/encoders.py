"""Whole-text encoding with the public tokenizer libraries inside Spark tasks.

``word_bpe_49k.json`` drops white space, so no token reaches over it: the ids of a text are the ids of its
white-space-delimited words in a row. A distinct word is given to the tokenizers library once per worker and then
remembered; texts are joined from bytes. Files that keep white space are given whole texts instead.
"""

from __future__ import annotations

import os
import re
from array import array

from armlift.llm.shared import worker_cache

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
MAX_WORDS = 300_000  # remembered words (and as many parts) per worker, about 120 MB; then it starts anew
LONGEST_WORD = 64  # longer words are encoded each time, so that memory stays bounded
# str.split() also splits at these four, which the tokenizer takes for ordinary characters.
NOT_SPACE = re.compile("[\x1c-\x1f]")
ASCII_WORD = re.compile("[^\x20\x09-\x0d]+")
# Latin letters (all NFC-stable and one letter long in lower case), then ASCII marks without the apostrophe: here the
# tokenizer's normaliser only lowers, and its pattern cuts once, between letters and marks.
PLAIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@[-`{-~]*)")
PROBES = ("One", "été,", "a", "STRASSE", "straße...", "x!!", "Überlängen;", "z")
# Byte-level alphabet of the public BPE files: printable bytes stand for themselves, others for U+0100 and up.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers, or ``name`` itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str = WORD_BPE):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def words(text: str) -> list[str]:
    return ASCII_WORD.findall(text) if NOT_SPACE.search(text) else text.split()


class _Memo(dict):
    """A dictionary that computes what it lacks and starts anew when it is full."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """``encode(texts)`` returns each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, name: str = WORD_BPE, max_words: int = MAX_WORDS):
        import numpy as np

        self.tokenizer = load_tokenizer(name)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._model = self.tokenizer.model
        self._plain = True
        self._parts = _Memo(self._part, max_words)
        self._words = _Memo(self._word, max_words)
        ids = self._library
        # what the short ways rest on, tried on this file
        self._by_word = all(ids(f"{a} {b}") == ids(f" {a}\n\t{b} ") == ids(a) + ids(b) for a, b in zip(PROBES, PROBES[1:]))
        self._plain = self._by_word and all(self._word(w) == ids(w) for w in PROBES)

    def _library(self, text: str) -> bytes:
        return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """One run of letters or of marks, already lower case: straight to the BPE model."""
        units = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self._code, [t.id for t in self._model.tokenize(units)]).tobytes()

    def _word(self, word: str) -> bytes:
        plain = PLAIN_WORD.fullmatch(word) if self._plain else None
        if plain is None:
            return self._library(word)
        letters, marks = plain.groups()
        ids = self._parts[letters.lower()]
        return ids + self._parts[marks] if marks else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [array(self._code, e.ids).tobytes() for e in found]
        get = self._words.__getitem__
        return [b"".join(map(get, words(t))) for t in texts]


def word_encoder(name: str = WORD_BPE) -> WordEncoder:
    """The worker's own encoder; Python workers live on between tasks."""
    return worker_cache(("words", name), lambda: WordEncoder(name))
