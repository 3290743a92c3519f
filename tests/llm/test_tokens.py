"""Encoders, token files, counts and packing against the tokenizer libraries text by text."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armlift.llm import bpe, encoders, packing, token_counts, token_files
from armlift.llm.elias_fano import EliasFano


def le32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def library():
    tokenizer = encoders.load_tokenizer()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pair_index():
    return bpe.PairIndexBpe()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(library, pair_index, text):
    want = library(text)
    assert np.frombuffer(encoders.word_encoder().encode([text])[0], "<u2").tolist() == want
    assert np.frombuffer(pair_index.encode([text])[0], "<u2").tolist() == want


def test_runs_of_one_letter_merge_from_the_left(library, pair_index):
    texts = ["a" * n for n in range(1, 40)] + ["!" * n for n in range(1, 20)] + ["abab" * 9, "lalalala-la"]
    for text, got in zip(texts, pair_index.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == library(text)


def test_memory_bounds_do_not_change_ids(library, small):
    tight = bpe.PairIndexBpe(max_words=50), encoders.WordEncoder(max_words=50)
    for _, text in small[1][:40]:
        for encoder in tight:
            assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == library(text)


def test_decode_gives_the_library_s_text(pair_index, small):
    tokenizer = encoders.load_tokenizer()
    for _, text in small[1][:50]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert pair_index.decode(ids).decode() == tokenizer.decode(ids, skip_special_tokens=False)


def test_encode_decode_digests(edge, edge_rows, library):
    tokenizer = encoders.load_tokenizer()
    want = sorted((i or -1, len(x := library(t)), hashlib.sha256(le32(x)).hexdigest(),
                   hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest())
                  for i, t, _ in edge_rows)
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.encode_decode(edge).collect()) == want


def test_counts(edge, edge_rows, small):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=encoders.tokenizer_path(encoders.PIECE_BPE))
    want = sorted((i or -1, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in edge_rows)
    assert sorted((r[0] or -1, *r[1:]) for r in token_counts.count_tokens(edge).collect()) == want
    docs, rows = small
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: len(model.encode(t)) for i, t in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ▁é,\n", max_size=60), st.integers(1, 8))
def test_split_texts_add_up(text, size):
    count, may_split = token_counts.counter(encoders.PIECE_BPE)
    assert may_split
    assert sum(count(token_counts.split_text(text, size))) == count([text])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 40), 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    coded = EliasFano.of(np.array(values, np.int64))
    read, used = EliasFano.read(memoryview(coded.to_bytes() + b"tail"))
    assert used == len(coded.to_bytes()) and read.all().tolist() == values
    assert [read.select(i) for i in range(0, len(values), 37)] == values[::37]


def test_segments_give_single_documents(small, library):
    texts = [t for _, t in small[1][:60]]
    segment = token_files.build_segment(list(range(60)), encoders.word_encoder().encode(texts), 2)
    for i in (0, 1, 31, 59):
        assert token_files.document_ids(segment, i).tolist() == library(texts[i])


def test_encoder_of_a_file_that_keeps_white_space(small):
    tokenizer = encoders.load_tokenizer("byte_bpe_50k.json")
    encoder = encoders.WordEncoder("byte_bpe_50k.json")
    texts = [t for _, t in small[1][:30]] + ["", "  a  b\n", "ÉTÉ x"]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10_000))
    assert len(EliasFano.of(ends).to_bytes()) < 10_000 * 12 / 8


@pytest.mark.parametrize("segment_ids", [1, 5000])
def test_token_files_round_trip(small, library, segment_ids):
    docs, rows = small
    got = token_files.read_tokens(token_files.write_tokens(docs, segment_ids=segment_ids)).orderBy("doc_id").collect()
    at = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = library(text) + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(le32(ids)))
        at += len(ids)


def test_token_files_with_nulls_and_repeated_ids(edge, edge_rows, library):
    got = sorted(token_files.read_tokens(token_files.write_tokens(edge)).collect(), key=lambda r: r.start)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, text, _) in zip(got, order, strict=True):
        ids = library(text) + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(le32(ids)))
        at += len(ids)


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_covers_every_id_once(small, edge, edge_rows, library, window):
    for docs, rows in (small, (edge, [(i, t) for i, t, _ in edge_rows])):
        got = packing.pack(docs, window=window).collect()
        texts = sorted((i or -1, library(t) + [2]) for i, t in rows)
        total = sum(len(x) for _, x in texts)
        places = sorted((r.sequence_id, r.offset, r.length) for r in got)
        at = 0
        for sequence, offset, length in places:
            assert (sequence, offset) == divmod(at, window) and 0 < length <= window - offset
            at += length
        assert at == total
        short = total % window
        for r in got:
            last = r.sequence_id == total // window
            assert r.padded_to == (short if last and short & (short - 1) == 0 else window)
        pieces = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            if r.start == 0:
                pieces.setdefault((r.doc_id or -1, r.doc_tokens), []).append([])
            pieces[r.doc_id or -1, r.doc_tokens][-1].append((r.start, r.length, r.ids_crc32))
        for i, ids in texts:
            open_lists = pieces[i, len(ids)]
            assert any(all(zlib.crc32(le32(ids[s : s + n])) == c for s, n, c in p)
                       and sum(n for _, n, _ in p) == len(ids) for p in open_lists)


def test_empty_tables(make_docs):
    none = make_docs([])
    for frame in (bpe.encode_decode(none), token_counts.count_tokens(none), packing.pack(none),
                  token_files.read_tokens(token_files.write_tokens(none))):
        assert frame.count() == 0
