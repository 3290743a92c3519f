"""Collocations, exact copies and source divergence against plain Python, and the rows of their docstrings."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armlift.llm import collocations, exact_dedup, source_audit


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- exact copies -----------------------------------------------------------------------------------------------------


def judged(rows):
    """What the rows with (doc_id, text) should get, as a sorted list."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = sorted((i for i in ids if i is not None), reverse=True)
        keep = known[0] if known else None
        ordered = known + [None] * (len(ids) - len(known))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), k == 0, sha) for k, i in enumerate(ordered)]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("min_copies", [1, 3, 64])
def test_verdicts_of_copies(make_docs, edge_rows, min_copies):
    hot = [(1000 + k, "the Hot text" if k % 2 else "The hot TEXT", "h") for k in range(200)]
    some = [(2000 + k, f"group {k % 7}", "h") for k in range(40)] + [(None, "only nulls", "n")] * 3 + [(None, "group 1", "n")]
    rows = edge_rows + hot + some
    got = exact_dedup.verdicts(make_docs(rows), min_copies)
    assert as_rows(got) == judged([(i, t) for i, t, _ in rows])


def test_copies_of_an_empty_table(make_docs, edge):
    assert exact_dedup.verdicts(edge.limit(0)).count() == 0
    assert exact_dedup.deduplicate(edge.limit(0)).count() == 0


def test_summaries_find_frequent_keys(spark):
    rows = spark.range(200_000, numPartitions=6).selectExpr("CASE WHEN id % 3 = 0 THEN 7L WHEN id % 50 = 1 THEN 11L ELSE id END AS key")
    found = {r.key for r in exact_dedup.frequent_keys(rows, 1000).collect()}
    assert found == {7, 11}


def test_deduplicate_keeps_whole_rows(make_docs, edge_rows):
    rows = edge_rows + [(50, "Same", "a"), (50, "same", "a"), (50, "SAME", "a"), (49, "same", "b")]
    docs = make_docs(rows)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    want = Counter((i, low(t)) for i, keep, _, k, _, t in (
        (*v, t) for v, t in ((v, t) for t in {low(t) for _, t, _ in rows} for v in judged([(i, t) for i, t, _ in rows])
                             if v[4] == hashlib.sha256(t.encode()).hexdigest())) if k)
    assert Counter((r.doc_id, low(r.text)) for r in kept.collect()) == want


def test_copies_by_native_functions_only(spark, folder):
    from armlift.llm.registry import QUERIES

    plan = QUERIES["op12_exact_dedup"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- collocations -----------------------------------------------------------------------------------------------------


def phrases_of(rows, min_count, max_words, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if a >= min_count}
        inside = defaultdict(int)
        for g, a in frequent.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inside[g[i : i + n]] = max(inside[g[i : i + n]], a)
        found = []
        for g, a in frequent.items():
            if len(g) > 1 and inside[g] < a:
                score, _, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k, k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s)
                for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_count, top", [(2, 40), (5, 2000)])
def test_collocations_match_plain_counts(small, spark, min_count, top):
    docs, _ = small
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    assert as_rows(collocations.collocations(docs, min_count, top=top)) == phrases_of(rows, min_count, 5, top)


def test_collocations_on_edge_rows(spark, edge, edge_rows):
    assert as_rows(collocations.collocations(edge, 2)) == phrases_of([(t, "en") for _, t, _ in edge_rows], 2, 5, 2000)
    rows = [("a b. a b\ta  b", None), ("A B a", "und"), (None, "xx"), ("", "xx"), ("é b é b", "xx")] * 3
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, phrase int, n int")
    assert as_rows(collocations.collocations(docs, 3)) == phrases_of(rows, 3, 5, 2000)
    assert as_rows(collocations.collocations(docs, 3, max_words=2)) == phrases_of(rows, 3, 2, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, 10_000).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([
        ("en", None, 0, 9 * 10**16), ("en", "a", 1, 7 * 10**12), ("en", "b", 1, 3 * 10**12), ("en", "a b", 2, 10**12)],
        collocations.COUNTS)
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counts)
    row = collocations.collocations(counts, 100).first()
    assert row.score == 1000 * 10**12 * 9 * 10**16 // (7 * 10**12 * 3 * 10**12)


def test_lookup_without_broadcast(small, monkeypatch):
    docs, _ = small
    want = as_rows(collocations.collocations(docs, 5))
    monkeypatch.setattr(collocations, "LOOKUP_ROWS", 3)
    assert as_rows(collocations.collocations(docs, 5)) == want


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_slices_cut_between_pieces(limit):
    texts = ["one two, three", "", None, "four", "é five six.\nseven " * 5, "no break at all here " * 9, "!", "x"]
    batch = pa.record_batch([pa.array(["en"] * 8), pa.array([t or "" for t in texts])], ["lang", "text"])

    def pieces(limit):
        out = defaultdict(list)
        for k, (words, row) in enumerate(collocations.slices_of(batch, limit)):
            found = words.strings(np.arange(len(words.start))).to_pylist()
            for word, r, piece in zip(found, row, words.piece):
                out[int(r), k, int(piece)].append(word)
        return [(r, w) for (r, _, _), w in out.items()]

    assert pieces(limit) == pieces(10**9)
    want = [(r, re.findall(r"[^\x20\x09]+", p)) for r, t in enumerate(texts) for p in re.split(r"[.,;:!?\x0a-\x0d]", t or "")]
    assert pieces(limit) == [(r, w) for r, w in want if w]


def test_tasks_of_the_second_pass_send_a_phrase_once(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    text = "one two three. four five, one two"  # 5 words, 3 pairs, 1 phrase of three; their total is a row more

    def sent(parts, length_sum=0):
        docs = spark.createDataFrame([("en", text)] * 20 * parts, "lang string, text string").repartition(parts)
        rows = collocations.partial_counts(docs, [], 5, length_sum).collect()
        assert sum(r.n for r in rows if r.words == 0) == 7 * 20 * parts
        return len(rows)

    assert sent(1) == 10
    assert sent(12 * cores) == 2 * cores * 10  # not with every part of the input
    assert sent(12 * cores, 3 * cores * collocations.TASK_BYTES) == 3 * cores * 10

    monkeypatch.setattr(collocations, "SLICE_BYTES", 40)  # many slices in a batch
    batch = pa.record_batch([pa.array(["en", "xx"] * 50), pa.array([text] * 100)], ["lang", "text"])
    rows = [tuple(r.values()) for b in collocations._add_up(
        collocations._count_slices([batch, batch], [], 5), 1 << 20) for r in b.to_pylist()]
    assert len(rows) == len({r[:3] for r in rows})
    assert ("xx", "one two", 2, 200) in rows and ("en", None, 0, 700) in rows


@pytest.mark.parametrize("limit", [1, 300, 2000, 10**9])
def test_sums_of_slices_within_a_bound(limit):
    rng = np.random.default_rng(5)
    slices = []
    for _ in range(30):
        names = [f"w{min(k, 60)}" for k in rng.zipf(1.4, 25)]
        slices.append(pa.record_batch([
            pa.array(["en", "de", "und", "en", "xx"] * 5), pa.array([None if x == "w3" else x for x in names], pa.string()),
            pa.array([0 if x == "w3" else 1 for x in names], pa.int32()), pa.array(rng.integers(1, 9, 25))],
            ["lang", "phrase", "words", "n"]))
    want, got = Counter(), Counter()
    for b in slices:
        for r in b.to_pylist():
            want[r["lang"], r["phrase"], r["words"]] += r["n"]
    sums = list(collocations._add_up(iter(slices), limit))
    for b in sums:
        assert b.schema.equals(slices[0].schema)
        for r in b.to_pylist():
            got[r["lang"], r["phrase"], r["words"]] += r["n"]
    assert got == want
    assert limit < 10**9 or sum(b.num_rows for b in sums) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(2, 20))
def test_summaries_keep_every_frequent_key(parts, threshold):
    counts = Counter(x for p in parts for x in p)
    mass = sum(counts.values())
    summary = collocations.MisraGries(mass // threshold + 1, threshold)
    for p in parts:
        keys, n = np.unique(np.array(p, np.uint32), return_counts=True)
        keys, n = collocations._unpack(collocations._pack(keys, n)) if len(keys) else (keys, n)
        summary.merge([(keys, n)])
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert summary.lowered < threshold and len(kept) <= mass // threshold + 1
    assert all(c - summary.lowered <= kept.get(k, 0) <= c for k, c in counts.items())
    assert {k for k, c in counts.items() if c >= threshold} <= set(summary.frequent().tolist())


def test_summary_grows_rather_than_lose_a_key():
    summary = collocations.MisraGries(2, 4)  # a capacity below mass / threshold
    for _ in range(5):
        summary.merge([(np.arange(10, dtype=np.uint32), np.ones(10, np.int64))])
    assert summary.lowered < 4 and set(summary.frequent().tolist()) == set(range(10))


# --- source divergence ------------------------------------------------------------------------------------------------


def audited(rows, min_documents=3):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, within, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, d in within[lang].items() if d >= min_documents)
        all_n = sum((counts[lang, s] for s in names), Counter())

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in names}, shares(all_n)
        f = lambda x, y: (x - y) ** 2 // y
        for s in names:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), "pair") for o in names if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), "term") for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, item.decode(), -v, rank) for found in (pair, sorted(term)[:200])
                    for rank, (v, item, part) in enumerate(sorted(found), 1)]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_matches_plain_counts(small):
    docs, _ = small
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert audit_rows(source_audit.audit(docs)) == audited(rows)


def test_audit_in_small_shards_and_matrices(small, monkeypatch):
    docs, _ = small
    want = audit_rows(source_audit.audit(docs, 2))
    monkeypatch.setattr(source_audit, "SHARD_TERMS", 1)
    assert audit_rows(source_audit.audit(docs, 2)) == want


def test_audit_on_edge_rows(spark, edge, edge_rows):
    assert audit_rows(source_audit.audit(edge, 1)) == audited([("en", s, t) for _, t, s in edge_rows], 1)
    rows = [(None, None, "a b"), ("", "s", "a a é"), (None, "t", None), ("x", "only", "a a a"), ("y", "1", "--"),
            ("y", "2", "1 2 3"), ("z", "Ä", "b b"), ("z", "z", "B c_d"), ("z", None, "b@b")] * 2
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, shard int")
    assert audit_rows(source_audit.audit(docs)) == audited(rows)
    assert audit_rows(source_audit.audit(docs, 2)) == audited(rows, 2)
    assert audit_rows(source_audit.audit(docs.limit(0))) == []


def test_slices_of_an_audit_batch():
    texts = ["Alpha beta", "É x" * 900_000, "gamma GAMMA", ""] * 3
    batch = pa.record_batch([pa.array(["en"] * 12), pa.array(["s"] * 12), pa.array(texts)], ["lang", "source", "text"])
    got = Counter()
    for out in source_audit._partial_counts([batch]):
        for r in out.to_pylist():
            if r["term"] is not None:
                got[r["term"]] += r["n"]
    assert got == Counter(t for x in texts for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(x)))


@given(st.integers(0, 8 * 10**14), st.integers(1, 8 * 10**14))
def test_long_division_is_exact(count, more):
    total = count + more
    got = source_audit.parts_of(np.array([count]), np.array([total]))[0]
    assert got == 1 + 10**9 * (count + 1) // total
