"""Near duplicates, line rules, quality model and fingerprints against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from armlift.llm import fingerprints, line_rules, near_dedup, quality_model
from armlift.llm.components import components
from armlift.llm.shared import without

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)])


def groups(rows):
    """doc_id -> smallest linked doc_id, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def shown(found):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    return sorted(rows, key=repr)


def near_family(n, size, seed):
    """Copies of copies with words replaced, at all similarities around the threshold."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, size)]]
    for _ in range(n - 1):
        words = list(texts[rng.integers(len(texts))])
        for at in rng.integers(0, size, rng.integers(0, size // 20 + 2)):
            words[at] = f"w{rng.integers(0, 5000)}"
        texts.append(words)
    return [" ".join(w) for w in texts]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7), (500, 100)]
    got = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 200, 300, 500)}}


@pytest.mark.parametrize("block", [None, 16])
def test_near_groups_match_all_pairs(make_docs, monkeypatch, block):
    if block:  # many blocks per bucket and group
        monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", block)
        monkeypatch.setattr(near_dedup, "GROUP_BLOCK", block)
    texts = near_family(120, 60, 1) + near_family(60, 30, 2) + ["same text here again and again"] * 40 + ["A b", "a B"]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    found = near_dedup.near_groups(make_docs([(i, t, "s") for i, t in rows]))
    assert shown(found) == sorted(groups(rows), key=repr)
    assert found.where("kept").count() == found.select("component_id").distinct().count()


def test_rows_compared_in_a_family_grow_linearly(make_docs, monkeypatch):
    """Variants of one text, all linked with it: blocks meet the pivots, and nothing is left to pair block by block."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 32)
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", 32)
    inner, placed_rows = near_dedup._grouped_components, {}

    def counted(rows, key, compare, name):
        def wrapped(placed):
            placed_rows.setdefault(name, []).append(placed.count())
            return compare(placed)
        return inner(rows, key, wrapped, name)

    monkeypatch.setattr(near_dedup, "_grouped_components", counted)
    seen = {}
    for m in (400, 800):
        rng = np.random.default_rng(5)
        base, texts = [f"w{x}" for x in range(300)], []
        for k in range(m):
            words = list(base)
            for at in rng.integers(0, 300, 3):
                words[at] = f"v{k}_{at}"
            texts.append(" ".join(words))
        placed_rows.clear()
        found = near_dedup.near_groups(make_docs([(i, t, "s") for i, t in enumerate(texts)] + [(9000, "far from all of them", "s")]))
        assert found.where("kept").count() == 2 and found.where("component_id = 0").count() == m
        seen[m] = {name: sum(counts) for name, counts in placed_rows.items()}
    blocks = 800 / 32
    assert seen[800]["links"] < 800 * 2  # all pairs of blocks would be 800 * 25
    for name in ("alike", "links"):
        assert seen[800][name] < 3 * seen[400][name] and seen[800][name] < 48 * 800 * blocks / 4


def test_components_of_a_star_and_a_long_chain(spark):
    star = spark.range(1, 5000).selectExpr("id AS a", "0L AS b").union(spark.range(10_000, 10_200).selectExpr("id AS a", "id + 1 AS b"))
    got = components(star).groupBy("root").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5000), (10_000, 201)]


def test_near_groups_on_edge_rows(edge, edge_rows, make_docs, small):
    rows = [(i, t) for i, t, _ in edge_rows]
    assert shown(near_dedup.near_groups(edge)) == sorted(groups(rows), key=repr)
    assert near_dedup.near_groups(make_docs([])).count() == 0
    docs, rows = small
    assert shown(near_dedup.near_groups(docs)) == sorted(groups(rows), key=repr)


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(five)
    covered = {k for i, w in enumerate(five) if count[w] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def kept_by_lines(rows):
    """Verdicts by plain counting; near copies are told apart by the least hash, as the operator does."""
    from armlift.llm.words import Words
    import pyarrow as pa

    seen = {}
    documents = []
    for i, text, host in rows:
        words = Words(pa.array([text or ""]))
        h = words.hashes()
        _, hashes, sketches, counts = line_rules.line_hashes(words, h)
        documents.append((text, host, list(zip(hashes.tolist(), counts.tolist()))))
        for line, sketch in zip(hashes.tolist(), sketches.tolist()):
            seen.setdefault((host, line), set()).add(sketch)
    size = Counter(host for _, _, host in rows)
    out = []
    for text, host, lines in documents:
        n = sum(c for _, c in lines)
        left = sum(c for line, c in lines if not (
            len(seen[host, line]) > line_rules.MIN_DOCUMENTS
            and len(seen[host, line]) > line_rules.SHARE * size[host]))
        out.append((left, not measures(text)[5] and left >= line_rules.MIN_LEFT and left >= line_rules.LEFT_SHARE * n))
    return out


def test_line_rules(small, edge, edge_rows, make_docs):
    rng = np.random.default_rng(3)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 3000, n))

    rows = [(k, f"Subscribe to our news and  follow us\n{prose(30)}\n{prose(12)}", "a") for k in range(60)]
    rows += [(100 + k, "subscribe TO our news and follow us\n" + prose(6), "a") for k in range(5)]
    rows += [(200 + k, "One page that was copied very often\nwith a second line that makes it long enough", "a")
             for k in range(300)]
    for data in (rows, edge_rows, [(i, t, "x") for i, t in small[1]]):
        docs = make_docs(data)
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                       r.words_left, r.kept) for r in line_rules.judge(docs).collect()), key=repr)
        want = sorted(((i, *measures(t), *v) for (i, t, _), v in zip(data, kept_by_lines(data))), key=repr)
        assert got == want
    verdict = {r.doc_id: r.kept for r in line_rules.judge(make_docs(rows)).collect()}
    assert all(verdict[k] for k in range(60)) and not any(verdict[100 + k] for k in range(5))
    assert all(verdict[200 + k] for k in range(300))  # copies are no frequent lines
    assert line_rules.judge(make_docs([])).count() == 0


def test_pages_that_share_most_lines_are_documents_of_their_own(make_docs):
    shared = [" ".join(f"s{line}x{k}" for k in range(20)) for line in range(9)]
    rows = [(k, "\n".join([*shared, " ".join(f"own{k}x{j}" for j in range(10))]), "a") for k in range(200)]
    rows += [(1000 + k, "\n".join(shared[: 2 + k % 7]), "b") for k in range(200)]  # 7 documents, copied
    rows += [(2000 + k, "\n".join([shared[0], *(x for j, x in enumerate(shared[1:]) if k >> j & 1)]), "c")
             for k in range(64)]  # 64 documents of common lines only
    seen, sizes = {}, {}
    for _, text, host in rows:
        sizes.setdefault(host, set()).add(text)
        for line in text.split("\n"):
            seen.setdefault((host, line), set()).add(text)
    over = {k for k, texts in seen.items() if len(texts) > max(20, 0.02 * len(sizes[k[0]]))}
    want = {i: sum(len(x.split()) for x in text.split("\n") if (host, x) not in over) for i, text, host in rows}
    got = {r.doc_id: (r.words_left, r.kept) for r in line_rules.judge(make_docs(rows), max_repeat_percent=100).collect()}
    assert {i: left for i, (left, _) in got.items()} == want
    assert [got[k] for k in (0, 199)] == [(10, False)] * 2 and got[1000] == (40, True) and got[2063] == (0, False)


def test_rejected_rows_go_and_others_stay_as_they_are(edge, edge_rows):
    verdicts = line_rules.judge(edge)
    stays = without(edge, verdicts)
    assert stays.columns == edge.columns
    want = Counter(t for i, t, _ in edge_rows if not measures(t)[5])
    assert Counter(r.text for r in stays.collect()) == want


@pytest.fixture(scope="module")
def quality(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, quality_model.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")


def test_quality_on_held_out_rows(quality):
    import zlib

    found = quality[2]
    assert (found["held_out"] == found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all() and found["score"].between(0, 1).all()
    held = found[found["held_out"] & found["quality"].notna()]
    good, bad = (held.loc[held["quality"] == q, "score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_quality_ignores_labels_of_held_out_rows(quality, spark):
    from pyspark.sql import functions as F

    docs, labels, found = quality
    turned = labels.withColumn("quality", F.when(
        quality_model.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.score(docs, turned).toPandas().set_index("doc_id")["score"]
    assert np.allclose(again.loc[found["doc_id"]], found["score"])


def test_quality_edge_rows(edge, edge_rows, make_docs, spark):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (9, 1, None), (None, 1, 0), (10, None, 1), (9, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    scores = quality_model.score(edge, labels).collect()
    assert len(scores) == len(edge_rows) and all(0 <= r.score <= 1 for r in scores)
    empty = {r.score for r in scores if r.doc_id in (3, 4)}
    assert len(empty) == 1
    assert {r.score for r in quality_model.score(edge, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score(make_docs([]), labels).count() == 0


def bits(text):
    return np.array([c == "1" for c in bin(int("1" + text, 16))[3:]])


def test_fingerprints(small, edge, edge_rows, make_docs):
    for docs, rows in ((small[0], small[1]), (edge, [(i, t) for i, t, _ in edge_rows]), (make_docs([(5, "a b", "s")]), [(5, "a b")])):
        rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        got = fingerprints.fingerprint_report(docs).collect()
        assert len(got) == len(rows)
        print_of = {}
        for r in got:
            print_of.setdefault((r.doc_id, r.n_chars), r.fingerprint)
        want = []
        for k, (i, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[1][:half]
            mine, other = print_of[i, len(text)], print_of[after[0], len(after[1])]
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine,
                         float((bits(mine) == bits(other)).mean())))
        found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in got]
        assert sorted(found, key=repr) == sorted(want, key=repr)
        for r in got:
            assert r.near_edited == (bits(r.fingerprint) == bits(r.edited_fingerprint)).mean()
            near = sum((bits(r.fingerprint) != bits(x.fingerprint)).sum() <= fingerprints.RADIUS for x in got) - 1
            assert r.n_near == (near if r.doc_id is not None and r.doc_id % 50 == 0 else None)
    assert fingerprints.fingerprint_report(make_docs([])).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 12, 16])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, (40, 2), dtype=np.int64)
    rows = [tuple(x) for x in base.tolist()]
    for a, b in base.tolist():
        for _ in range(6):
            flips = rng.choice(128, rng.integers(1, radius + 3), replace=False).tolist()
            x = [a & (1 << 64) - 1, b & (1 << 64) - 1]
            for f in flips:
                x[f // 64] ^= 1 << f % 64
            rows.append(tuple(v - (v >> 63 << 64) for v in x))
    prints = spark.createDataFrame(rows, "f0 bigint, f1 bigint")
    got = Counter(tuple(r)[:4] for r in fingerprints.within_radius(prints, prints, radius).collect())
    full = [((a & (1 << 64) - 1) << 64 | b & (1 << 64) - 1, (a, b)) for a, b in set(rows)]
    want = Counter((*p, *q) for x, p in full for y, q in full if (x ^ y).bit_count() <= radius)
    assert got == want


def simhash(text):
    """Votes of all words by a plain loop."""
    import xxhash

    total, votes = 0, np.zeros(128, np.int64)
    for word in re.split("[\x20\x09-\x0d]+", text):
        weight = min(len(word), fingerprints.LONGEST) ** 2
        h0 = xxhash.xxh64(word.encode(), seed=42).intdigest()
        h1 = xxhash.xxh64((1).to_bytes(4, "little"), seed=h0).intdigest()
        total += weight
        votes += weight * np.array([h0 >> i & 1 for i in range(64)] + [h1 >> i & 1 for i in range(64)])
    on = 2 * votes > total
    return "".join(f"{sum(int(x) << i for i, x in enumerate(on[64 * k : 64 * k + 64])):016x}" for k in (0, 1))


def test_fingerprints_are_the_votes_of_all_words(small, edge, edge_rows):
    for docs, rows in ((small[0], small[1]), (edge, [(i, t) for i, t, _ in edge_rows])):
        got = Counter((r.doc_id, r.n_chars, r.fingerprint) for r in fingerprints.fingerprint_report(docs).collect())
        assert got == Counter((i, len(t or ""), simhash(t or "")) for i, t in rows)


def test_recall_on_edited_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    sharing = {}
    for i, found in sets.items():
        for x in found:
            sharing.setdefault(x, []).append(i)
    seen = {p for ids in sharing.values() if len(ids) < 200 for p in combinations(ids, 2)}
    linked = [(a, b) for a, b in seen if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_report(docs).collect()}
    apart = np.array([(bits(prints[a]) != bits(prints[b])).sum() for a, b in linked])
    assert len(linked) >= 20 and (apart <= fingerprints.RADIUS).mean() >= 0.9

