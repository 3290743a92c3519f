"""Divergence between the sources of each language, and the terms that set a source apart.

Terms are runs of letters: everything but the ASCII characters that are none, with A-Z lower-cased. Every language keeps
the V terms in at least ``MIN_DOCUMENTS`` of its documents. A group (language and source), and the language itself, give
a kept term p = 1 + floor(SCALE * (count + 1) / (N + V)), with N the sum of its counts of kept terms. Two distributions
are compared by f = floor((p - q)^2 / q): summed over all kept terms against each other source (part ``pair``), and term
by term against the language for terms more usual in the group (part ``term``, the first ``TOP``).

1. A pipeline of Arrow compute functions per slice of a batch (lower-casing, splitting, dictionary encoding, hash
   grouping) gives partial counts of (language, source, term): occurrences and documents.
2. Spark adds them up, map-side first, so a hot source or term is one row per slice. Kept terms and all totals are exact.
3. Counts meet again in shards of terms, all sources of a term together, with one row per group for its total. A shard
   is a small dense matrix; it gives a sum for each pair and its own first terms. Shards of a language hold as many
   terms as it has sources, and ``SHARD_TERMS`` at least: so the sums of a shard are in proportion to its cells.
4. Sums of shards are added, ranks are given. Arithmetic is in 64-bit integers with long division, so it is exact.

Null text, lang and source count as empty; documents without terms still make their group, with counts of 0. Where a
language keeps no term, all its pairs have value 0. A language with one source has no pairs, and no term above its own
language. Repeated rows and rows with one doc_id are documents of their own. Long texts are processed whole, alone in
their slice. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armlift.llm.shared import broadcast_if_small, save, slices

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
SHARD_TERMS = 1024
SLICE_BYTES = 1 << 22
CELLS = 1 << 20  # of a matrix at a time
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

PARTIAL = "lang string, source string, term string, n bigint, documents bigint"
FOUND = "lang string, source string, part string, item string, value bigint"


def _partial_counts(batches):
    """Counts of (lang, source, term) in slices of (lang, source, text); a row without term names each group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), SLICE_BYTES):
            lang, source, text = (batch.column(i).slice(a, b - a) for i in range(3))
            lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=NO_TERM)
            row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
            filled = pc.not_equal(term, "")  # a text that begins or ends with a separator splits off an empty string
            row, term = row.filter(filled), term.filter(filled).dictionary_encode()
            lang, source = lang.dictionary_encode(), source.dictionary_encode()
            each = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
            group = pa.table({
                "lang": lang.indices.take(each["row"]), "source": source.indices.take(each["row"]), "term": each["term"],
                "n": each["count_all"]}).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
            here = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"]).aggregate([])
            none = pa.nulls(len(here), pa.int64()).fill_null(0)
            out = pa.table({
                "lang": pa.chunked_array([*group["lang"].chunks, *here["lang"].chunks], pa.int32()),
                "source": pa.chunked_array([*group["source"].chunks, *here["source"].chunks], pa.int32()),
                "term": pa.chunked_array([*group["term"].chunks, pa.nulls(len(here), pa.int32())], pa.int32()),
                "n": pa.chunked_array([*group["n_sum"].chunks, none], pa.int64()),
                "documents": pa.chunked_array([*group["n_count"].chunks, none], pa.int64())})
            for k, names in enumerate((lang.dictionary, source.dictionary, term.dictionary)):
                name = out.schema.names[k]
                out = out.set_column(k, name, names.take(out[name].combine_chunks()).cast(pa.string()))
            yield from out.to_batches()


def parts_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division in three steps of a thousand."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shard(table):
    """Pair sums and first terms of one shard. Rows without term carry the total of a group and of its language."""
    import pyarrow as pa
    import pyarrow.compute as pc

    is_group = pc.is_null(table["term"])
    groups, rows = table.filter(is_group), table.filter(pc.invert(is_group))
    lang = groups["lang"][0].as_py()
    names = groups["source"].combine_chunks()
    total, size, all_n = (groups[c].to_numpy() for c in ("n", "terms", "lang_n"))
    terms = rows["term"].combine_chunks().dictionary_encode()
    source = pc.index_in(rows["source"].combine_chunks(), names).to_numpy(zero_copy_only=False)
    code, n, in_lang = terms.indices.to_numpy(), rows["n"].to_numpy(), rows["lang_n"].to_numpy()
    order = np.argsort(code, kind="stable")
    source, code, n, in_lang = source[order], code[order], n[order], in_lang[order]
    sums = np.zeros((len(names), len(names)), np.int64)
    best: list[list[tuple]] = [[] for _ in range(len(names))]
    step = max(1, CELLS // max(1, len(names)))
    for start in range(0, len(terms.dictionary), step):
        width = min(step, len(terms.dictionary) - start)
        lo, hi = np.searchsorted(code, [start, start + width])
        count, in_all = np.zeros((len(names), width), np.int64), np.zeros(width, np.int64)
        count[source[lo:hi], code[lo:hi] - start] = n[lo:hi]
        in_all[code[lo:hi] - start] = in_lang[lo:hi]
        p = parts_of(count, (total + size)[:, None])
        q = parts_of(in_all, all_n[:1] + size[:1])
        for s in range(len(names)):
            sums[s] += distance(p[s], p).sum(axis=1)
            at = np.flatnonzero((count[s] > 0) & (p[s] > q))
            value = distance(p[s][at], q[at])
            if len(at) > TOP:  # those that tie with the last are kept
                high = value >= np.partition(value, -TOP)[-TOP]
                at, value = at[high], value[high]
            best[s] += zip((at + start).tolist(), value.tolist())
    one, other = np.nonzero(~np.eye(len(names), dtype=bool))
    owner = np.repeat(np.arange(len(names)), [len(x) for x in best])
    found = [x for rows_ in best for x in rows_]
    item = terms.dictionary.take(pa.array([c for c, _ in found], pa.int64()))
    text = lambda x: x.cast(pa.string())
    return pa.table({
        "lang": pa.array([lang] * (len(one) + len(owner)), pa.string()),
        "source": pa.concat_arrays([text(names.take(pa.array(one))), text(names.take(pa.array(owner)))]),
        "part": pa.array(["pair"] * len(one) + ["term"] * len(owner), pa.string()),
        "item": pa.concat_arrays([text(names.take(pa.array(other))), text(item)]),
        "value": pa.array(np.r_[sums[one, other], np.array([v for _, v in found], np.int64)])})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents), and one row without term for every group that occurs."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_partial_counts, PARTIAL).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms of each source."""
    counts = save(term_counts(docs), "term-counts")
    term = Window.partitionBy("lang", "term")  # one row per source at most
    kept = save(counts.where("term IS NOT NULL").withColumn("in_documents", F.sum("documents").over(term)).where(
        F.col("in_documents") >= min_documents).select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("head")), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("head").cast("bigint")).alias("heads"))
    group = Window.partitionBy("lang")  # one row per source
    groups = save(counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("heads", F.lit(0)).alias("heads")).select(
        "lang", "source", "n", F.sum("heads").over(group).alias("terms"), F.sum("n").over(group).alias("lang_n"),
        F.count("*").over(group).alias("sources")), "groups")
    shards = F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.col("sources"), F.lit(SHARD_TERMS)))).cast("bigint")
    per_lang = save(groups.groupBy("lang").agg(F.max(shards).alias("shards")), "languages")
    whole = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "lang_n", "terms",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), shards - 1)).alias("shard"))
    cells = kept.join(broadcast_if_small(per_lang, 100_000), "lang").select(
        "lang", "source", "term", "n", "lang_n", F.lit(0).cast("bigint").alias("terms"),
        F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"))
    found = save(whole.unionByName(cells).groupBy("lang", "shard").applyInArrow(_shard, FOUND), "shards")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)


def check_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = f"1 + CAST({SCALE} AS HUGEINT) * (%s + 1) // (%s + terms)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(term) AS terms, coalesce(sum(lang_n), 0) AS all_n
          FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total
           FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
dense AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {p % ("coalesce(c.n, 0)", "t.total")} AS p,
                 {p % ("k.lang_n", "l.all_n")} AS q
          FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang
          LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
          FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
