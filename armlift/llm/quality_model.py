"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every word has two terms, its lower-cased form and its shape (case, digits, last mark, length), hashed into fixed tables.
Each term owns a random index vector of -1, 0 and 1. A term's word vector is the sum of the index vectors of its
neighbours over the fitted sample, scaled to length one. A document's vector is the mean word vector of its whole text,
the mean product of neighbouring index vectors (order: repeated words stand out) and three size measures. The network
has one hidden layer; a held-back part of the sample sets the temperature that calibrates its probabilities.

Fitting uses at most ``SAMPLE`` labelled documents, the first by a hash of doc_id, never those whose
crc32(doc_id) % 5 is 0; scoring covers every row. Labels, lang, source and doc_id enter no score.

Null or empty texts get the score of an empty document. Null labels are not used; a table without labels of both kinds
gives every document the share of label 1 (0.5 without labels). Repeated rows are scored alike; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlift.llm.shared import slices
from armlift.llm.words import Words

SAMPLE = 4000
WORD_TERMS, SHAPE_TERMS, SIZE = 1 << 14, 1 << 12, 48
HIDDEN, EPOCHS, RATE = 24, 60, 0.01
THRESHOLD = 0.3
SLICE_BYTES = 1 << 18
SCORES = "doc_id bigint, text_hash bigint, held_out boolean, score double, predicted int"


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1, 0, 0, 1], np.float32), (WORD_TERMS + SHAPE_TERMS, SIZE))


def terms(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each word's form and shape. ``words`` keep their case; ``hashes`` are of the lower-cased words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, start, end = words.data, words.start, words.end

    def count(low: int, high: int) -> np.ndarray:
        total = np.r_[0, np.cumsum((data >= low) & (data <= high), dtype=np.int64)]
        return total[end] - total[start]

    upper, lower, digit = count(65, 90), count(97, 122), count(48, 57)
    last = data[end - 1].astype(np.int64)
    letter = (last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57)
    case = np.where(upper == 0, 0, np.where(lower == 0, np.minimum(upper, 2), 3))
    shape = ((case * 2 + (digit > 0)) * 16 + np.minimum(end - start, 15)) * 97 + np.where(letter, 0, last % 97)
    return (hashes % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + shape % SHAPE_TERMS


def _grouped_sum(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, rows.shape[1]), np.float32)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(rows, first[:-1][full], axis=0)
    return out


def _words_and_terms(column):
    words = Words(column, lower=False)
    form, shape = terms(words, Words(column).hashes())
    pair = np.ones(max(0, len(form) - 1), bool)  # neighbours of one document
    inner = words.first[1:-1]
    pair[inner[(inner > 0) & (inner < len(form))] - 1] = False
    return words, form, shape, pair


def add_neighbours(total: np.ndarray, column, index: np.ndarray) -> None:
    """Add the neighbours' index vectors of all words of some texts to the rows of their terms."""
    _, form, shape, pair = _words_and_terms(column)
    own = index[form] + index[shape]
    around = np.zeros_like(own)
    around[1:][pair] += own[:-1][pair]
    around[:-1][pair] += own[1:][pair]
    for table in (form, shape):
        order = np.argsort(table, kind="stable")
        rows = table[order]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        if len(heads):
            total[rows[heads]] += np.add.reduceat(around[order], heads, axis=0)


def word_vectors(columns, index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors over all texts, rows scaled to length one."""
    total = np.zeros_like(index)
    for column in columns:
        add_neighbours(total, column, index)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return total / np.maximum(length, 1)


def document_vectors(column, index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    words, form, shape, pair = _words_and_terms(column)
    n = np.diff(words.first).astype(np.float32)
    pooled = _grouped_sum(vectors[form] + vectors[shape], words.first)
    bound = np.zeros((len(form), index.shape[1]), np.float32)
    bound[:-1][pair] = index[form[:-1][pair]] * index[form[1:][pair]]
    ordered = _grouped_sum(bound, words.first)
    per_word = 1 / np.maximum(n, 1)[:, None]
    size = np.diff(words.bounds).astype(np.float32)
    extra = np.stack([np.log1p(n), np.log1p(size), size / np.maximum(n, 1) / 10], axis=1)
    return np.concatenate([pooled * per_word, ordered * per_word, extra], axis=1)


class Network:
    """tanh layer and logistic output on standardised inputs, trained by Adam; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.temperature = 1.0
        x = self._standard(x)
        held = np.arange(len(x)) % 5 == 4
        self.weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                        rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        train_x, train_y = x[~held], y[~held]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(train_x))
            for rows in np.array_split(order, max(1, len(order) // 128)):
                step += 1
                for w, g, m, v in zip(self.weights, self._gradient(train_x[rows], train_y[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit = self._logit(x[held])
            grid = np.geomspace(0.5, 8, 60)
            loss = [np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x):
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    def _gradient(self, x, y):
        a, b, c, d = self.weights
        hidden = np.tanh(x @ a + b)
        error = (1 / (1 + np.exp(-np.clip(hidden @ c + d[0], -30, 30))) - y) / len(x)
        back = error[:, None] * c * (1 - hidden**2)
        return (x.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ error + 1e-4 * c, np.array([error.sum()]))

    def state(self) -> dict:
        """Plain arrays, which any Python process can read."""
        return {"mean": self.mean, "scale": self.scale, "weights": self.weights, "temperature": self.temperature}


def probability(state: dict, x: np.ndarray) -> np.ndarray:
    if "share" in state:
        return np.full(len(x), state["share"])
    a, b, c, d = state["weights"]
    logit = np.tanh(np.clip((x - state["mean"]) / state["scale"], -8, 8) @ a + b) @ c + d[0]
    return 1 / (1 + np.exp(-np.clip(logit / state["temperature"], -30, 30)))


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    """(word vectors, state of the network) from a bounded sample of labelled documents that are not held out."""
    import pyarrow as pa

    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).dropDuplicates(["doc_id"])
    # at most ``sample`` rows of two numbers: safe to broadcast
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    y = found["label"].to_numpy(np.float64)
    # small slices, so that the driver holds the texts and little more
    parts = [pa.array(found["text"].iloc[a:b], pa.large_string())
             for a, b in slices(found["text"].str.len().tolist(), SLICE_BYTES)]
    index = index_vectors()
    vectors = word_vectors(parts, index)
    if len(set(y.tolist())) < 2:
        return vectors, {"share": float(y.mean()) if len(y) else 0.5}
    rows = np.concatenate([document_vectors(part, index, vectors) for part in parts])
    return vectors, Network(rows, y).state()


def _score(batches, model, threshold: float):
    import pyarrow as pa
    import pyarrow.compute as pc

    vectors, state = model.value
    index = index_vectors()
    for batch in batches:
        text = batch.column(3)
        scores = [probability(state, document_vectors(text.slice(a, b - a), index, vectors))
                  for a, b in slices(pc.binary_length(text).to_pylist(), SLICE_BYTES)]
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(score),
             pa.array((score >= threshold).astype(np.int32))], [f.split()[0] for f in SCORES.split(", ")])


def score(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) of every row."""
    # 4 MB whatever the corpus: the tables have fixed sizes
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, sample))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       held_out("doc_id").alias("held_out"), text.alias("text"))
    return rows.mapInArrow(partial(_score, model=model, threshold=threshold), SCORES)
