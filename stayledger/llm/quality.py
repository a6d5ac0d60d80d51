"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network on them.

Every word of the corpus has a context vector: the sum of the fixed sparse random vectors of the words up to ``REACH`` places away, over all
documents. Words are hashed to ``WORD_BUCKETS`` buckets and their shapes (letters, capitals, digits and signs with
repetitions left out, such as ``Aa.``) to ``SHAPE_BUCKETS``, so the table of vectors has one size for any corpus. A document is the mean of the
vectors of its words and of its shapes, their spread, and its length. The network is fitted with numpy on a bounded
sample of labelled rows, and a temperature, fitted on rows left out of that, calibrates its probabilities.

Only rows with crc32(doc_id) mod 5 other than 0 are learned from: 1 to 3 fit the network, 4 the temperature. A score depends on the
text alone. Null and empty texts have the features of no words and are scored like others. Labels that are null, or of
documents that are not there, do not count; of several labels of a document the lowest holds. Without usable labels the score is 0.5
and with one class only it is the smoothed share of that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayledger.llm.batches import bound_batches
from stayledger.llm.tokens import Tokens, mix, range_hash, slices
from stayledger.sources.tables import materialize

WORD_BUCKETS, SHAPE_BUCKETS = 8192, 1024
SIZE, SEEDS, REACH = 32, 4, 2
#: Most labelled documents the network is fitted on: those with the least hash.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
THRESHOLD = 0.3
_BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a"):ord("z") + 1] = _KIND[128:] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ``SEEDS`` entries in the random vector of each bucket."""
    bits = mix(np.arange(1, _BUCKETS * SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_BUCKETS, SEEDS)
    return (bits % np.uint64(SIZE)).astype(np.int64), np.where(bits >> np.uint64(63), 1, -1)


_PLACE, _SIGN = _index_vectors()


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word bucket and shape bucket of each word."""
    tokens = Tokens(texts, lower=True)
    if not len(tokens.begin):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = _KIND[tokens.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[tokens.begin] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    shape = range_hash(kind[keep].astype(np.uint64) + np.uint64(1), before[tokens.begin], before[tokens.end])
    return tokens.text_of(), (tokens.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), \
        (shape % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + WORD_BUCKETS


def context_vectors(docs: DataFrame) -> np.ndarray:
    """One unit vector per bucket, from the contexts of all words of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS * SIZE)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                text, *kinds = buckets(part.column("text"))
                for bucket in kinds:
                    for gap in range(1, REACH + 1):
                        near = text[gap:] == text[:-gap]
                        for one, other in ((bucket[gap:][near], bucket[:-gap][near]), (bucket[:-gap][near], bucket[gap:][near])):
                            cell = one[:, None] * SIZE + _PLACE[other]
                            total += np.bincount(cell.ravel(), weights=_SIGN[other].ravel(), minlength=len(total))
        sums = total.reshape(_BUCKETS, SIZE).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(some), *[pa.array(sums[some, i]) for i in range(SIZE)]],
                              ["bucket", *[f"d{i}" for i in range(SIZE)]])

    columns = [f"d{i}" for i in range(SIZE)]
    sums = docs.select("text").mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    table = np.zeros((_BUCKETS, SIZE), np.float32)
    # At most one row per bucket, a number that no corpus changes.
    rows = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    for row in rows:
        vector = np.array(row[1:], np.float64)
        table[row[0]] = vector / max(1.0, np.sqrt((vector * vector).sum()))
    return table


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its word and shape vectors, lengths of the means, log of the word count."""
    text, *kinds = buckets(texts)
    size = np.bincount(text, minlength=len(texts)).astype(np.float64)
    full = np.flatnonzero(size)
    start = np.cumsum(size[full]).astype(np.int64) - size[full].astype(np.int64)
    out = np.zeros((len(texts), 2 * (2 * SIZE + 1) + 1))
    for i, bucket in enumerate(kinds):
        at = i * (2 * SIZE + 1)
        if len(full):
            vectors = table[bucket]
            mean = np.add.reduceat(vectors, start, axis=0, dtype=np.float64) / size[full, None]
            square = np.add.reduceat(vectors * vectors, start, axis=0, dtype=np.float64) / size[full, None]
            out[full, at:at + SIZE] = mean
            out[full, at + SIZE:at + 2 * SIZE] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[full, at + 2 * SIZE] = np.sqrt((mean * mean).sum(axis=1))
    out[:, -1] = np.log1p(size)
    return out


@dataclass
class Network:
    """Weights of the two layers, the scaling of the features and the temperature."""

    table: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logit(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.scale
        return np.tanh(x @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(pooled(texts, self.table)) / self.temperature, -500, 500)))


def fit_network(features: np.ndarray, labels: np.ndarray, table: np.ndarray, seed: int = 7) -> Network:
    """Gradient descent with momentum and scaling of steps on the log loss."""
    rnd = np.random.default_rng(seed)
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x, y = (features - center) / scale, labels.astype(np.float64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights = [rnd.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rnd.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([np.log(share / (1 - share))])]
    moment, power = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden * hidden)
            slopes = [x[rows].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum(keepdims=True)]
            step += 1
            for i, slope in enumerate(slopes):
                moment[i] = 0.9 * moment[i] + 0.1 * slope
                power[i] = 0.999 * power[i] + 0.001 * slope * slope
                weights[i] = weights[i] - RATE * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(power[i] / (1 - 0.999 ** step)) + 1e-8)
    return Network(table, center, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network, or the constant score where the labels allow no more."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where("doc_id is not null and quality in (0, 1)").where(fold() != 0)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialize(chosen, "quality-sample")
    bound_batches(docs.sparkSession)
    table = context_vectors(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = pooled(part.column("text"), table)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "quality": part.column("quality"),
                                       "features": pa.array([x.tobytes() for x in rows], pa.binary())})

    # The sample has at most ``sample`` rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id") \
        .mapInArrow(describe, "doc_id long, quality int, features binary")
    found = rows.select("doc_id", "quality", "features", (fold() == 4).alias("last")).limit(2 * sample).collect()
    found.sort(key=lambda r: (r.doc_id, r.features))
    if not found:
        return 0.5
    x = np.stack([np.frombuffer(r.features) for r in found])
    y = np.array([r.quality for r in found])
    last = np.array([r.last for r in found])
    if y[~last].min(initial=1) == y[~last].max(initial=0) or not (~last).any():
        return float((y.sum() + 1) / (len(y) + 2))
    network = fit_network(x[~last], y[~last], table)
    if last.any():
        network.temperature = best_temperature(network.logit(x[last]), y[last])
    return network


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows of ``docs``, packed as ``_row``, with ``_score``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                scores = np.full(part.num_rows, model) if isinstance(model, float) else model.score(part.column("_text"))
                yield pa.record_batch([part.column("_row"), pa.array(scores)], ["_row", "_score"])

    bound_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", F.col("_row.text").alias("_text"))
    return packed.mapInArrow(score, packed.select("_row", F.lit(0.0).alias("_score")).schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more."""
    return scored(docs, train(docs, labels, sample)).where(F.col("_score") >= threshold).select("_row.*")
