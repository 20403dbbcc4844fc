"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs of letters and digits or runs of other signs between blanks, in their own case.
Every word (hashed into ``BUCKETS`` rows) has a sparse random index vector; its word vector is the
sum of the index vectors of its neighbours, up to two words away, over all documents. Spark adds
the sums of all partitions, so the word vectors cover the whole corpus, and their table has the
same size for any corpus. A document is the mean and spread of its words' vectors and its length;
a two-layer numpy network scores it, and a temperature fitted on rows kept out of its training
calibrates the probability.

The network learns from a bounded sample (``rows`` labelled documents, drawn by a hash of their
id). A missing, empty or blank text has no words: all its features are zero, which the network
scores like any others. Without labelled rows every score is 0.5; with one class only,
that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.llm.arrays import joined, mix, per_text, runs, sums
from panelrank.llm.common import bounded_sample, chunks, fold_column, map_texts

BUCKETS = 1 << 15
WIDTH = 32
NONZERO = 4
REACH = 2
# Characters handled at a time: their arrays fit the processor's cache.
IN_CACHE = 100_000

_KIND = np.full(256, 2, dtype=np.uint8)  # other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_a) : ord(_b) + 1] = 1
_KIND[128:] = 1

# Index vectors: NONZERO places of WIDTH with a sign each, drawn from the bucket's number.
_DRAW = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
PLACE = (_DRAW % np.uint64(WIDTH)).astype(np.int32)
SIGN = np.where((_DRAW >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int32)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in order, and where each text's words start and end."""
    data, bounds = joined([(t or "").encode() for t in texts])
    starts, _, hashes = runs(data, _KIND[data])
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), per_text(starts, bounds)


def _neighbours(texts: list[str | None], total: np.ndarray) -> None:
    """Add to ``total`` the index vectors of every word's neighbours."""
    flat = total.reshape(-1)
    for start, end in chunks(texts, IN_CACHE):
        bucket, ranges = words(texts[start:end])
        owner = np.repeat(np.arange(end - start), np.diff(ranges))
        for far in range(1, REACH + 1):
            same = owner[far:] == owner[:-far]
            pair = (bucket[:-far] * BUCKETS + bucket[far:])[same]
            pair, times = np.unique(pair, return_counts=True)
            for a, b in ((pair // BUCKETS, pair % BUCKETS), (pair % BUCKETS, pair // BUCKETS)):
                for k in range(NONZERO):
                    np.add.at(flat, a * WIDTH + PLACE[b, k], SIGN[b, k] * times)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors over all texts: BUCKETS x WIDTH, each row of length 1 (or 0).

    One row per bucket and partition is summed by Spark; the result has a fixed size (4 MB).
    """
    names = [f"v{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in chunks(texts):
                _neighbours(texts[start:end], total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(total[used, i]) for i in range(WIDTH)]],
            names=["bucket", *names],
        )

    schema = ", ".join(["bucket long", *[f"{n} long" for n in names]])
    summed = (
        docs.select(F.col(text_col).cast("string"))
        .mapInArrow(run, schema)
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toArrow()
    )
    vectors = np.zeros((BUCKETS, WIDTH))
    if summed.num_rows:
        vectors[summed.column("bucket").to_numpy()] = np.column_stack(
            [summed.column(n).to_numpy() for n in names]
        )
    # Frequent neighbours would drown the rest: their sums grow with the corpus, their logs do not.
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-12)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors, and the logarithm of its number of words."""
    out = np.zeros((len(texts), 2 * WIDTH + 1))
    for start, end in chunks(texts, IN_CACHE):
        bucket, ranges = words(texts[start:end])
        count = np.maximum(1, np.diff(ranges))[:, None]
        rows = vectors[bucket]
        mean = sums(rows, ranges) / count
        square = sums(rows * rows, ranges) / count
        out[start:end, :WIDTH] = mean
        out[start:end, WIDTH:-1] = np.sqrt(np.maximum(square - mean**2, 0))
        out[start:end, -1] = np.log1p(np.diff(ranges))
    return out


@dataclass
class Network:
    centre: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]  # weights and bias of the hidden layer, then of the output
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.spread @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(
    x: np.ndarray,
    labels: list[int],
    hidden: int = 32,
    epochs: int = 60,
    batch: int = 128,
    rate: float = 3e-3,
    decay: float = 1e-4,
    seed: int = 11,
) -> Network:
    """Adam on the logistic loss; every fifth row is kept out and sets the temperature."""
    y = np.asarray(labels, dtype=np.float64)
    width = 2 * WIDTH + 1
    centre = x.mean(0) if len(y) else np.zeros(width)
    spread = np.maximum(x.std(0), 1e-6) if len(y) else np.ones(width)
    random = np.random.default_rng(seed)
    layers = [
        random.normal(0, 1 / np.sqrt(width), (width, hidden)),
        np.zeros(hidden),
        random.normal(0, 1 / np.sqrt(hidden), hidden),
        np.zeros(1),
    ]
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(centre, spread, layers, 1.0)
    if not 0 < y.sum() < len(y):
        layers[2][:] = 0
        layers[3][:] = np.log(share / (1 - share))
        return net
    scaled = (x - centre) / spread
    kept_out = np.arange(len(y)) % 5 == 0
    order = np.flatnonzero(~kept_out)
    first = [np.zeros_like(p) for p in layers]
    second = [np.zeros_like(p) for p in layers]
    step = 0
    for epoch in range(epochs):
        random.shuffle(order)
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            inner = np.tanh(scaled[rows] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(inner @ layers[2] + layers[3], -500, 500)))
            error = (p - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - inner**2)
            grads = [
                scaled[rows].T @ back + decay * layers[0],
                back.sum(0),
                inner.T @ error + decay * layers[2],
                np.array([error.sum()]),
            ]
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for p_, g, m, v in zip(layers, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g**2
                p_ -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits, truth = net.logits(x[kept_out]), y[kept_out]
    grid = np.geomspace(0.25, 8, 61)
    losses = [
        np.mean(np.logaddexp(0, logits / t) - truth * logits / t) if len(truth) else 0.0 for t in grid
    ]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    vectors: np.ndarray,
    rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[np.ndarray, list[int]]:
    """Features and labels of at most ``rows`` labelled documents outside the held-out fold.

    Repeated labels of an id count as their largest; repeated documents as one of their texts.
    Only features, a few hundred bytes a row, reach the driver.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .filter(fold_column(id_col) != 0)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    picked = bounded_sample(known, rows, "_id")
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), "_id"
    )

    def work(texts, kept):
        return {"_id": kept["_id"], "_label": kept["_label"], "x": list(pooled(texts, vectors))}

    id_type = docs.schema[id_col].dataType.simpleString()
    got = (
        map_texts(found, ["_id", "_label"], "_text", f"_id {id_type}, _label int, x array<double>", work)
        .groupBy("_id", "_label")
        .agg(F.min("x").alias("x"))
        .orderBy(F.xxhash64("_id"), "_id")
        .select("x", "_label")
        .toArrow()
    )
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, 2 * WIDTH + 1)
    return x, got.column("_label").to_pylist()


def score(
    docs: DataFrame,
    vectors: np.ndarray,
    net: Network,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score) for every row; score is the calibrated probability of the class 1."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        return {id_col: kept[id_col], "score": net.probability(pooled(texts, vectors)).tolist()}

    return map_texts(docs, [id_col], text_col, f"`{id_col}` {id_type}, score double", work)
