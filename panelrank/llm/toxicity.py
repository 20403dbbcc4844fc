"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of the byte n-grams inside its lower-cased words, with a blank at either end of
a word. Every n-gram has a vector (hashed into a fixed number of rows); a text's vector is their
average, and a linear softmax turns it into a probability. Vectors and softmax are trained
together in numpy, so a misspelt word shares most of its n-grams, and their vectors, with the
word itself.

Training uses a bounded sample (``rows`` labelled texts of at most ``longest`` bytes, drawn by
a hash of their id). Scoring reads every text whole. A missing, empty or word-free
text has the average vector zero, so its score is the softmax of the biases alone. Without
labelled rows every score is 0.5; with rows of one class only, that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.llm.arrays import joined, mix, sums
from panelrank.llm.common import bounded_sample, chunks, fold_column, map_texts, ranges, releasing

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
# Averages of thousands of n-grams are tiny; the softmax sees them this many times larger.
SCALE = 20.0
# Characters handled at a time: their arrays fit the processor's cache.
IN_CACHE = 50_000

_IN_WORD = np.zeros(256, dtype=np.uint8)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x width
    weights: np.ndarray  # width x 2
    bias: np.ndarray  # 2

    def worth(self) -> np.ndarray:
        """What one n-gram adds to the difference of the two classes' sums."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram, and where each text's n-grams start and end."""
    data, bounds = joined([(t or "").lower().encode() for t in texts])
    inside = _IN_WORD[data]
    # Anything that is no part of a word counts as a blank; the first word needs one before it.
    data = np.concatenate([[32], np.where(inside, data, 32)]).astype(np.uint64)
    inside = np.concatenate([[0], inside])
    words = np.cumsum(inside, dtype=np.int32)
    out, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            out += [(np.empty(0, np.int32), np.zeros(len(bounds), np.int64))] * (n in GRAMS)
            continue
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :]
        if n not in GRAMS:
            continue
        # Blanks may only stand at the ends: the n - 2 bytes between must lie in a word.
        full = words[n - 2 : len(words) - 1] - words[: len(words) - n + 1] == n - 2
        where = np.flatnonzero(full)
        bucket = mix(code[where] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)
        out.append((bucket.astype(np.int32), np.searchsorted(where, bounds)))
    return out


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares of its n-grams."""
    by_n = grams(texts)
    out = []
    for i in range(len(texts)):
        own = np.concatenate([b[r[i] : r[i + 1]] for b, r in by_n])
        found, counts = np.unique(own, return_counts=True)
        out.append((found, (counts / max(1, len(own))).astype(np.float32)))
    return out


def fit(
    texts: list[str | None],
    labels: list[int],
    width: int = 8,
    epochs: int = 12,
    batch: int = 64,
    rate: float = 1.0,
    seed: int = 7,
) -> Model:
    """Adagrad on the softmax loss over vectors, weights and biases together."""
    y = np.asarray(labels, dtype=np.int64)
    random = np.random.default_rng(seed)
    weights = random.normal(0, 1 / np.sqrt(width), (width, 2))
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = np.array([np.log(1 - share), np.log(share)])
    vectors = np.zeros((BUCKETS, width), dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return Model(vectors, weights, bias)
    items: list[tuple[np.ndarray, np.ndarray]] = []
    # Two large arrays instead of many small ones: freed, they go back to the system at once.
    room = sum(min(BUCKETS, len(GRAMS) * (len((t or "").lower().encode()) + 2)) for t in texts)
    held, worth, end = np.empty(room, np.int32), np.empty(room, np.float32), 0
    for start in range(0, len(texts), 100):
        for found, shares in bags(texts[start : start + 100]):
            own = slice(end, end := end + len(found))
            held[own], worth[own] = found, shares
            items.append((held[own], worth[own]))
    vectors += random.uniform(-0.05, 0.05, vectors.shape).astype(np.float32)
    seen = np.full(BUCKETS, 1e-4, dtype=np.float32)
    seen_w, seen_b = np.full_like(weights, 1e-4), np.full_like(bias, 1e-4)
    order = np.arange(len(y))
    for epoch in range(epochs):
        random.shuffle(order)
        step = rate * (1 - epoch / epochs) + 0.02
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            sizes = np.array([len(items[i][0]) for i in rows])
            bucket = np.concatenate([items[i][0] for i in rows])
            share_ = np.concatenate([items[i][1] for i in rows]) * np.float32(SCALE)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            mean = sums(vectors[bucket] * share_[:, None], ends)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = (p @ weights.T).astype(np.float32)
            grad_w, grad_b = mean.T @ p / len(rows), p.mean(0)
            used, slot = np.unique(bucket, return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), sizes)
            grad = np.empty((len(used), width), dtype=np.float32)
            for k in range(width):
                grad[:, k] = np.bincount(slot, back[owner, k] * share_, len(used))
            seen[used] += (grad**2).mean(1)
            vectors[used] -= step * grad / np.sqrt(seen[used])[:, None]
            seen_w += grad_w**2
            weights -= 0.1 * step * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= 0.1 * step * grad_b / np.sqrt(seen_b)
    return Model(vectors, weights, bias)


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int = 8000,
    longest: int = 40_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold: at most ``rows``, each of ``longest`` bytes at most.

    Repeated labels of an id count as their largest, repeated texts as the smallest.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .filter(fold_column(id_col) != 0)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    picked = bounded_sample(known, rows, "_id")
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .filter(F.octet_length("_text") <= longest)
        .join(F.broadcast(picked), "_id")
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .orderBy("_id")
    )
    got = found.select("_text", "_label").toArrow()
    return got.column("_text").to_pylist(), got.column("_label").to_pylist()


def scores(model: Model):
    """The scoring function of a chunk of texts; holds one number per bucket."""
    worth, bias = model.worth(), float(model.bias[1] - model.bias[0])

    def run(texts: list[str | None]) -> np.ndarray:
        mean = np.zeros(len(texts))
        for start, end in chunks(texts, IN_CACHE):
            total = count = 0
            for bucket, ranges in grams(texts[start:end]):
                total = total + sums(worth[bucket], ranges)
                count = count + np.diff(ranges)
            mean[start:end] = total / np.maximum(1, count)
        return 1 / (1 + np.exp(-np.clip(SCALE * mean + bias, -500, 500)))

    return run


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score) for every row; score is the probability of the class 1."""
    id_type = docs.schema[id_col].dataType.simpleString()
    of = scores(model)

    def work(texts, kept):
        return {id_col: kept[id_col], "score": of(texts).tolist()}

    return map_texts(docs, [id_col], text_col, f"`{id_col}` {id_type}, score double", work)


def keep_clean(
    docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with a score under ``least``, with all their columns."""
    of, place = scores(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
            for start, end in ranges(sizes):
                part = batch.slice(start, end - start)
                yield part.filter(pa.array(of(part.column(place).to_pylist()) < least, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
