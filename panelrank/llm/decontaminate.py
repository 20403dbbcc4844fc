"""Benchmark decontamination by winnowing.

Words: A-Z lower-cased, then runs of letters a-z, digits and all signs beyond ASCII. A window is
``span`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Every word of a document inside an occurrence of a window is hit.

Winnowing: hashes of all k-grams of words, and in every run of w = span - k + 1 of them the
smallest (rightmost of equal ones) is a fingerprint. Both texts pick from ``span`` shared words
the same k-gram, so every shared window shares a fingerprint: joining the fingerprints of
documents with those of the items misses none. Each hit is then extended: the windows around it
are hashed whole (two 64-bit hashes) and joined with the items' windows, which decides exactly.
Items shorter than ``span`` are winnowed with a span of their own length.

The items' tables are sent to all executors if they are counted small, else joined by shuffle.
A document's fingerprints are joined against distinct item fingerprints, its windows against
distinct item windows, so a passage that many documents and items share costs each document one
row per place, never one per pair. Texts are keyed by their content (128 bits), so repeated ids
and missing ids do not mix: rows with equal text get equal results. A missing text has no words;
an empty benchmark hits nothing; items with missing text take no part, and items without an id
hit like others but are in no list of ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.llm.arrays import joined, mix, per_text, runs
from panelrank.llm.common import chunks, map_texts
from panelrank.operators.scale import cut_lineage

GRAM = 5
# Rows of two or three numbers; so many of them are a few megabytes.
BROADCAST_ROWS = 200_000
# Characters handled at a time: their arrays fit the processor's cache.
IN_CACHE = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=np.uint8)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start and end."""
    data, bounds = joined([(t or "").encode() for t in texts])
    data = _LOWER[data]
    starts, _, hashes = runs(data, _WORD[data])
    return hashes, per_text(starts, bounds)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, _MIX[seed], np.uint64)
    for i in range(k):
        out = mix(out * _MIX[1 - seed] + hashes[i : i + n])
    return out


def winnow(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints that every ``span`` words have one of."""
    k = min(GRAM, span)
    code = grams(hashes, k)
    wide = span - k + 1
    runs_ = len(code) - wide + 1
    if runs_ <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best, where = code[:runs_].copy(), np.arange(runs_)
    for i in range(1, wide):
        smaller = code[i : i + runs_] <= best
        best[smaller] = code[i : i + runs_][smaller]
        where[smaller] = np.flatnonzero(smaller) + i
    where = np.unique(where)
    return where, code[where]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_key(text: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.col(text)), F.xxhash64(F.lit("second"), F.col(text))]


def _small(df: DataFrame) -> DataFrame:
    """A written table, with the advice to send it to all executors if it is counted small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(
    benchmark: DataFrame, span: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """(span, fp) of all items, distinct; and (h1, h2, item) of all their windows."""

    def work(texts, kept):
        out = {"item": [], "span": [], "fps": [], "h1": [], "h2": []}
        hashes, ranges = words(texts)
        for i, item in enumerate(kept[id_col]):
            own = hashes[ranges[i] : ranges[i + 1]]
            wide = min(span, len(own))
            if not wide:
                continue
            out["item"].append(item)
            out["span"].append(wide)
            out["fps"].append(_signed(winnow(own, wide)[1]))
            out["h1"].append(_signed(grams(own, wide, 0)))
            out["h2"].append(_signed(grams(own, wide, 1)))
        return out

    id_type = benchmark.schema[id_col].dataType.simpleString()
    usable = benchmark.filter(F.col(text_col).isNotNull())
    items = map_texts(
        usable,
        [id_col],
        text_col,
        f"item {id_type}, span int, fps array<long>, h1 array<long>, h2 array<long>",
        work,
    )
    items = cut_lineage(items)
    fps = items.select("span", F.explode("fps").alias("fp")).distinct()
    pair = F.explode(F.arrays_zip("h1", "h2")).alias("w")
    windows = items.select("item", "span", pair).select("span", "w.h1", "w.h2", "item").distinct()
    return cut_lineage(fps), cut_lineage(windows)


def fingerprints(docs: DataFrame, spans: list[int]) -> DataFrame:
    """One row per document: key, number of words, and the fingerprints for every span."""

    def work(texts, kept):
        out = {**kept, "n_words": [], "fps": []}
        for start, end in chunks(texts, IN_CACHE):
            hashes, ranges = words(texts[start:end])
            for i in range(end - start):
                own = hashes[ranges[i] : ranges[i + 1]]
                out["n_words"].append(len(own))
                found = []
                for span in spans:
                    where, code = winnow(own, span)
                    found += zip([span] * len(where), where.tolist(), _signed(code).tolist())
                out["fps"].append(found)
        return out

    return map_texts(
        docs,
        ["k1", "k2"],
        "_text",
        "k1 long, k2 long, n_words long, fps array<struct<span:int, pos:int, fp:long>>",
        work,
    )


def _extended(texts: DataFrame, spans: list[int]) -> DataFrame:
    """Whole windows around each hit: (k1, k2, span, start, h1, h2)."""

    def work(texts, kept):
        out = {n: [] for n in ("k1", "k2", "windows")}
        for start, end in chunks(texts, IN_CACHE):
            hashes, ranges = words(texts[start:end])
            for i in range(start, end):
                own = hashes[ranges[i - start] : ranges[i - start + 1]]
                found = []
                for span in spans:
                    places = np.array(
                        [h["pos"] for h in kept["hits"][i] if h["span"] == span], dtype=np.int64
                    )
                    back = np.arange(span - min(GRAM, span) + 1)
                    starts = np.unique(places[:, None] - back[None, :])
                    starts = starts[(starts >= 0) & (starts <= len(own) - span)]
                    if len(starts):
                        one, two = (_signed(grams(own, span, s)[starts]) for s in (0, 1))
                        found += zip(
                            [span] * len(starts), starts.tolist(), one.tolist(), two.tolist()
                        )
                out["k1"].append(kept["k1"][i])
                out["k2"].append(kept["k2"][i])
                out["windows"].append(found)
        return out

    return (
        map_texts(
            texts,
            ["k1", "k2", "hits"],
            "_text",
            "k1 long, k2 long,"
            " windows array<struct<span:int, start:int, h1:long, h2:long>>",
            work,
        )
        .select("k1", "k2", F.explode("windows").alias("w"))
        .select("k1", "k2", "w.*")
        .distinct()
    )


def _keyed(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    keys = [c.alias(n) for c, n in zip(text_key(text_col), ("k1", "k2"))]
    return docs.select(*more, F.col(text_col).alias("_text"), *keys)


def text_hits(
    keyed: DataFrame, benchmark: DataFrame, span: int, item_id: str, item_text: str
) -> DataFrame:
    """For every different text: (k1, k2, n_words, n_hit, items), written to the shared folder."""
    fps, windows = item_windows(benchmark, span, item_id, item_text)
    # At most ``span`` numbers: the lengths of windows in use.
    spans = sorted(r[0] for r in fps.select("span").distinct().collect())
    found = fingerprints(keyed, spans)
    places = found.select("k1", "k2", "n_words", F.explode_outer("fps").alias("f")).select(
        "k1", "k2", "n_words", "f.*"
    )
    hit = F.col("known")
    rows = cut_lineage(
        places.join(_small(fps.withColumn("known", F.lit(True))), ["span", "fp"], "left")
        .groupBy("k1", "k2")
        .agg(
            F.max("n_words").alias("n_words"),
            F.collect_set(F.when(hit, F.struct("span", "pos"))).alias("hits"),
        )
    )
    suspects = rows.filter(F.size("hits") > 0).select("k1", "k2", "hits")
    around = _extended(keyed.join(cut_lineage(suspects), ["k1", "k2"]), spans)
    known = _small(windows.select("span", "h1", "h2").distinct())
    real = cut_lineage(around.join(known, ["span", "h1", "h2"], "left_semi"))

    items = (
        real.select("k1", "k2", "span", "h1", "h2")
        .distinct()
        .join(_small(windows), ["span", "h1", "h2"])
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    ordered = F.sort_array(F.collect_set(F.struct("start", "span")))
    hits = real.groupBy("k1", "k2").agg(ordered.alias("places"))
    # Words in the union of the stretches: each adds what reaches beyond the ones before it.
    step = lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0), p["start"] + p["span"] - F.greatest(acc["end"], p["start"]))).alias("n"),
        F.greatest(acc["end"], p["start"] + p["span"]).alias("end"),
    )
    total = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return cut_lineage(
        rows.select("k1", "k2", "n_words")
        .join(hits.join(items, ["k1", "k2"]), ["k1", "k2"], "left")
        .select(
            "k1",
            "k2",
            "n_words",
            F.coalesce(total, F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """For every document: id, n_words, n_hit, n_items, items (their ids as sorted text)."""
    keyed = _keyed(docs, text_col, F.col(id_col).alias("_id"))
    found = text_hits(keyed, benchmark, span, item_id, item_text)
    return (
        keyed.drop("_text")
        .join(found, ["k1", "k2"])
        .select(
            F.col("_id").alias(id_col),
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            "items",
        )
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without a single hit, with all their columns."""
    keyed = _keyed(docs, text_col, F.struct("*").alias("_row"))
    found = text_hits(keyed, benchmark, span, item_id, item_text)
    dirty = cut_lineage(found.filter("n_hit > 0").select("k1", "k2"))
    return keyed.drop("_text").join(_small(dirty), ["k1", "k2"], "left_anti").select("_row.*")
