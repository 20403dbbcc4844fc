"""Suffix-array dedup: bytes covered by a string of ``span`` bytes that also starts elsewhere.

Sorting every suffix of a corpus would move it many times over, so suffixes are sorted only
where a repeat is possible and not yet decided:

1. Every window of ``span`` bytes picks the smallest hash of the grams of ``GRAM`` bytes inside it
   (the rightmost of equal ones). Equal windows pick the same gram, so a window whose gram occurs
   once in the corpus is unique. Windows in a row that pick one gram form a stretch.
2. A stretch whose bytes, from its first window's start to its last one's end, occur twice holds
   repeated windows only. Counting stretches decides most of what is left.
3. Other stretches of grams with several different stretches go, one copy each, to the tasks
   that own their grams. There each batch gets its suffix array, its window starts in the order of
   their bytes. It is scanned against every level of the index for matches of the whole span, word
   by word as far as two windows agree, and becomes a level; levels of equal size merge, so a task
   keeps at most the logarithm of its batches. A gram with more than ``HOT`` different stretches
   would fill one task: its windows are dealt out by their own fingerprint instead and counted.

The index compares bytes; the counting before it, and of hot grams, fingerprints of 128 bits. Texts are keyed by content (128 bits), copies are
counted as further places. Matches never cross documents; strings are judged on the input. A
missing text counts as empty; texts shorter than ``span`` bytes lose nothing. Repeated and
missing ids are allowed: every row is judged by its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.llm.arrays import mix, powers
from panelrank.llm.common import map_texts
from panelrank.operators.scale import cut_lineage, top_k_in_group

SPAN = 200
GRAM = 32
# Window starts handled at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
# Different stretches of one gram that a task may own.
HOT = 4096
# Texts with open stretches whose keys may go to all executors.
BROADCAST_ROWS = 200_000
# Stretches that get a suffix array together.
BATCH = 2048

_ORDER = np.uint64((1 << 24) - 1)
_VALUE = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


class Hashes:
    """Fingerprints of any stretch of a byte string, from sums over its prefixes."""

    def __init__(self, data: np.ndarray) -> None:
        self.back = powers(len(data) + 1, -1)
        self.prefix = []
        for value in _VALUE:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(value[data] * powers(len(data)), out=sums[1:])
            self.prefix.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        sums = self.prefix[which]
        return mix((sums[end] - sums[start]) * self.back[start])


def stretches(data: bytes, span: int = SPAN) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, gram, print1, print2) of all stretches of windows that share a gram."""
    gram = min(GRAM, span)
    wide = span - gram + 1
    for first in range(0, max(0, len(data) - span + 1), PIECE):
        piece = np.frombuffer(data, np.uint8)[first : first + PIECE + span - 1]
        n = len(piece) - span + 1
        hashes = Hashes(piece)
        places = np.arange(len(piece) - gram + 1)
        code = hashes.of(places, places + gram, 0)
        # Ordered by hash, then from right to left.
        rank = (code & ~_ORDER) | (_ORDER - places.astype(np.uint64))
        blocks = np.concatenate([rank, np.full(-len(rank) % wide, ~np.uint64(0))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _ORDER
        lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        hi = np.concatenate([lo[1:], [n]])
        picked = (_ORDER - chosen[lo]).astype(np.int64)
        yield (
            lo + first,
            hi - lo,
            code[picked],
            hashes.of(lo, hi + span - 1, 0),
            hashes.of(lo, hi + span - 1, 1),
        )


def all_stretches(data: bytes, span: int) -> tuple[np.ndarray, ...]:
    parts = list(stretches(data, span))
    if not parts:
        empty = np.empty(0, np.uint64)
        return np.empty(0, np.int64), np.empty(0, np.int64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Level:
    """Window starts in the order of their bytes, each window once, and the text they stand in."""

    def __init__(self, data: np.ndarray, where: np.ndarray, ids: np.ndarray) -> None:
        self.data, self.where, self.ids = data, where, ids
        # Every eight bytes as one number that sorts like them; no copy of the text.
        self.words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.head = self.word(where, 0)

    def word(self, where: np.ndarray, depth: int) -> np.ndarray:
        return self.words[where + depth].astype(np.uint64)


class Levels:
    """Suffix arrays of batches, merged geometrically; marks windows that occur twice.

    Windows are compared by their bytes, eight at a time, and only as far as they agree. A level
    holds one window of each content: a further one is marked, marks the one that is there, and
    goes.
    """

    def __init__(self, span: int) -> None:
        if span < 8:
            raise ValueError("windows need eight bytes at least")
        self.span = span
        # Where the words of a window start: the last one may overlap the one before.
        self.depths = [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]
        self.levels: list[Level] = []
        self.repeated: list[np.ndarray] = []
        self.count = 0

    def suffix_array(self, texts: list[bytes], sizes: np.ndarray) -> Level:
        """The first ``sizes`` windows of each text, sorted; what is equal in the batch is marked.

        Sorted by the first word; then, word by word, inside the stretches that still agree.
        """
        data = np.frombuffer(b"".join([*texts, b"\0" * 8]), np.uint8)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        where = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ids = self.count + np.arange(len(where))
        self.count += len(where)
        self.repeated.append(np.zeros(len(where), bool))
        level = Level(data, where, ids)
        order = np.argsort(level.head, kind="stable")
        where, ids, head = where[order], ids[order], level.head[order]
        # first[i]: window i differs from the one before it in what has been compared so far.
        first = np.concatenate([[True], head[1:] != head[:-1]])[: len(where)]
        for depth in self.depths[1:]:
            last = np.concatenate([first[1:], [True]])[: len(where)]
            tied = np.flatnonzero(~(first & last))
            if not len(tied):
                break
            group = np.cumsum(first)[tied]
            key = level.word(where[tied], depth)
            order = np.lexsort((key, group))
            where[tied], ids[tied] = where[tied][order], ids[tied][order]
            group, key = group[order], key[order]
            first[tied[1:]] |= (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        last = np.concatenate([first[1:], [True]])[: len(where)]
        self.mark(ids[~(first & last)])
        return Level(data, where[first], ids[first])

    def mark(self, ids: np.ndarray) -> None:
        if len(self.repeated) > 1:
            self.repeated = [np.concatenate(self.repeated)]
        self.repeated[0][ids] = True

    def places(self, level: Level, new: Level) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of ``new`` belongs in ``level``, and whether its like is there.

        Both are sorted, so a window's like-so-far is a stretch of the level. The stretch is cut
        down word by word until it is empty, which settles the place, or all words agree.
        """
        low = np.searchsorted(level.head, new.head, "left")
        high = np.searchsorted(level.head, new.head, "right")
        open_ = np.flatnonzero(low < high)
        for depth in self.depths[1:]:
            if not len(open_):
                break
            key = new.word(new.where[open_], depth)
            low[open_], high[open_] = (
                self._bound(level, low[open_], high[open_], key, depth, upper) for upper in (False, True)
            )
            open_ = open_[low[open_] < high[open_]]
        there = np.zeros(len(low), bool)
        there[open_] = True
        return low, there

    @staticmethod
    def _bound(level: Level, low, high, key, depth: int, upper: bool) -> np.ndarray:
        """First place from low to high whose word is not below the key (``upper``: is above it)."""
        low, high = low.copy(), high.copy()
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            word = level.word(level.where[middle], depth)
            before = word <= key[live] if upper else word < key[live]
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
        return low

    def scan(self, level: Level, new: Level) -> np.ndarray:
        """Mark what both hold; whether each window of ``new`` is new to the level."""
        place, there = self.places(level, new)
        self.mark(np.concatenate([new.ids[there], level.ids[place[there]]]))
        return ~there

    def merge(self, a: Level, b: Level) -> Level:
        """Two levels without a common window as one, in order."""
        place, _ = self.places(a, b)
        place += np.arange(len(place))
        rest = np.ones(len(a.where) + len(b.where), bool)
        rest[place] = False
        where, ids = (np.empty(len(rest), np.int64) for _ in range(2))
        where[place], where[rest] = b.where + len(a.data), a.where
        ids[place], ids[rest] = b.ids, a.ids
        return Level(np.concatenate([a.data, b.data]), where, ids)

    def add(self, texts: list[bytes], sizes: np.ndarray) -> None:
        new = self.suffix_array(texts, sizes)
        for level in self.levels:
            fresh = self.scan(level, new)
            new = Level(new.data, new.where[fresh], new.ids[fresh])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1].where) >= len(self.levels[-2].where) / 2:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(a, b))

    def marks(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *self.repeated])


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _within_tasks(parts: DataFrame, span: int) -> DataFrame:
    """Repeated windows among the stretches (gram, k1, k2, start, size, data): (k1, k2, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, owners = Levels(span), []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH)
                sizes = rows.column("size").to_numpy()
                index.add(rows.column("data").to_pylist(), sizes)
                owners.append([rows.column(c).to_numpy() for c in ("k1", "k2", "start", "size")])
        if not owners:
            return
        k1, k2, start, size = (np.concatenate(x) for x in zip(*owners))
        marks, ends = index.marks(), np.cumsum(size)
        out = []
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(marks), side="right")):
            for a, b in _runs(marks[ends[i] - size[i] : ends[i]]):
                out.append((k1[i], k2[i], start[i] + a, b - a))
        names = ["k1", "k2", "start", "n"]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return (
        parts.repartition("gram")
        .select("k1", "k2", "start", "size", "data")
        .mapInArrow(run, "k1 long, k2 long, start long, n long")
    )


def _by_window(parts: DataFrame, span: int) -> DataFrame:
    """The same for stretches of grams with very many: one row per window, counted by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = Hashes(np.frombuffer(row["data"], np.uint8))
                place = np.arange(row["size"])
                columns = [
                    _signed(hashes.of(place, place + span, 0)),
                    _signed(hashes.of(place, place + span, 1)),
                    np.full(len(place), row["k1"]),
                    np.full(len(place), row["k2"]),
                    place + row["start"],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["w1", "w2", "k1", "k2", "start"]
                )

    windows = cut_lineage(
        parts.select("k1", "k2", "start", "size", "data")
        .mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, start long")
    )
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return windows.join(cut_lineage(twice), ["w1", "w2"], "left_semi").select(
        "k1", "k2", "start", F.lit(1).cast("long").alias("n")
    )


def _keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        *more,
        text.alias("_text"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
    )


def repeated(keyed: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """(k1, k2, places): for every text with repeated windows, their runs (start, n windows)."""

    def gram_counts(texts, kept):
        grams = [all_stretches((t or "").encode(), span)[2] for t in texts]
        gram, n = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]), return_counts=True)
        return {"gram": _signed(gram), "n": n}

    live = cut_lineage(
        map_texts(keyed, [], "_text", "gram long, n long", gram_counts)
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .select("gram")
    )

    def rows_of(texts, kept):
        out = {n: [] for n in ("gram", "p1", "p2", "k1", "k2", "start", "size")}
        for text, k1, k2 in zip(texts, kept["k1"], kept["k2"]):
            start, size, gram, one, two = all_stretches(text.encode(), span)
            same = np.ones(len(start), np.int64)
            for name, column in zip(
                out, (_signed(gram), _signed(one), _signed(two), same * k1, same * k2, start, size)
            ):
                out[name].append(column)
        return {n: np.concatenate([*v, np.empty(0, np.int64)]) for n, v in out.items()}

    schema = "gram long, p1 long, p2 long, k1 long, k2 long, start long, size long"
    rows = cut_lineage(
        map_texts(keyed, ["k1", "k2"], "_text", schema, rows_of).join(live, "gram", "left_semi")
    )
    place = F.struct("k1", "k2", "start", "size")
    kinds = cut_lineage(
        rows.groupBy("gram", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    )
    whole = (
        rows.join(kinds.filter("n > 1").select("p1", "p2"), ["p1", "p2"], "left_semi")
        .select("k1", "k2", "start", F.col("size").alias("n"))
        .distinct()
    )
    # Grams with a stretch that occurs once beside different ones are still open.
    open_ = cut_lineage(
        kinds.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        .filter("kinds > 1 AND least = 1")
    )
    places = (
        kinds.join(open_, "gram")
        .groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"))
        .agg(
            F.collect_list(
                F.struct("gram", "at.start", "at.size", (F.col("kinds") > hot).alias("hot"))
            ).alias("open")
        )
    )

    def cut(texts, kept):
        out = {n: [] for n in ("gram", "hot", "k1", "k2", "start", "size", "data")}
        for text, k1, k2, wanted in zip(texts, kept["k1"], kept["k2"], kept["open"]):
            data = text.encode()
            for w in wanted:
                a = w["start"]
                out["data"].append(data[a : a + w["size"] + span - 1])
                for name, value in (("k1", k1), ("k2", k2)):
                    out[name].append(value)
                for name in ("gram", "hot", "start", "size"):
                    out[name].append(w[name])
        return out

    places = cut_lineage(places)
    names = places.select("k1", "k2")
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    # One row of each text: further copies would only repeat its stretches.
    owners = top_k_in_group(
        keyed.join(names, ["k1", "k2"], "left_semi"), ["k1", "k2"], ["k1"], 1, "_place"
    )
    parts = cut_lineage(
        map_texts(
            owners.join(places, ["k1", "k2"]),
            ["k1", "k2", "open"],
            "_text",
            "gram long, hot boolean, k1 long, k2 long, start long, size long, data binary",
            cut,
        )
    )
    found = whole.union(_within_tasks(parts.filter("NOT hot"), span)).union(
        _by_window(parts.filter("hot"), span)
    )
    return cut_lineage(
        found.distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "n")).alias("places"))
    )


def removed(places: list[dict], span: int) -> list[tuple[int, int]]:
    """Longest stretches of bytes (start, end) that the runs of windows cover."""
    out: list[list[int]] = []
    for p in sorted((p["start"], p["start"] + p["n"] + span - 1) for p in places or ()):
        if out and p[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p[1])
        else:
            out.append(list(p))
    return [tuple(x) for x in out]


def dedup(
    docs: DataFrame,
    span: int = SPAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = HOT,
) -> DataFrame:
    """For every row: id, n_bytes, removed (array of start and end), kept (remaining bytes)."""
    keyed = _keyed(docs, text_col, F.col(id_col).alias("_id"))
    found = repeated(keyed.select("_text", "k1", "k2"), span, hot)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        out = {id_col: kept["_id"], "n_bytes": [], "removed": [], "kept": []}
        for text, places in zip(texts, kept["places"]):
            data = text.encode()
            gone = removed(places, span)
            edges = [0, *[x for pair in gone for x in pair], len(data)]
            out["n_bytes"].append(len(data))
            out["removed"].append(gone)
            out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return out

    return map_texts(
        keyed.join(found, ["k1", "k2"], "left"),
        ["_id", "places"],
        "_text",
        f"`{id_col}` {id_type}, n_bytes long, removed array<struct<start:long, end:long>>, kept binary",
        work,
    )
