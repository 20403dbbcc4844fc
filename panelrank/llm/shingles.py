"""Near-duplicates by shingles: all pairs of texts with a Jaccard similarity of 0.8 or more.

A text's set holds the distinct runs of ``width`` words (A-Z lower-cased, words between ASCII
blanks; a text of fewer words, but not none, is one run; a text without words has the empty set,
and all such texts are alike). Sets are 64-bit hashes; texts with equal sets share one node.

First the fingerprints of the sets are joined over the trie of ``simhash``, at most ``BITS`` bits apart;
what that links is verified like any other pair. It connects close copies, however many, by one link
each; similarity 0.8 allows for more bits than a trie can open, so the join below finds all others.

Join: all sets are ordered the same way, by how often a shingle's bucket of ``BUCKETS`` occurs in all
documents, rare first, then by hash. Two sets of similarity 0.8 share a shingle among the first
n - ceil(0.8 n) + 1 of each, so only those prefixes are written, and sets meet where a shingle of
both prefixes is the same. The order costs or saves rows, it loses none: any order finds every pair.

Verification, cheapest first: sizes and the places of the shared shingle; then ``CLASSES`` counters
per set, the number of its shingles by hash class: the sum of the smaller ones bounds what two sets
share from above, so only pairs that it cannot rule out move whole sets, and those are compared in
whole numbers. No pair is tested twice.

Hot shingles: linked groups are wanted, not pairs. In the first turn every set is compared with one
of the sets that it shares a shingle with; shingles whose sets are all connected are done. Then those
with more than ``most`` sets left go on like that, for ``PIVOTS`` turns in all; the others wait, and are
not read in these turns. What is left is paired in full, between different groups only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.llm import simhash
from panelrank.llm.arrays import joined, mix, per_text, runs
from panelrank.llm.common import chunks, components, map_texts, ranges, releasing
from panelrank.llm.decontaminate import grams
from panelrank.llm.simhash import keep_first, keyed_rows
from panelrank.operators.scale import cut_lineage

WIDTH = 5
# Similarity of at least SHARE[0] / SHARE[1].
SHARE = (4, 5)
# Bits in which fingerprints that the trie links may differ.
BITS = 3
MOST = 64
PIVOTS = 3
# Counters of all documents' shingles, which set the order; a fixed number, whatever the corpus.
BUCKETS = 1 << 18
# Counters of one set, of one byte each; a full one rules nothing out.
CLASSES = 128
# Characters worked on at a time, few enough to stay in the cache.
IN_CACHE = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.ones(256, dtype=np.uint8)
_WORD[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 0


def shingles(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's shingles."""
    out = []
    for start, end in chunks(texts, IN_CACHE):
        data, bounds = joined([(t or "").encode() for t in texts[start:end]])
        data = _LOWER[data]
        starts, _, hashes = runs(data, _WORD[data])
        places = per_text(starts, bounds)
        for i in range(end - start):
            own = hashes[places[i] : places[i + 1]]
            out.append(np.unique(grams(own, min(width, len(own)))) if len(own) else own)
    return out


def _node(found: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set, 0 for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes())))) if len(found) else 0


def _bucket(found: np.ndarray, buckets: int) -> np.ndarray:
    return (found % np.uint64(buckets)).astype(np.int64)


def _prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first."""
    n = len(found)
    size = n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0
    order = np.lexsort((found, counts[_bucket(found, len(counts))]))
    return found[order[:size]].view(np.int64)


def _classes(found: np.ndarray, classes: int = CLASSES) -> bytes:
    """Number of shingles per class, in the bits above those of the bucket."""
    kind = (found >> np.uint64(40)) % np.uint64(classes)
    counts = np.bincount(kind.astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set, signed: a bit is 1 if more than half of the shingles' hashes have it."""
    ones = np.unpackbits(mix(found).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(np.int64)[0])


def _counts(docs: DataFrame, text_col: str, width: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all documents; every task sends one row per bucket."""
    narrow = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            for start, end in ranges(sizes):
                found = shingles(batch.column(0).slice(start, end - start).to_pylist(), width)
                total += np.bincount(_bucket(np.concatenate(found), buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = narrow.mapInArrow(releasing(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    found = counted.toArrow()  # at most ``buckets`` rows
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _possible(a: str, b: str):
    """Whether sizes and places of the shared shingle allow for the similarity."""
    few, many = SHARE
    rest = F.least(F.col(f"n{a}") - F.col(f"pos{a}"), F.col(f"n{b}") - F.col(f"pos{b}"))
    return (
        F.least(f"n{a}", f"n{b}") * many >= F.greatest(f"n{a}", f"n{b}") * few
    ) & (rest * (few + many) >= (F.col(f"n{a}") + F.col(f"n{b}")) * few)


def _plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) that the counters of their sets do not rule out."""
    few, many = SHARE
    sides = [
        marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}")) for x in "ab"
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1)
                for c in ("ma", "mb")
            )
            least = np.minimum(x, y)
            shared = least.sum(1, dtype=np.int64) + np.where((least == 255).any(1), 1 << 40, 0)
            need = few * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield batch.filter(pa.array(shared * (few + many) >= need)).select(["a", "b"])

    return both.mapInArrow(releasing(run), "a long, b long")


def _verified(pairs: DataFrame, marks: DataFrame, sets) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    few, many = SHARE
    pairs = cut_lineage(_plausible(pairs, marks))
    whole = sets(cut_lineage(pairs.select("a").union(pairs.select("b")).distinct().toDF("node")))
    left = whole.select(F.col("node").alias("a"), F.col("s").alias("x"))
    right = whole.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    near = both * (few + many) >= (F.size("x") + F.size("y")) * few
    return cut_lineage(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"))


def _alike(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of the sets (node, fp) that connect all whose fingerprints the trie links."""
    owners = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(owners, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    near = cut_lineage(simhash.links(owners.select("fp"), bits))
    left = owners.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    right = owners.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    both = same.union(near.join(left, "a").join(right, "b").select("x", "y")).filter("x <> y")
    return cut_lineage(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def links(live: DataFrame, marks: DataFrame, sets, most: int = MOST, alike: DataFrame | None = None) -> DataFrame:
    """(node, root) of every set that is connected to another, from (key, node, n, pos).

    ``marks`` has the size and the counters of every set, (node, n, marks); ``sets`` gives the sets
    of the nodes of a table. ``alike`` has pairs (a, b) to verify before any other.
    """
    spark = live.sparkSession
    tested = spark.createDataFrame([], "a long, b long")
    found = [spark.createDataFrame([], "a long, b long")]
    groups = spark.createDataFrame([], "node long, root long")
    if alike is not None:
        tested = alike
        found.append(_verified(alike, marks, sets))
        if not found[-1].isEmpty():
            groups = cut_lineage(components(found[-1]))

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of keys whose sets are not all connected, with the group of each set."""
        placed = rows.select("key", "node", "n", "pos").join(groups, "node", "left")
        placed = placed.withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("sets")
        )
        return cut_lineage(placed.join(several.filter("low < high").select("key", "sets"), "key"))

    rest = apart(live)
    waiting = rest.limit(0)
    for turn in range(PIVOTS + 1):
        if turn:
            # Roots of rows that wait may be out of date: that costs pairs of connected sets, no link.
            waiting = waiting.union(rest.filter(F.col("sets") <= most))
            rest = rest.filter(F.col("sets") > most)
        last = turn == PIVOTS or rest.isEmpty()
        ours = rest.union(waiting) if last else rest
        if ours.isEmpty():
            break
        side = {
            s: ours.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("node", "root", "n", "pos")])
            for s in "xy"
        }
        if not last:
            first = F.struct(F.xxhash64(F.lit(turn), "nodey").alias("h"), "nodey", "rooty", "ny", "posy")
            side["y"] = side["y"].groupBy("key").agg(F.min(first).alias("p")).select("key", "p.*")
        once = F.col("nodex") < F.col("nodey") if last else F.lit(True)
        pairs = (
            side["x"]
            .join(side["y"], "key")
            .filter((F.col("rootx") != F.col("rooty")) & once & _possible("x", "y"))
            .select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
            .distinct()
        )
        pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        found.append(_verified(pairs, marks, sets))
        if not found[-1].isEmpty():
            groups = cut_lineage(components(reduce(DataFrame.union, found)))
        if last:
            break
        rest = apart(rest)
    return groups


def keep_one(
    docs: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = MOST,
    buckets: int = BUCKETS,
    classes: int = CLASSES,
) -> DataFrame:
    """The rows of ``docs`` with one row of every group of near-duplicates: its smallest id.

    Ties go as in ``simhash.keep_one``.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs, text_col, width, buckets))

    def work(texts, kept):
        found = shingles(texts, width)
        return {
            **kept,
            "node": [_node(s) for s in found],
            "n": [len(s) for s in found],
            "marks": [_classes(s, classes) for s in found],
            "fp": [_fingerprint(s) for s in found],
            "prefix": [_prefix(s, counts.value) for s in found],
        }

    rows = cut_lineage(
        map_texts(
            keyed,
            ["_id", "_h1", "_h2"],
            "_text",
            f"_id {id_type}, _h1 long, _h2 long, node long, n int, marks binary, fp long, prefix array<long>",
            work,
        )
    )
    pieces = rows.select(F.posexplode("prefix").alias("pos", "key"), "node", "n")
    several = (
        pieces.groupBy("key")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter("low < high")
        .select("key")
    )
    live = cut_lineage(
        pieces.join(cut_lineage(several), "key", "left_semi").select("key", "node", "n", "pos").distinct()
    )

    def sets(nodes: DataFrame) -> DataFrame:
        """(node, s): the whole set of each of the nodes, from one of its texts."""
        one = (
            rows.select("node", "_h1", "_h2")
            .join(nodes, "node", "left_semi")
            .groupBy("node")
            .agg(F.min(F.struct("_h1", "_h2")).alias("t"))
            .select("node", "t.*")
        )
        texts = keyed.select("_h1", "_h2", "_text").join(cut_lineage(one), ["_h1", "_h2"])
        whole = map_texts(
            texts,
            ["node"],
            "_text",
            "node long, s array<long>",
            lambda texts, kept: {**kept, "s": [x.view(np.int64) for x in shingles(texts, width)]},
        )
        return cut_lineage(whole.groupBy("node").agg(F.first("s").alias("s")))

    marks = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("marks").alias("marks"))
    alike = _alike(rows.select("node", "fp").distinct())
    groups = links(live, marks, sets, most, alike)
    placed = rows.drop("prefix", "n", "marks", "fp").join(groups, "node", "left")
    return keep_first(keyed, placed.withColumn("root", F.coalesce("root", "node")))
