"""SimHash near-duplicates: 64-bit fingerprints joined with themselves over a binary trie.

Fingerprint: A-Z lower-cased, words between ASCII blanks, shingles of ``width`` words (a shorter
text is one shingle, a text without words has fingerprint zero), each shingle hashed with XXH64
(seed 42); a bit is 1 if more than half of the hashes have it.

Join: distinct fingerprints form a binary trie. Starting with the pair (root, root), pairs of
nodes are opened together; the bits in which the two prefixes differ add up, and a pair that
exceeds the budget is dropped with everything below it. Large nodes are opened by Spark, four
levels a step, one row per pair of nodes; a pair whose nodes both hold at most ``LEAVES``
fingerprints becomes one group, and the rest of its traversal runs in that group's task. A group
returns each linked fingerprint with the smallest one it is connected to, not all pairs, and
connected groups are then found over those links.

Rows: missing and empty texts have fingerprint zero and are linked like any other. Copies share
a fingerprint, so any number of copies is one leaf. Repeated ids and missing ids are allowed; a
group's name is its smallest id that is not missing, missing if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.llm.common import components, map_texts
from panelrank.operators.scale import cut_lineage, top_k_in_group

SEED = 42
LEAVES = 16_384
OPEN_BITS = 4
# Pairs of nodes that a task opens at a time.
BLOCK = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, dtype=np.int64), 0
    while True:
        some = np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(50_000))), np.uint64)
        if not len(some):
            break
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit number."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        unsigned = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return {id_col: kept[id_col], "fp": unsigned.view(np.int64).tolist()}

    return map_texts(docs, [id_col], text_col, f"`{id_col}` {id_type}, fp long", work)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _paired(fps: DataFrame, budget: int, most: int) -> Iterator[tuple[int, DataFrame]]:
    """Depths with their pairs of nodes (a, b, bits) that hold at most ``most`` leaves each."""
    depth = 0
    total = fps.count()
    pairs = fps.sparkSession.createDataFrame(
        [(0, 0, 0, total, total)], "a long, b long, bits int, na long, nb long"
    )
    while True:
        large = F.greatest("na", "nb") > most
        last = depth == 64 or pairs.filter(large).isEmpty()
        done = pairs if last else pairs.filter(~large)
        if not done.isEmpty():
            yield depth, done.select("a", "b", "bits")
        if last:
            return
        depth += OPEN_BITS
        nodes = fps.groupBy(_prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", OPEN_BITS))
        left = nodes.select(F.col("parent").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
        right = nodes.select(F.col("parent").alias("b"), F.col("node").alias("cb"), F.col("n").alias("nb"))
        apart = F.col("bits") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(15))
        pairs = cut_lineage(
            pairs.filter(large)
            .select("a", "b", "bits")
            .join(left, "a")
            .join(right, "b")
            .filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"), apart.cast("int").alias("bits"), "na", "nb")
            .filter(F.col("bits") <= budget)
        )


def _levels(sorted_fps: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trie of sorted fingerprints below ``depth``, two bits a level.

    Each level: the prefixes in order, and where each prefix of the level above starts in it.
    """
    out = [(np.zeros(1, np.uint64), np.array([0, 1]))]
    upper = np.zeros(len(sorted_fps), dtype=np.int64)
    for level in range(depth + 2, 65, 2):
        prefix = sorted_fps >> np.uint64(64 - level)
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        index = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        owner = upper[first]
        starts = np.searchsorted(owner, np.arange(upper[-1] + 2))
        out.append((prefix[first], starts))
        upper = index
    return out


def joined(a: np.ndarray, b: np.ndarray | None, depth: int, bits: int, budget: int):
    """Linked index pairs of two sorted fingerprint arrays under one pair of nodes, in blocks.

    ``b`` None joins ``a`` with itself. Opens pairs of nodes level by level and drops those
    whose differing bits exceed the budget.
    """
    own = b is None
    tree_a = _levels(a, depth)
    tree_b = tree_a if own else _levels(b, depth)
    todo = [(1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, bits, np.uint8))]
    while todo:
        level, i, j, err = todo.pop()
        if level == len(tree_a):
            yield (i[i != j], j[i != j]) if own else (i, j)
            continue
        if len(i) > BLOCK:
            todo += [
                (level, i[s : s + BLOCK], j[s : s + BLOCK], err[s : s + BLOCK])
                for s in range(0, len(i), BLOCK)
            ]
            continue
        (pa_, sa), (pb, sb) = tree_a[level], tree_b[level]
        na, nb = sa[i + 1] - sa[i], sb[j + 1] - sb[j]
        times = na * nb
        pair = np.repeat(np.arange(len(i)), times)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        ci, cj = sa[i][pair] + place // nb[pair], sb[j][pair] + place % nb[pair]
        apart = err[pair] + np.bitwise_count((pa_[ci] ^ pb[cj]) & np.uint64(3))
        near = apart <= budget
        if own:
            near &= ci <= cj
        todo.append((level + 1, ci[near], cj[near], apart[near]))


def _smallest(n: int, blocks) -> np.ndarray:
    """For each of n items the smallest item it is connected to by the given index pairs."""
    label = np.arange(n)
    for i, j in blocks:
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _group_links(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    depth, bits = int(rows["depth"].iloc[0]), int(rows["bits"].iloc[0])
    fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
    side = rows["side"].to_numpy()
    a, b = np.sort(fps[side == 0]), np.sort(fps[side == 1])
    own = not len(b)
    blocks = joined(a, None if own else b, depth, bits, budget)
    if not own:
        blocks = ((i, j + len(a)) for i, j in blocks)
    everything = np.concatenate([a, b])
    label = _smallest(len(everything), blocks)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame(
        {"a": everything[label[linked]].view(np.int64), "b": everything[linked].view(np.int64)}
    )


def links(fps: DataFrame, budget: int = 2, most: int = LEAVES) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``budget`` bits apart.

    Not every linked pair is listed: within a group of the traversal each connected fingerprint
    names one other, which keeps the output linear in the input and connects the same sets.
    """
    members = []
    for depth, pairs in _paired(fps, budget, most):
        if depth == 0:  # all fingerprints fit one group
            root = [F.lit(0).cast("long").alias(c) for c in "ab"]
            numbers = [F.lit(0).alias(c) for c in ("depth", "bits", "side")]
            members.append(fps.select("fp", *root, *numbers))
            continue
        placed = fps.withColumn("node", _prefix(depth))
        keyed = pairs.withColumn("depth", F.lit(depth))
        for side, name, joined_ in ((0, "a", keyed), (1, "b", keyed.filter("a <> b"))):
            found = placed.join(joined_, F.col("node") == F.col(name))
            members.append(found.withColumn("side", F.lit(side)).drop("node"))
    rows = members[0]
    for more in members[1:]:
        rows = rows.unionByName(more)
    return (
        rows.select("depth", "a", "b", "bits", "side", "fp")
        .groupBy("depth", "a", "b")
        .applyInPandas(lambda group: _group_links(group, budget), "a long, b long")
    )


def classes(
    docs: DataFrame,
    budget: int = 2,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = LEAVES,
) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable."""
    rows = cut_lineage(fingerprints(docs, width, id_col, text_col))
    return _with_component(rows, budget, id_col, most)


def _with_component(rows: DataFrame, budget: int, id_col: str, most: int) -> DataFrame:
    owners = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("_least")))
    found = components(links(owners.select("fp"), budget, most))
    rooted = owners.join(found, owners["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_least"
    )
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id", "root"))
    others = [c for c in rows.columns if c not in (id_col, "fp")]
    return rows.join(named, "fp").select(id_col, "fp", "component_id", "root", *others)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _text, _h1, _h2): the hashes stand for the text."""
    return docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.xxhash64(F.col(text_col)).alias("_h1"),
        F.xxhash64(F.lit("second"), F.col(text_col)).alias("_h2"),
    )


def keep_first(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that stay: of (_id, _h1, _h2, root) the first of every root."""
    first = rows.groupBy("root").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h1", "_h2")).alias("_first")
    )
    stay = cut_lineage(
        first.select(
            F.col("_first._id").alias("_a"),
            F.col("_first._h1").alias("_b"),
            F.col("_first._h2").alias("_c"),
        )
    )
    same = (
        F.col("_id").eqNullSafe(F.col("_a"))
        & (F.col("_h1") == F.col("_b"))
        & (F.col("_h2") == F.col("_c"))
    )
    kept = keyed.drop("_text").join(stay, same, "left_semi")
    return top_k_in_group(kept, ["_id", "_h1", "_h2"], ["_h1"], 1, "_place").select("_row.*")


def keep_one(
    docs: DataFrame,
    budget: int = 2,
    width: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = LEAVES,
) -> DataFrame:
    """The rows of ``docs`` with one row of every group of near-duplicates: its smallest id.

    Ties go to the smallest hash of the text; of wholly equal rows one stays. Only ids, hashes
    and fingerprints are grouped; texts move once, to meet the list of rows that stay.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        unsigned = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return {**kept, "fp": unsigned.view(np.int64).tolist()}

    rows = map_texts(
        keyed, ["_id", "_h1", "_h2"], "_text", f"_id {id_type}, _h1 long, _h2 long, fp long", work
    )
    rows = _with_component(cut_lineage(rows), budget, "_id", most)
    return keep_first(keyed, rows)
