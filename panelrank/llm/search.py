"""Ranked lexical search: the best documents of every item, by reading impact-sorted lists.

A term weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))``; its impact in a document is that weight
times ``(10^9 tf) div (1000 tf + 8 m)`` with ``m = 10 + (90 n N) div L``. A document's score for an
item is the sum of the impacts of the item's terms, each taken once.

No random access (NRA): a term's list is read in order of falling impact, a block at a time, and
only forwards. For every pair of an item and a document seen so far there are two bounds of the
score: the impacts read, and those plus, for each term of the item not yet seen in the document,
the largest impact that its list still holds. After every block the pairs whose upper bound lies
below the item's k-th lower bound go. An item takes in no further documents once even one that has
not been seen at all would stay below. Reading ends when that holds for all items and the bounds of
all pairs left are equal, so that members, ties and scores are final.

Scale: one pass over the texts gives the postings of the items' terms (nothing is shuffled) and the
counts of all documents. The index is a table with one folder per block, each of its files sorted by
term and falling impact; a block is read once. Borders of blocks come from a histogram of impacts
per term, and blocks grow by a factor, so there are logarithmically many. Pairs are grouped by
(item, document), so neither a frequent term nor a long item meets in one task. The lexicon goes to
the workers in parts of at most ``PART_TERMS`` terms, with a pass over the texts for each; tables
joined as lookups are broadcast only after their rows and bytes have been counted.

Defined results: a missing or empty text has no terms and counts neither in N nor in L; rows of one
item id, a missing one included, are one item with the terms of all; every row of the documents is a
document of its own, repeated rows too, and rows with equal score and id are ordered arbitrarily; an
item without terms, or whose terms occur nowhere, has no rows; further columns do not matter.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale
from panelrank.operators.scale import cut_lineage

# Distinct terms that workers look up at a time.
PART_TERMS = 200_000
# Postings of a term in its first block, and how much longer the lists get with every block.
FIRST, GROWTH = 256, 4
# Steps of the impact histogram per doubling.
STEPS = 16
# Bytes of a text that a worker splits at a time.
PIECE = 4_000_000

# ASCII letters (lower-cased) and digits and all bytes of other characters stand, the rest parts.
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = (text or b"").translate(_KEPT)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE) if start + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (item id, term) of all rows."""
    kind = items.schema[item].dataType
    narrow = items.select(F.col(f"`{item}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("id"), batch.column("text").to_pylist()):
                found = list({t for part in words(data) for t in part})
                keys = pa.array([key.as_py()] * len(found), type=batch.schema.field("id").type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.binary())], ["id", "term"])

    return narrow.mapInArrow(run, f"id {kind.simpleString()}, term binary").distinct()


def postings(docs: DataFrame, key: str, text: str, lexicon: dict[bytes, int]) -> DataFrame:
    """(row, key, n, term, tf) of the lexicon's terms, and a row per document with term -1 and tf n.

    ``docs`` has a column ``row`` that identifies its rows.
    """
    kind = docs.schema[key].dataType
    narrow = docs.select(
        "row", F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.keys()
        for batch in batches:
            place, length, term, tf = [], [], [], []
            texts = batch.column("text")
            for i in range(len(batch)):
                counts: Counter[bytes] = Counter()
                n = 0
                for part in words(texts[i].as_py()):
                    n += len(part)
                    counts.update(part)
                if not n:
                    continue
                found = counts.keys() & known
                place.append(np.full(len(found) + 1, i))
                length.append(np.full(len(found) + 1, n))
                term += [-1, *(lexicon[t] for t in found)]
                tf += [n, *(counts[t] for t in found)]
            if term:
                where = pa.array(np.concatenate(place))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(where),
                        batch.column("key").take(where),
                        pa.array(np.concatenate(length), pa.int64()),
                        pa.array(term, pa.int64()),
                        pa.array(tf, pa.int64()),
                    ],
                    ["row", "key", "n", "term", "tf"],
                )

    return narrow.mapInArrow(
        run, f"row long, key {kind.simpleString()}, n long, term long, tf long"
    )


def _checked(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows and bytes are few."""
    few = scale.fits_one_task(table, scale.BROADCAST_BYTES) and table.count() <= scale.BROADCAST_ROWS
    return F.broadcast(table) if few else table


def _all_postings(docs: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Postings of the whole lexicon, written; the documents' own rows come with its first part."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    if lexicon.count() <= PART_TERMS:
        return cut_lineage(postings(rows, "key", "text", dict(map(tuple, lexicon.collect()))))
    # Every part needs the same row numbers, so they are written with the texts.
    rows, parts, found = cut_lineage(rows), math.ceil(lexicon.count() / PART_TERMS), None
    for part in range(parts):
        terms = lexicon.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        more = postings(rows, "key", "text", dict(map(tuple, terms.collect())))
        more = more if part == 0 else more.filter("term >= 0")
        more = cut_lineage(more)
        found = more if found is None else found.unionByName(more)
    return found


def _impacts(found: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, row, impact) of all postings that count, and what else ``weights`` holds of a term."""
    own = [c for c in weights.columns if c not in ("term", "weight")]
    m = f"(10 + (90 * n * {n_docs}L) div {n_terms}L)"
    return (
        found.filter("term >= 0")
        .join(_checked(weights), "term")
        .select("term", "row", F.expr(f"weight * ((1000000000 * tf) div (1000 * tf + 8 * {m}))").alias("impact"), *own)
        .filter("impact > 0")
    )


def _borders(impacts: DataFrame) -> DataFrame:
    """(term, block, low, top): impacts of each block of a term's list, block 0 read first.

    Blocks are cut between steps of a histogram, which has a bounded number of steps per term.
    """
    step = F.floor(F.log2("impact") * STEPS)
    steps = impacts.groupBy("term", step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("impact").alias("low"), F.max("impact").alias("top")
    )
    before = Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(before), F.lit(0))
    later = 1 + F.floor(F.log(F.greatest(ahead, F.lit(FIRST)) / FIRST) / math.log(GROWTH))
    block = F.when(ahead < FIRST, 0).otherwise(later).cast("int")
    return (
        steps.withColumn("block", block)
        .groupBy("term", "block")
        .agg(F.min("low").alias("low"), F.max("top").alias("top"))
    )


def _index(found: DataFrame, weights: DataFrame, borders: DataFrame, blocks: int, n_docs: int, n_terms: int):
    """The lists as a table (block, term, row, impact), a folder per block, files in reading order."""
    spark = found.sparkSession
    lows = borders.groupBy("term").agg(
        *[F.min(F.when(F.col("block") <= j, F.col("low"))).alias(f"low{j}") for j in range(blocks - 1)],
        F.min("low").alias("least"),
    )
    lists = _impacts(found, cut_lineage(weights.join(lows, "term")), n_docs, n_terms)
    block = F.lit(0)
    for j in range(blocks - 1):
        block = block + (F.col("impact") < F.col(f"low{j}")).cast("int")
    lists = lists.select(block.alias("block"), "term", "row", "impact")
    path = f"{scale.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lists.sortWithinPartitions("block", "term", F.desc("impact")).write.partitionBy("block").parquet(path)
    return spark.read.schema(lists.schema).parquet(path)


def _fronts(terms: DataFrame, borders: DataFrame, block: int) -> DataFrame:
    """Per item, what its lists still hold at most after ``block``, by term number, and the sum."""
    left = borders.filter(F.col("block") > block).groupBy("term").agg(F.max("top").alias("front"))
    rest = terms.join(left, "term", "left").withColumn("front", F.coalesce("front", F.lit(0).cast("long")))
    listed = F.array_sort(F.collect_list(F.struct("no", "front")))
    return rest.groupBy("item").agg(
        F.sum("front").alias("total"), F.transform(listed, lambda x: x["front"]).alias("fronts")
    )


def _bounded(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs that may still be among the best, with the upper bound of their score."""
    covered = F.aggregate("seen", F.lit(0).cast("long"), lambda s, i: s + F.get("fronts", i))
    return (
        pairs.join(_checked(items), "item")
        .withColumn("upper", F.col("lower") + F.col("total") - covered)
        .filter(F.col("upper") >= F.col("least"))
        .select("item", "row", "lower", "seen", "upper", "least")
    )


def _read(index: DataFrame, block: int, terms: DataFrame, items: DataFrame | None, pairs: DataFrame | None) -> DataFrame:
    """The pairs after one more block: (item, row, lower, seen)."""
    new = index.filter(F.col("block") == block).join(terms, "term")
    new = new.select("item", "row", F.col("impact").alias("lower"), F.array("no").alias("seen"))
    if pairs is None:
        merged = new.withColumn("known", F.lit(True))
    else:
        open_ = items.select("item", (F.col("total") >= F.col("least")).alias("known"))
        new = new.join(_checked(open_), "item")
        left, n = pairs.select("item", "row"), pairs.count()
        if n * 64 <= scale.BROADCAST_BYTES and n <= scale.BROADCAST_ROWS:
            held = new.filter("not known").join(F.broadcast(left), ["item", "row"], "left_semi")
            new = new.filter("known").unionByName(held)
        old = pairs.select("item", "row", "lower", "seen", F.lit(True).alias("known"))
        merged = old.unionByName(new)
    return cut_lineage(
        merged.groupBy("item", "row")
        .agg(
            F.sum("lower").alias("lower"),
            F.flatten(F.collect_list("seen")).alias("seen"),
            F.max("known").alias("known"),
        )
        .filter("known")
        .drop("known")
    )


def _kth(pairs: DataFrame, before: DataFrame | None, k: int) -> DataFrame:
    """Per item the least lower bound that a member can have: that of its k-th best pair, or 1.

    Bounds only rise, so pairs below the value before need not be ordered.
    """
    if before is not None:
        pairs = pairs.join(_checked(before), "item").filter(F.col("lower") >= F.col("least")).drop("least")
    best = scale.top_k_in_group(pairs.select("item", "lower"), ["item"], [F.desc("lower")], k)
    found = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("low"))
    return cut_lineage(found.select("item", F.when(F.col("n") >= k, F.col("low")).otherwise(1).alias("least")))


def search(
    items: DataFrame, docs: DataFrame, item: str, key: str, text: str = "text", k: int = 10
) -> DataFrame:
    """The ``k`` best documents of every item: (item, rank, key, score), scores above 0.

    Equal scores are ordered by ascending key, a missing key first.
    """
    spark = docs.sparkSession
    asked = cut_lineage(item_terms(items, item, text))
    numbers = cut_lineage(asked.select("id").distinct().withColumn("item", F.monotonically_increasing_id()))
    lexicon = asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id())
    lexicon = cut_lineage(lexicon)
    ordinal = F.row_number().over(Window.partitionBy("item").orderBy("term")) - 1
    terms = scale.join_groups(asked, numbers, ["id"]).join(lexicon, "term")
    terms = _checked(cut_lineage(terms.select("item", F.col("number").alias("term")).withColumn("no", ordinal)))

    found = _all_postings(docs, key, text, lexicon)
    names = {item: numbers.schema["id"].dataType, key: found.schema["key"].dataType}
    empty = spark.createDataFrame(
        [], f"`{item}` {names[item].simpleString()}, rank int, `{key}` {names[key].simpleString()}, score long"
    )
    n_docs, n_terms = found.filter("term = -1").agg(F.count("row"), F.sum("tf")).first()
    if not n_docs:
        return empty
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.count(F.lit(1)) + 1)))
    weights = found.filter("term >= 0").groupBy("term").agg(weight.alias("weight"))
    weights = cut_lineage(weights)
    borders = cut_lineage(_borders(_impacts(found, weights, n_docs, n_terms)))
    last = borders.agg(F.max("block")).first()[0]
    if last is None:
        return empty
    index = _index(found, weights, borders, last + 1, n_docs, n_terms)

    limits = items_ = pairs = None
    for block in range(last + 1):
        pairs = _read(index, block, terms, items_, pairs)
        limits = _kth(pairs, limits, k) if limits is None else _raised(limits, _kth(pairs, limits, k))
        items_ = _fronts(terms, borders, block).join(limits, "item", "left")
        items_ = cut_lineage(items_.withColumn("least", F.coalesce("least", F.lit(1).cast("long"))))
        pairs = _bounded(pairs, items_)
        wide = pairs.filter("upper > lower").isEmpty()
        if wide and items_.filter("total >= least").isEmpty():
            break
    owners = found.filter("term = -1").select("row", "key")
    named = pairs.select("item", "row", F.col("lower").alias("score")).join(owners, "row")
    order = [F.desc("score"), F.asc_nulls_first("key"), F.asc("row")]
    best = scale.top_k_in_group(named, ["item"], order, k, "rank").join(numbers, "item")
    return best.select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score")


def _raised(before: DataFrame, now: DataFrame) -> DataFrame:
    """The larger of both limits: an item whose pairs all lie below keeps the one it had."""
    both = before.unionByName(now).groupBy("item").agg(F.max("least").alias("least"))
    return cut_lineage(both)
