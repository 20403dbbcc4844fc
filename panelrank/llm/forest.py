"""Approximate nearest neighbours: a forest of hash-prefix trees.

Every vector gets one long bit string per tree (signs of its products with random planes drawn
from a seed); a tree is the sorted array of these strings. A query descends to the longest prefix
it shares with other vectors, and then ascends in all trees at once, one bit a step, until the
vectors below its prefixes, counted over all trees, reach a share of the table. All of those are
candidates: nothing is cut off, so the number only depends on the depth.

Spark range-partitions and sorts the strings; each task reads the sizes of all prefixes off its
sorted array (a prefix that crosses a border is summed from both sides). A query's depth follows
from these sizes. Candidates are scored where they lie: points and queries of one prefix meet in
groups of at most ``CHUNK`` by ``CHUNK``, so a prefix that holds a third of the table is split
over many tasks. Each group returns the best few of each query.

Equal vectors are one point with its smallest ids (further ids could never be among the first k).
Vectors that are missing, empty, zero or have a missing or non-finite component take no part, nor
do rows without an id; vectors of different lengths never meet. Rows that repeat id and vector
count once, and a query never finds its own id. Order: larger inner product (double precision),
then smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.operators.scale import cut_lineage, top_k_in_group

TREES = 24
BITS = 24
# Candidates of a query over all trees, as a share of the table.
SHARE = 1.2
CHUNK = 4096
SEED = 5


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, TREES * BITS))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def points(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """One row per distinct usable vector: (h1, h2, dim, v, ids), ids the k + 1 smallest."""
    v = F.col("v")
    usable = (
        F.col("id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(usable)
    # Both zeros are one number.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    few = top_k_in_group(rows.select("h1", "h2", "id").distinct(), ["h1", "h2"], ["id"], k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.min("v").alias("v"))
    return one.join(ids, ["h1", "h2"]).select("h1", "h2", F.size("v").alias("dim"), "v", "ids")


def _coded(found: DataFrame) -> DataFrame:
    """(h1, h2, dim, codes): the bit string of each tree as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes = np.zeros((len(dims), TREES), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("v").take(pa.array(rows)), dim)
                signs = (x @ _planes(int(dim)) > 0).reshape(-1, TREES, BITS)
                codes[rows] = signs @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), batch.column("dim"), pa.array(list(codes), pa.list_(pa.int64()))],
                names=["h1", "h2", "dim", "codes"],
            )

    return found.select("h1", "h2", "dim", "v").mapInArrow(
        run, "h1 long, h2 long, dim int, codes array<long>"
    )


def _by_tree(coded: DataFrame) -> DataFrame:
    return coded.select("h1", "h2", "dim", F.posexplode("codes").alias("tree", "code"))


def prefix_sizes(coded: DataFrame) -> DataFrame:
    """(dim, tree, depth, prefix, n) from the trees' sorted arrays, without prefixes of one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "tree", "depth", "prefix", "n"]
        for batch in batches:
            dim, tree, code = (batch.column(c).to_numpy() for c in ("dim", "tree", "code"))
            for depth in range(BITS + 1):
                prefix = code >> (BITS - depth)
                new = np.ones(len(code), bool)
                new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1]) | (dim[1:] != dim[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(code)))
                # The first and last may go on in the arrays before and after this one.
                keep = n > 1
                keep[[0, -1]] = True
                first, n = first[keep], n[keep]
                columns = [dim[first], tree[first], np.full(len(first), depth, np.int32), prefix[first], n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    sorted_ = (
        _by_tree(coded)
        .select("dim", "tree", "code")
        .repartitionByRange("dim", "tree", "code")
        .sortWithinPartitions("dim", "tree", "code")
    )
    return (
        sorted_.mapInArrow(run, "dim int, tree int, depth int, prefix long, n long")
        .groupBy("dim", "tree", "depth", "prefix")
        .agg(F.sum("n").alias("n"))
    )


def depths(queries: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """(h1, h2, depth): the deepest level whose prefixes hold ``share`` of the table together."""
    rows = _by_tree(queries).select(
        "h1",
        "h2",
        "dim",
        "tree",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(d).alias("depth"), F.shiftright("code", BITS - d).alias("prefix"))
                    for d in range(BITS + 1)
                ]
            )
        ).alias("p"),
    ).select("h1", "h2", "dim", "tree", "p.*")
    total = (
        rows.join(sizes, ["dim", "tree", "depth", "prefix"], "left")
        .groupBy("h1", "h2", "depth")
        .agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    )
    levels = total.groupBy("h1", "h2").agg(F.collect_list(F.struct("depth", "n")).alias("levels"))
    whole = F.filter("levels", lambda x: x["depth"] == 0)[0]["n"]
    enough = F.filter("levels", lambda x: x["n"] * TREES >= whole * share)
    return levels.select("h1", "h2", F.array_max(F.transform(enough, lambda x: x["depth"])).alias("depth"))


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best points of every query of a group."""
    out = {n: [] for n in ("q1", "q2", "h1", "h2")}
    if left.num_rows and right.num_rows:
        dim = left.column("dim")[0].as_py()
        x, q = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
        p1, p2 = left.column("h1").to_numpy(), left.column("h2").to_numpy()
        least = left.column("least").to_numpy()
        for start in range(0, len(q), 256):
            scores = q[start : start + 256] @ x.T
            for i, row in enumerate(scores):
                best = np.arange(len(row))
                if len(row) > k:
                    limit = np.partition(row, len(row) - k)[len(row) - k]
                    best = np.flatnonzero(row >= limit - 1e-9 * abs(limit))
                best = best[np.lexsort((least[best], -row[best]))][:k]
                out["h1"].append(p1[best])
                out["h2"].append(p2[best])
                for name in ("q1", "q2"):
                    own = right.column("h" + name[1])[start + i].as_py()
                    out[name].append(np.full(len(best), own))
    return pa.table({n: np.concatenate([*v, np.empty(0, np.int64)]) for n, v in out.items()})


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    share: float = SHARE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    chunk: int = CHUNK,
) -> DataFrame:
    """The k nearest found of each id divisible by ``every``: query_id, rank, vec_id, score."""
    found = cut_lineage(points(vectors, id_col, vec_col, k))
    coded = cut_lineage(_coded(found))
    asked = (
        vectors.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v"))
        .filter(F.col("query_id") % every == 0)
        .filter(F.col("v").isNotNull())
        .withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
        .select("query_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), F.col("v")).alias("h2"))
        .distinct()
    )
    asked = cut_lineage(asked.join(found.select("h1", "h2"), ["h1", "h2"], "left_semi"))
    classes = asked.select("h1", "h2").distinct()
    queries = cut_lineage(coded.join(classes, ["h1", "h2"]))
    sizes = cut_lineage(prefix_sizes(coded))
    level = cut_lineage(depths(queries, sizes, share))

    node = ["dim", "tree", "depth", "prefix"]
    # A code's prefixes at the depths in use, at most BITS + 1 numbers.
    used = [r[0] for r in level.select("depth").distinct().collect()]
    at = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("depth"), F.shiftright("code", BITS - d).alias("prefix"))
                for d in sorted(used)
            ]
        ).cast("array<struct<depth:int,prefix:bigint>>")
    ).alias("p")
    placed = _by_tree(coded).select("h1", "h2", "dim", "tree", at).select("h1", "h2", "dim", "tree", "p.*")
    seekers = placed.join(level, ["h1", "h2", "depth"]).select("h1", "h2", *node)
    nodes = seekers.groupBy(*node).agg(F.count(F.lit(1)).alias("nq"))
    nodes = cut_lineage(
        nodes.join(sizes, node, "left").select(
            *node,
            F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int").alias("parts"),
            F.ceil(F.col("nq") / chunk).cast("int").alias("qparts"),
        )
    )
    own = F.abs(F.col("h1") % F.col("parts")).cast("int")
    own_q = F.abs(F.col("h1") % F.col("qparts")).cast("int")
    vector = found.select("h1", "h2", "v", F.col("ids")[0].alias("least"))
    inside = placed.join(nodes, node).join(vector, ["h1", "h2"])
    left = inside.select(
        *node, own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"), "h1", "h2", "v", "least"
    )
    right = cut_lineage(seekers.join(nodes, node).join(vector, ["h1", "h2"]).select(
        *node, own_q.alias("qpart"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "h1", "h2", "v"
    ))
    group = [*node, "part", "qpart"]
    # Products differ in their last bits with the shape of a block: a few more than k + 1 are kept.
    spare = k + 5
    pairs = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInArrow(lambda a, b: _best(a, b, spare), "q1 long, q2 long, h1 long, h2 long")
        .distinct()
    )
    pairs = cut_lineage(pairs)
    candidate = found.select("h1", "h2", F.col("v").alias("y"), "ids")
    query = found.join(classes, ["h1", "h2"], "left_semi").select(
        F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("x")
    )
    products = F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double"))
    scored = (
        pairs.join(candidate, ["h1", "h2"])
        .join(query, ["q1", "q2"])
        .select(
            "q1",
            "q2",
            F.aggregate(products, F.lit(0.0), lambda s, p: s + p).alias("score"),
            F.explode("ids").alias("vec_id"),
        )
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    short = cut_lineage(top_k_in_group(scored, ["q1", "q2"], order, k + 1, "_place").drop("_place"))
    answers = (
        asked.join(short, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
        .filter("query_id <> vec_id")
        .select("query_id", "vec_id", "score")
        .distinct()
    )
    return top_k_in_group(answers, ["query_id"], order, k, "rank").select(
        F.col("query_id").cast("long").alias("query_id"),
        "rank",
        F.col("vec_id").cast("long").alias("vec_id"),
        "score",
    )
