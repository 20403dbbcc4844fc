"""Exact nearest rows by missing-aware Euclidean distance, distributed in bounded blocks.

The distance of two rows is taken over the columns that both hold and scaled up to all columns;
rows without a common column are no neighbours. Points fall into cells around pivots, whose
number grows with the square root of the points. A query only visits cells that can hold one of
its k nearest points (triangle inequality), and cells are cut into blocks of a fixed number of
points and queries, so a cell of any size is shared by many tasks. The triangle inequality needs
whole rows: points with holes share a cell that every query visits, and a query with holes
visits every cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrank.operators import scale
from panelrank.operators.splits import hash_bucket, hash_key, uniform

PIVOTS = 64
MOST_PIVOTS = 4096
HOLES = -1
BLOCK_POINTS = 20_000
BLOCK_QUERIES = 20_000
# Distances that a task holds at a time.
HELD = 1_000_000
ROUNDING = 9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    holes = np.isnan(a).any() or np.isnan(b).any()
    common = np.zeros((len(a), len(b))) if holes else None
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        if holes:
            common += ~np.isnan(gap)
            gap = np.nan_to_num(gap, nan=0.0)
        total += gap * gap
    if holes:
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(common > 0, total * a.shape[1] / common, np.inf)
    return np.sqrt(total)


def _slices(rows: pd.DataFrame, others: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose distances to so many others may be held."""
    step = max(1, HELD // max(others, 1))
    for start in range(0, len(rows), step):
        yield rows.iloc[start : start + step]


def _with_cell(points: DataFrame, cols: Sequence[str], pivots: np.ndarray) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _slices(whole, len(pivots))):
            values = batch[list(cols)].to_numpy(float)
            holes = np.isnan(values).any(1)
            gaps = _distances(np.where(holes[:, None], 0.0, values), pivots)
            cell = gaps.argmin(1)
            gap = np.where(holes, np.inf, gaps[np.arange(len(batch)), cell])
            cell = np.where(holes, HOLES, cell)
            yield batch.assign(_cell=cell.astype("int32"), _gap=gap)

    schema = T.StructType(
        [*points.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())]
    )
    return points.mapInPandas(place, schema)


def nearest_rows(
    queries: DataFrame,
    points: DataFrame,
    cols: Sequence[str],
    k: int,
    key: str,
    point_key: str,
    exclude_same: bool = False,
    pivots: int | None = None,
    block_points: int = BLOCK_POINTS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest points of every query: (key, place, point_key, distance).

    Distances are rounded to nine digits and ties go to the smaller point key. With
    ``exclude_same`` a point with the query's own key does not count. A query gets fewer than
    ``k`` points only if fewer share a column with it. Rows travel with all ``cols``, and a task
    holds ``HELD`` distances at a time, to pivots as to points, however many of them there are.
    """
    cols = list(cols)
    points = points.select(F.col(point_key).alias("_point"), *[F.col(c).cast("double") for c in cols])
    queries = queries.select(F.col(key).alias("_query"), *[F.col(c).cast("double") for c in cols])
    whole = points.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in cols))
    if pivots is None:
        pivots = max(PIVOTS, min(MOST_PIVOTS, math.isqrt(whole.count())))
    chosen = whole.orderBy(hash_key("_point"), "_point").limit(pivots).collect()
    centres = np.array([[r[c] for c in cols] for r in chosen], dtype=float)
    if not chosen:
        if points.isEmpty():
            raise ValueError("no points")
        centres = np.zeros((1, len(cols)))
    placed = _with_cell(points, cols, centres)
    # One row per pivot.
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("r")).collect()
    ids = np.array([c["_cell"] for c in cells])
    sizes = np.array([c["n"] for c in cells])
    radii = np.array([c["r"] for c in cells])
    held = centres[ids]
    need = k + (1 if exclude_same else 0)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _slices(whole, len(held))):
            values = batch[cols].to_numpy(float)
            holes = np.isnan(values).any(1)
            gaps = _distances(np.where(holes[:, None], 0.0, values), held)
            far = gaps + radii
            order = np.argsort(far, axis=1)
            enough = (np.cumsum(sizes[order], axis=1) >= need).argmax(1)
            short = sizes.sum() < need
            bound = np.take_along_axis(far, order, 1)[np.arange(len(batch)), enough]
            if short:
                bound = np.full(len(batch), np.inf)
            bound = np.where(holes, np.inf, bound)
            open_ = gaps - radii <= bound[:, None] + 1e-9
            yield batch.assign(_cells=[ids[row].tolist() for row in open_])

    schema = T.StructType(
        [*queries.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))]
    )
    visiting = queries.mapInPandas(visits, schema).withColumn("_cell", F.explode("_cells")).drop("_cells")
    chunks = {int(c): int(-(-n // block_points)) for c, n in zip(ids, sizes, strict=True)}
    asked = {
        r["_cell"]: int(-(-r["n"] // block_queries))
        for r in visiting.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    pairs = [F.lit(v) for c in chunks for v in (c, chunks[c])]
    n_chunks = F.create_map(*pairs)[F.col("_cell")]
    pairs = [F.lit(v) for c in chunks for v in (c, asked.get(c, 0))]
    n_slices = F.create_map(*pairs)[F.col("_cell")]
    left = (
        visiting.withColumn("_slice", F.pmod(F.xxhash64("_query"), n_slices).cast("int"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    )
    right = (
        placed.drop("_gap")
        .filter(n_slices > 0)
        .withColumn("_chunk", F.pmod(F.xxhash64("_point"), n_chunks).cast("int"))
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), n_slices - 1)))
    )

    def best(asking: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = {"_query": [], "_point": [], "distance": []}
        given = given.sort_values("_point")
        b = given[cols].to_numpy(float)
        names = given["_point"].to_numpy()
        for part in _slices(asking, len(b)):
            if not len(b):
                break
            gaps = np.round(_distances(part[cols].to_numpy(float), b), ROUNDING)
            own = part["_query"].to_numpy()
            if exclude_same:
                gaps[own[:, None] == names[None, :]] = np.inf
            order = np.argsort(gaps, axis=1, kind="stable")[:, :k]
            picked = np.take_along_axis(gaps, order, 1)
            usable = np.isfinite(picked)
            out["_query"].append(np.repeat(own, usable.sum(1)))
            out["_point"].append(names[order[usable]])
            out["distance"].append(picked[usable])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    query_type = queries.schema["_query"].dataType.simpleString()
    point_type = points.schema["_point"].dataType.simpleString()
    block = ["_cell", "_chunk", "_slice"]
    found = (
        left.groupBy(*block)
        .cogroup(right.groupBy(*block))
        .applyInPandas(best, f"_query {query_type}, _point {point_type}, distance double")
    )
    top = scale.top_k_in_group(found, ["_query"], ["distance", "_point"], k, out="place")
    return top.select(
        F.col("_query").alias(key),
        "place",
        F.col("_point").alias("neighbour"),
        "distance",
    )


def knn_predict(
    test: DataFrame,
    train: DataFrame,
    cols: Sequence[str],
    target: str,
    key: str,
    task: str,
    k: int = 5,
    **sizes: int,
) -> DataFrame:
    """Distance-weighted vote or mean of the k nearest training rows (key, prediction).

    A training row at distance 0 outweighs everything else; vote ties go to the smaller label.
    """
    near = nearest_rows(test, train, cols, k, key, key, **sizes)
    values = train.select(F.col(key).alias("neighbour"), F.col(target).alias("_y"))
    # At most k rows per test row from here on.
    whole = Window.partitionBy(key)
    near = near.join(values, "neighbour").withColumn("_closest", F.min("distance").over(whole))
    exact = F.col("distance") == 0
    weight = F.when(F.col("_closest") == 0, exact.cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    near = near.withColumn("_w", weight)
    if task == "regression":
        return near.groupBy(key).agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("prediction"))
    votes = near.groupBy(key, "_y").agg(F.round(F.sum("_w"), ROUNDING).alias("_votes"))
    return scale.top_k_in_group(votes, [key], [F.desc("_votes"), "_y"], 1).select(
        key, F.col("_y").alias("prediction")
    )


def smote(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    seed: int = 42,
    **sizes: int,
) -> DataFrame:
    """Synthetic rows that bring every class up to the largest one.

    Each minority row gets its share of copies; a copy lies at a random point on the line to
    one of the row's k nearest rows of the same class, and equals the row if the class has no
    other. Draws come from hashes of key and copy. Rows without a label take no part.
    """
    counts = {
        r[label]: r["n"]
        for r in df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    if not counts:
        return df.select(key, F.lit(0).alias("copy"), label, *cols).limit(0)
    largest = max(counts.values())
    out = None
    for value, n in sorted(counts.items(), key=lambda e: str(e[0])):
        if n == largest:
            continue
        members = df.filter(F.col(label) == value).select(key, *cols)
        if n == 1:
            copy = F.explode(F.sequence(F.lit(1), F.lit(largest - 1))).alias("copy")
            made = members.select(key, copy, F.lit(value).alias(label), *cols)
            out = made if out is None else out.unionByName(made)
            continue
        near = nearest_rows(members, members, cols, k, key, key, exclude_same=True, **sizes)
        reach = min(k, n - 1)
        whole, part = divmod(largest - n, n)
        copies = F.lit(whole) + (uniform(key, seed=seed) < part / n).cast("int")
        base = (
            members.withColumn("_copies", copies)
            .filter(F.col("_copies") > 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .withColumn("place", hash_bucket(reach, key, "copy", seed=seed) + 1)
            .withColumn("_share", uniform(key, "copy", seed=seed + 1))
        )
        other = members.select(
            F.col(key).alias("neighbour"), *[F.col(c).alias(f"_o_{c}") for c in cols]
        )
        made = (
            base.join(near.select(key, "place", "neighbour"), [key, "place"])
            .join(other, "neighbour")
            .select(
                key,
                "copy",
                F.lit(value).alias(label),
                *[
                    (F.col(c) + F.col("_share") * (F.col(f"_o_{c}") - F.col(c))).alias(c)
                    for c in cols
                ],
            )
        )
        out = made if out is None else out.unionByName(made)
    if out is None:
        return df.select(key, F.lit(0).alias("copy"), label, *cols).limit(0)
    return out
