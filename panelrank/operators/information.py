"""Mutual information of continuous columns by nearest neighbours.

For every row, e is the distance to the k-th nearest other row in (column, target), the larger of
both differences, each in units of its spread. With nx and ny the other rows whose column, or whose
target, differs by less than e (by nothing, where e is 0), the information is
digamma(k) + digamma(n) - mean(digamma(nx + 1) + digamma(ny + 1)), and never below 0.

Scale: the plane of each column is cut into strips of rows with consecutive x, about as many as each
strip then has cells of ``CELL`` points with consecutive y, so cells are as wide as they are high in
points. Each cell gives its points their k nearest inside, which bounds e from above; a point goes on
only to the cells that this distance reaches (its border neighbours), and the k smallest of all it
met are the nearest. All rows of one x lie in one strip, however many, since strips are only walked
by cell; equal points stop at distance 0. Strips and cells that a distance reaches, and the counts nx
and ny, are read from running counts in range slices (``scale.running_total``), so no row is compared
with all others. A target value that a large share of a strip holds makes its points look at the
boxes of all of the strip's cells with that value.

Rows without the column or the target take no part in that column; a column with k or fewer rows
left has no value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import profile, scale

# Points of a cell.
CELL = 1024
# Points compared with a cell at a time.
TILE = 256


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: six steps up, then the series."""
    up, shift = n + 6, F.lit(0.0)
    for j in range(6):
        shift = shift + 1 / (n + j)
    return F.ln(up) - 1 / (2 * up) - 1 / (12 * up**2) + 1 / (120 * up**4) - 1 / (252 * up**6) - shift


def points(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(column, row, n, x, y) of all rows with both values, in units of each one's spread.

    Nine digits count, so that equal differences stay equal.
    """
    rows = scale.cut_lineage(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(target).cast("double").alias("y"),
            *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)],
        ).filter("y IS NOT NULL")
    )
    names = {f"c{i}": c for i, c in enumerate(cols)}
    long = profile.unpivot(rows, list(names), ["row", "y"]).filter("value IS NOT NULL")
    spreads = long.groupBy("column").agg(
        F.stddev_pop("value").alias("sx"), F.stddev_pop("y").alias("sy"), F.count(F.lit(1)).alias("n")
    )
    unit = {s: F.when(F.col(s) > 0, F.col(s)).otherwise(1.0) for s in ("sx", "sy")}
    named = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[F.col("column")]
    return long.join(F.broadcast(spreads), "column").select(  # one row per column
        named.alias("column"),
        "row",
        "n",
        F.round(F.col("value") / unit["sx"], 9).alias("x"),
        F.round(F.col("y") / unit["sy"], 9).alias("y"),
    )


def celled(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``strip`` and ``cell``, written; cells count from 0 in every strip."""
    copies = rows.groupBy("column", "n", "x").agg(F.count(F.lit(1)).alias("copies"))
    ahead = scale.running_total(copies, ["column"], ["x"], F.col("copies"), "ahead", limit=0)
    strip = F.floor(F.col("ahead") / F.ceil(F.sqrt(F.col("n") * CELL)))
    strips = ahead.select("column", "x", strip.alias("strip"))
    rows = scale.join_lookup(rows, strips, ["column", "x"], "inner")
    one = F.lit(1).cast("long")
    placed = scale.running_total(rows, ["column", "strip"], ["y", "x", "row"], one, "place", limit=0)
    return scale.cut_lineage(placed.withColumn("cell", F.floor(F.col("place") / CELL)).drop("place"))


def _smallest(own: np.ndarray, held: np.ndarray, k: int, same: np.ndarray | None) -> np.ndarray:
    """The k smallest distances from every own point to the held ones, its own row left out."""
    out = np.full((len(own), k), np.inf)
    for start in range(0, len(own), TILE):
        part = own[start : start + TILE]
        far = np.maximum(
            np.abs(part[:, None, 0] - held[None, :, 0]), np.abs(part[:, None, 1] - held[None, :, 1])
        )
        if same is not None:
            far[np.arange(len(part)), same[start : start + TILE]] = np.inf
        take = min(k, far.shape[1])
        out[start : start + TILE, :take] = np.sort(np.partition(far, take - 1, axis=1)[:, :take], axis=1)
    return out


def _lists(rows: np.ndarray, index: pd.Index) -> pd.Series:
    return pd.Series(list(rows), index=index, dtype=object)


def neighbour_distance(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (column, row, x, y, strip, cell) with ``e``, the distance to the k-th nearest other row."""
    keys = ["column", "strip", "cell"]

    def inside(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[["x", "y"]].to_numpy(float)
        near = _smallest(own, own, k, np.arange(len(own)))
        return frame[["column", "row", "x", "y", "strip", "cell"]].assign(near=_lists(near, frame.index))

    schema = "column string, row long, x double, y double, strip long, cell long, near array<double>"
    local = scale.cut_lineage(rows.groupBy(*keys).applyInPandas(inside, schema))
    reach = F.element_at("near", -1)
    asked = local.filter(reach > 0).withColumn("e", reach).drop("near")
    met = _reached(scale.cut_lineage(asked), rows)

    def outside(key, guests: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        near = _smallest(guests[["x", "y"]].to_numpy(float), frame[["x", "y"]].to_numpy(float), k, None)
        return guests[["column", "row"]].assign(near=_lists(near, guests.index))

    further = (
        met.groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInPandas(outside, "column string, row long, near array<double>")
    )
    every = local.select("column", "row", "near").unionByName(further)
    best = every.groupBy("column", "row").agg(F.flatten(F.collect_list("near")).alias("near"))
    nearest = F.element_at(F.array_sort("near"), k)
    return rows.join(best.select("column", "row", nearest.alias("e")), ["column", "row"])


def _spans(asked: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """(group..., row, number) of the marks that each interval [low, high] of ``asked`` meets.

    ``marks``: (group..., number, begin, end), numbered from 0 in a group, begins and ends ascending.
    Those that end before ``low`` are not met; of the others, those that begin by ``high`` are.
    """

    def counted(at: str, end: str, queries_first: bool, out: str) -> DataFrame:
        rows = asked.select(*group, "row", F.col(at).alias("at"), F.lit(0 if queries_first else 2).alias("turn"))
        steps = marks.select(*group, F.col("number").alias("row"), F.col(end).alias("at"), F.lit(1).alias("turn"))
        every = rows.unionByName(steps)
        weight = (F.col("turn") == 1).cast("long")
        found = scale.running_total(every, group, ["at", "turn", "row"], weight, out, limit=0)
        return found.filter("turn <> 1").select(*group, "row", out)

    first = counted("low", "end", True, "first")
    both = first.join(counted("high", "begin", False, "last"), [*group, "row"]).filter("first < last")
    return both.select(*group, "row", F.explode(F.sequence("first", F.col("last") - 1)).alias("number"))


def _reached(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Every point (column, row, x, y) with each other (strip, cell) whose box its distance reaches."""
    ends = [f(c).alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max))]
    boxes = scale.cut_lineage(rows.groupBy("column", "strip", "cell").agg(*ends))
    strips = boxes.groupBy("column", "strip").agg(F.min("x0").alias("begin"), F.max("x1").alias("end"))
    # One row per strip: their number grows with the square root of the rows.
    order = Window.partitionBy("column").orderBy("strip")
    numbered = F.row_number().over(order).cast("long") - 1
    strips = scale.cut_lineage(strips.withColumn("number", numbered))
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    spans = asked.select("column", "row", (x - e).alias("low"), (x + e).alias("high"))
    at = _spans(spans, strips, ["column"]).join(strips.select("column", "number", "strip"), ["column", "number"])
    own = asked.withColumnsRenamed({"strip": "own_strip", "cell": "own_cell"})
    placed = scale.cut_lineage(at.drop("number").join(own, ["column", "row"]))
    spans = placed.select("column", "strip", "row", (y - e).alias("low"), (y + e).alias("high"))
    cells = boxes.select("column", "strip", F.col("cell").alias("number"), F.col("y0").alias("begin"), F.col("y1").alias("end"))
    met = _spans(spans, cells, ["column", "strip"]).withColumnRenamed("number", "cell")
    met = met.join(placed, ["column", "strip", "row"]).filter("strip <> own_strip OR cell <> own_cell")
    wide = boxes.select("column", "strip", "cell", "x0", "x1")
    met = met.join(wide, ["column", "strip", "cell"]).filter((x + e >= F.col("x0")) & (x - e <= F.col("x1")))
    return met.select("column", "row", "x", "y", "strip", "cell")


def _within(rows: DataFrame, axis: str) -> DataFrame:
    """(column, row, n): other rows whose ``axis`` differs by less than e, by nothing where e is 0."""
    value, e = F.col(axis), F.col("e")
    marks = rows.select("column", "row", value.alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sign"))
    # Strictly inside: rows up to x - e are below, rows from x + e on are not counted.
    below = rows.select(
        "column", "row", (value - e).alias("at"), F.when(e > 0, 2).otherwise(0).alias("turn"), F.lit(-1).alias("sign")
    )
    upto = rows.select(
        "column", "row", (value + e).alias("at"), F.when(e > 0, 0).otherwise(2).alias("turn"), F.lit(1).alias("sign")
    )
    every = marks.unionByName(below).unionByName(upto)
    counted = scale.running_total(
        every, ["column"], ["at", "turn", "row", "sign"], (F.col("sign") == 0).cast("long"), "n", limit=0
    )
    inside = counted.filter("sign <> 0").groupBy("column", "row").agg(F.sum(F.col("n") * F.col("sign")).alias("n"))
    return inside.select("column", "row", (F.col("n") - 1).alias(f"n{axis}"))


def neighbour_information(df: DataFrame, cols: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """(column, n, mutual_information) in nats of every column with the target."""
    rows = celled(points(df, cols, target))
    with_e = scale.cut_lineage(
        neighbour_distance(rows.filter(F.col("n") > k), k).select("column", "row", "x", "y", "n", "e")
    )
    counts = _within(with_e, "x").join(_within(with_e, "y"), ["column", "row"])
    # Rounding of x - e and x + e can lose the row itself.
    terms = counts.select(
        "column",
        (digamma(F.greatest("nx", F.lit(0)) + 1) + digamma(F.greatest("ny", F.lit(0)) + 1)).alias("t"),
    )
    sums = terms.groupBy("column").agg(F.avg("t").alias("t"), F.count(F.lit(1)).alias("n"))
    value = digamma(F.lit(k)) + digamma(F.col("n")) - F.col("t")
    found = sums.select("column", "n", F.greatest(value, F.lit(0.0)).alias("mutual_information"))
    sizes = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(found.drop("n"), "column", "left").select("column", "n", "mutual_information")
