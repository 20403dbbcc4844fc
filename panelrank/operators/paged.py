"""Pages kept together: one row per page that holds its rows as an array.

What is learnt from pages passes over them many times with other weights. Rows move once, by page,
and are written once; every later pass reads the pages where they lie and sends on only sums. A page
of more than ``MOST`` rows is not gathered: its rows stay plain rows in ``large``, for which
operators go the way they go on plain tables.

Ties are kept as the place of a row's tie columns in its page, from 1; equal ones share a place.
Columns must be present; a missing grade stays missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale

# Rows of a page that one array may hold.
MOST = 1000


@dataclass(frozen=True)
class Paged:
    whole: DataFrame
    large: DataFrame | None
    group: Sequence[str]
    keep: Sequence[str]
    cols: Sequence[str]
    rel: str
    tie: Sequence[str]

    def filter(self, condition: Column) -> Paged:
        """The pages whose group or kept columns meet the condition."""
        large = None if self.large is None else self.large.filter(condition)
        return replace(self, whole=self.whole.filter(condition), large=large)


@dataclass(frozen=True)
class Rows:
    """The rows of a batch of pages, page after page."""

    start: np.ndarray  # of each page, and the end
    page: np.ndarray
    rel: np.ndarray
    tie: np.ndarray
    x: list[np.ndarray]

    def score(self, cols: Sequence[str], weights: Mapping[str, float]) -> np.ndarray:
        """As ``ml.linear_score``, which adds up in the order of the weights."""
        total = np.zeros(len(self.page))
        for c, w in weights.items():
            total = total + self.x[cols.index(c)] * w
        return total

    def ranked(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each page from the highest score on, and each row's place from 1."""
        order = np.lexsort((self.tie, -score, self.page))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - self.start[self.page] + 1
        return order, place

    def ideal(self, k: int, grades: Sequence[int]) -> np.ndarray:
        """Each page's best possible gain, from its number of rows per grade."""
        pages = len(self.start) - 1
        upto = np.cumsum([np.bincount(self.page[self.rel == g], minlength=pages) for g in grades], axis=0)
        total = np.zeros(pages)
        for position in range(1, k + 1):
            best = np.select([u >= position for u in upto], list(grades), 0)
            total += best / np.log2(position + 1)
        return total


def rows(batch: pa.RecordBatch) -> Rows:
    column = batch.column("rows")
    sizes = np.diff(column.offsets.to_numpy())
    rel, tie, *x = (v.to_numpy(zero_copy_only=False) for v in column.flatten().flatten())
    page = np.repeat(np.arange(len(sizes)), sizes)
    return Rows(np.concatenate([[0], np.cumsum(sizes)]), page, rel, tie, x)


def arrange(
    df: DataFrame,
    group: Sequence[str],
    cols: Sequence[str],
    rel: str,
    tie: Sequence[str],
    keep: Sequence[str] = (),
    sizes: DataFrame | None = None,
    most: int = MOST,
) -> Paged:
    """Gather the rows of every page and write them. ``keep`` names columns that a page shares.

    ``sizes`` may name a cheaper table with the same group sizes to look for large pages in.
    """
    group, keep, cols, tie = list(group), list(keep), list(cols), list(tie)
    large = scale.oversized_groups(df.select(*group) if sizes is None else sizes, group, most)
    plain = df.select(*dict.fromkeys([*group, *keep, rel, *tie, *cols]))
    rest = plain
    if large is not None:
        rest = scale.join_groups(plain, large, group, "left_anti")
        large = scale.cut_lineage(scale.join_groups(plain, large, group, "left_semi"))
    xs = [f"x{n}" for n in range(len(cols))]
    placed = rest.select(
        *group,
        *keep,
        F.col(rel).cast("double").alias("grade"),
        F.rank().over(Window.partitionBy(*group).orderBy(*tie)).alias("place"),
        *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs, strict=True)],
    )
    whole = placed.groupBy(*group, *keep).agg(F.collect_list(F.struct("grade", "place", *xs)).alias("rows"))
    return Paged(scale.cut_lineage(whole), large, group, keep, cols, rel, tie)


def contrasts(paged: Paged, weight: str) -> DataFrame:
    """One row per positive of a page with negatives: its columns less their mean, and its grade."""
    names = [*paged.cols, weight]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows(batch)
            none, pages = found.rel == 0, len(found.start) - 1
            n = np.bincount(found.page[none], minlength=pages)
            at = np.flatnonzero((found.rel > 0) & (n[found.page] > 0))
            page = found.page[at]
            made = [
                x[at] - (np.bincount(found.page[none], x[none], minlength=pages) / np.maximum(n, 1))[page]
                for x in found.x
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*made, found.rel[at])], names)

    schema = ", ".join(f"`{c}` double" for c in names)
    return paged.whole.select("rows").mapInArrow(run, schema)
