"""Linear ranker learnt from pairs, each weighted by what swapping it would change in NDCG@k.

For a row i and a row j of the same page with a lower grade, the loss is
``delta * ln(1 + exp(score_j - score_i))``, where delta is the change of the page's NDCG@k if the two
changed places. Only positions up to k count, so j runs over the page's top k rows, which every map
task cuts down before the shuffle, and i over the rows with a positive grade: a page of any size
makes at most k pairs per positive row. The top rows of a page travel as one short array to its
positives; gradient and curvature are sums over all pairs, added up in the tasks, so one row per step
reaches the driver.

Learning passes over all pages once a step. Rows are arranged by page before the first (``paged``), and
a step ranks and pairs them where they lie; only pages too large for that are shuffled in each step.

A page without positives makes no pairs. A missing grade counts as 0; columns must be present.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrank.operators import metrics, paged, scale
from panelrank.operators.ml import linear_score


def _discount(place: Column, k: int) -> Column:
    return F.when(place <= k, 1 / F.log2(place + 1)).otherwise(0.0)


def pairs(
    df: DataFrame,
    group: Sequence[str],
    cols: Sequence[str],
    rel: str,
    tie: Sequence[str],
    weights: Mapping[str, float],
    k: int = 5,
    grades: Sequence[int] = metrics.GRADES,
) -> DataFrame:
    """(delta, gap, d_0, d_1, ...) per pair: its weight, score difference and column differences."""
    group, tie = list(group), list(tie)
    values = [F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate(cols)]
    grade = F.coalesce(F.col(rel), F.lit(0)).alias("rel")
    named = [F.col(t).alias(f"t{n}") for n, t in enumerate(tie)]
    ties = [f"t{n}" for n in range(len(tie))]
    # The score comes from the renamed columns, after them: the optimizer writes what it knows of a
    # score once for every choice between a column's two names, so 2 ** columns times the other way.
    rows = df.select(*group, grade, *named, *values)
    rows = rows.withColumn("s", linear_score({f"x{n}": weights[c] for n, c in enumerate(cols) if c in weights}))
    top = scale.top_k_in_group(rows, group, [F.desc("s"), *ties], k, "place")
    xs = [f"x{n}" for n in range(len(cols))]
    listed = F.collect_list(F.struct("place", "rel", "s", *ties, *xs)).alias("top")
    ideal = rows.groupBy(*group).agg(*metrics._grade_counts("rel", grades))
    ideal = ideal.select(*group, metrics._ideal(k, grades).alias("ideal"))
    pages = scale.join_groups(top.groupBy(*group).agg(listed), ideal.filter("ideal > 0"), group)
    found = scale.join_groups(rows.filter("rel > 0"), pages, group)

    def same(entry: Column) -> Column:
        out = F.lit(True)
        for t in ties:
            out = out & entry[t].eqNullSafe(F.col(t))
        return out

    place = F.get(F.filter("top", same), 0)["place"]
    found = found.withColumn("own", F.coalesce(_discount(place, k), F.lit(0.0)))
    found = found.withColumn("other", F.explode("top")).filter(F.col("other.rel") < F.col("rel"))
    swap = F.abs(F.col("own") - _discount(F.col("other.place"), k))
    return found.select(
        ((F.col("rel") - F.col("other.rel")) * swap / F.col("ideal")).alias("delta"),
        (F.col("s") - F.col("other.s")).alias("gap"),
        *[(F.col(x) - F.col(f"other.{x}")).alias(f"d_{n}") for n, x in enumerate(xs)],
    )


class _Sums:
    """Loss, slope and curvature of the pairs seen so far."""

    schema = "place int, pairs long, loss double, slope double, bend double"

    def __init__(self, k: int) -> None:
        self.n, self.loss, self.slope, self.bend = 0, 0.0, np.zeros(k), np.zeros(k)

    def add(self, delta: np.ndarray, gap: np.ndarray, d: np.ndarray) -> None:
        wrong = np.exp(-np.logaddexp(0.0, gap))  # how far the pair is from its order
        self.n += len(delta)
        self.loss += float(delta @ np.logaddexp(0.0, -gap))
        self.slope -= (delta * wrong) @ d
        self.bend += (delta * wrong * (1 - wrong)) @ (d * d)

    def frame(self) -> pd.DataFrame:
        places = range(len(self.slope))
        return pd.DataFrame({"place": places, "pairs": self.n, "loss": self.loss, "slope": self.slope, "bend": self.bend})


def _per_task(found: DataFrame, k: int) -> DataFrame:
    """The sums of each task's pairs, one row per column."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(k)
        for batch in batches:
            values = batch.to_numpy(float)
            sums.add(values[:, 0], values[:, 1], values[:, 2:])
        yield sums.frame()

    return found.select("delta", "gap", *[f"d_{n}" for n in range(k)]).mapInPandas(add, _Sums.schema)


def _added(sums: DataFrame, cols: Sequence[str]) -> DataFrame:
    total = sums.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("pairs", "loss", "slope", "bend")])
    every = sums.sparkSession.createDataFrame(list(enumerate(cols)), "place int, column string")
    zero = {"pairs": 0, "loss": 0.0, "slope": 0.0, "bend": 0.0}
    return every.join(total, "place", "left").fillna(zero).select("pairs", "loss", "column", "slope", "bend")


def gradient(found: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: the loss's slope and curvature, beside the number of pairs and the loss.

    Every task adds up its pairs and sends one row per column.
    """
    return _added(_per_task(found, len(cols)), list(cols))


def _swaps(
    rows: paged.Rows, score: np.ndarray, k: int, grades: Sequence[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i and j of every pair of a batch of pages, and the pair's weight."""
    rel = np.nan_to_num(rows.rel)
    order, place = rows.ranked(score)
    # Rows with equal ties stand at the first place of them.
    same = np.lexsort((place, rows.tie, rows.page))
    new = np.ones(len(same), bool)
    new[1:] = (rows.page[same][1:] != rows.page[same][:-1]) | (rows.tie[same][1:] != rows.tie[same][:-1])
    own = np.empty_like(place)
    own[same] = place[same][np.flatnonzero(new)][np.cumsum(new) - 1]
    ideal = rows.ideal(k, grades)
    positive = np.flatnonzero((rel > 0) & (ideal[rows.page] > 0))
    tops = np.minimum(np.diff(rows.start), k)[rows.page[positive]]
    i = np.repeat(positive, tops)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(tops) - tops, tops)
    j = order[rows.start[rows.page[i]] + nth]
    lower = rel[j] < rel[i]
    i, j = i[lower], j[lower]
    worth = np.where(place <= k, 1 / np.log2(place + 1), 0.0)
    first = np.where(own <= k, 1 / np.log2(own + 1), 0.0)
    return i, j, (rel[i] - rel[j]) * np.abs(first[i] - worth[j]) / ideal[rows.page[i]]


def page_gradient(
    pages: paged.Paged, weights: Mapping[str, float], k: int = 5, grades: Sequence[int] = metrics.GRADES
) -> DataFrame:
    """``gradient`` of the ``pairs`` of arranged pages."""
    cols = list(pages.cols)
    used = {c: weights[c] for c in cols if c in weights}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(cols))
        for batch in batches:
            rows = paged.rows(batch)
            score = rows.score(cols, used)
            i, j, delta = _swaps(rows, score, k, grades)
            sums.add(delta, score[i] - score[j], np.column_stack([x[i] - x[j] for x in rows.x]))
        frame = sums.frame().astype({"place": "int32"})
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    sums = pages.whole.select("rows").mapInArrow(run, _Sums.schema)
    if pages.large is not None:
        found = pairs(pages.large, pages.group, cols, pages.rel, pages.tie, weights, k, grades)
        sums = sums.union(_per_task(found, len(cols)))
    return _added(sums, cols)


def page_ndcg(
    pages: paged.Paged, weights: Mapping[str, float], k: int = 5, grades: Sequence[int] = metrics.GRADES
) -> DataFrame:
    """(kept columns, ndcg) per page, as ``metrics.ndcg_per_group``: pages without a group are left out."""
    cols, keep = list(pages.cols), list(pages.keep)
    whole = pages.whole.dropna(subset=[*pages.group, *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = paged.rows(batch)
            _, place = rows.ranked(rows.score(cols, weights))
            gain = np.where(place <= k, np.nan_to_num(rows.rel) / np.log2(place + 1), 0.0)
            reached = np.bincount(rows.page, gain, minlength=len(batch))
            ideal = rows.ideal(k, grades)
            found = np.divide(reached, ideal, out=np.zeros(len(batch)), where=ideal > 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found)], [*keep, "ndcg"])

    types = [f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in keep]
    found = whole.select(*keep, "rows").mapInArrow(run, ", ".join([*types, "ndcg double"]))
    if pages.large is not None:
        scored = pages.large.withColumn("score", linear_score(weights))
        rest = metrics.ndcg_per_group(scored, [*keep, *pages.group], pages.rel, "score", pages.tie, k, grades)
        found = found.union(rest.select(*keep, "ndcg"))
    return found


def fit(
    train: DataFrame | paged.Paged,
    check: DataFrame | paged.Paged,
    group: Sequence[str],
    cols: Sequence[str],
    rel: str,
    tie: Sequence[str],
    start: Mapping[str, float] | None = None,
    k: int = 5,
    steps: int = 10,
    rate: float = 0.3,
) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Weights after the step with the best NDCG@k on ``check``, and (loss, NDCG) of all steps.

    Steps divide the slope by the curvature, column by column. ``start`` (zeros if none) counts as
    a step too, so the result is never worse on ``check`` than what it started from. Plain tables are
    arranged by page first.
    """
    train, check = (
        t if isinstance(t, paged.Paged) else paged.arrange(t, group, cols, rel, tie) for t in (train, check)
    )
    weights = {c: float((start or {}).get(c, 0.0)) for c in cols}
    best, history = None, []
    for step in range(steps + 1):
        ndcg = page_ndcg(check, weights, k).agg(F.avg("ndcg").alias("ndcg")).first()["ndcg"] or 0.0
        rows = page_gradient(train, weights, k).collect()
        history.append((rows[0]["loss"], ndcg))
        if best is None or ndcg > best[0]:
            best = (ndcg, dict(weights))
        if step == steps or not rows[0]["pairs"]:
            break
        for r in rows:
            weights[r["column"]] -= rate * r["slope"] / (r["bend"] + 1e-9) if r["bend"] > 0 else 0.0
    return best[1], history
