"""Filling and gap handling inside one id of a panel (row order is by date)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrank.operators import scale
from panelrank.operators.clean import replace_columns


def by_id() -> WindowSpec:
    return Window.partitionBy("id").orderBy("date")


def so_far() -> WindowSpec:
    return by_id().rowsBetween(Window.unboundedPreceding, 0)


def _previous(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def _next(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(
        by_id().rowsBetween(0, Window.unboundedFollowing)
    )


def forward_backward_fill(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(
        panel, {c: F.coalesce(_previous(F.col(c)), _next(F.col(c))) for c in cols}
    )


def interpolate_linear(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Linear by row position; both ends continue flat.

    Rises are multiplied before they are divided, as the SQL does: the other order gives other last
    bits, and a mean that lies exactly on a cut would fall on its other side.
    """
    rows = panel.withColumn("_row", F.row_number().over(by_id()).cast("double"))
    spots = {}
    for c in cols:
        here = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_row").alias("r")))
        spots[f"_a_{c}"] = _previous(here)
        spots[f"_b_{c}"] = _next(here)
    rows = rows.withColumns(spots)
    new = {}
    for c in cols:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        risen = (b["v"] - a["v"]) * (F.col("_row") - a["r"])
        between = a["v"] + F.try_divide(risen, b["r"] - a["r"])
        new[c] = F.coalesce(F.col(c), between, a["v"], b["v"])
    return replace_columns(rows, new).drop("_row", *spots)


def impute_hybrid(
    panel: DataFrame, continuous: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    return forward_backward_fill(interpolate_linear(panel, continuous), categorical)


def _with_run(panel: DataFrame, col: str) -> DataFrame:
    """Missing rows of one run share the count of values seen before it."""
    return panel.withColumn("_run", F.count(F.col(col)).over(so_far()))


def gap_runs(panel: DataFrame, col: str) -> DataFrame:
    """Every run of missing rows: id, first and last date, length."""
    return (
        _with_run(panel, col)
        .filter(F.col(col).isNull())
        .groupBy("id", "_run")
        .agg(
            F.min("date").alias("gap_start"),
            F.max("date").alias("gap_end"),
            F.count(F.lit(1)).alias("gap_days"),
        )
        .drop("_run")
    )


def gap_lengths(panel: DataFrame, col: str, long: int = 7) -> DataFrame:
    """Per id: number of gaps, longest, mean, and how many exceed ``long`` rows."""
    return (
        gap_runs(panel, col)
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.max("gap_days").alias("longest_gap"),
            F.avg("gap_days").alias("mean_gap"),
            F.count_if(F.col("gap_days") > long).alias("long_gaps"),
        )
    )


def long_gap_mask(panel: DataFrame, col: str, longest: int = 7, out: str = "in_long_gap") -> DataFrame:
    """True on missing rows inside a run longer than ``longest``."""
    run = Window.partitionBy("id", "_run")
    missing = F.col(col).isNull()
    size = F.count_if(missing).over(run)
    return _with_run(panel, col).withColumn(out, missing & (size > longest)).drop("_run")


def restore_long_gaps(panel: DataFrame, cols: Sequence[str], masks: Sequence[str]) -> DataFrame:
    """Imputed values inside marked gaps become missing again."""
    return replace_columns(
        panel, {c: F.when(~F.col(m), F.col(c)) for c, m in zip(cols, masks, strict=True)}
    )


def delete_long_gaps(panel: DataFrame, col: str, longest: int = 2) -> DataFrame:
    """Drop the rows of every run of missing values longer than ``longest``."""
    return long_gap_mask(panel, col, longest, "_long").filter(~F.col("_long")).drop("_long")


def median_fill(panel: DataFrame, cols: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """Missing becomes the id's median, then the table's; ``zero`` columns become 0."""
    table = {c: q[0] for c, (_, q) in scale.quantile_values(panel, cols, [0.5]).items()}
    whole = Window.partitionBy("id")
    new = {
        c: F.coalesce(
            F.col(c), F.percentile(F.col(c), 0.5).over(whole), F.lit(table.get(c)).cast("double")
        )
        for c in cols
    }
    new |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero}
    return replace_columns(panel, new)


# Rows of whole ids that a task fills side by side.
ROWS_AT_ONCE = 100_000

# Values of an id's rows and where every id starts, to the values with holes filled.
Fill = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _filled_per_id(panel: DataFrame, cols: Sequence[str], fill: Fill) -> DataFrame:
    """Replace ``cols`` by what ``fill`` makes of each id's rows, in the order of their dates.

    Rows travel sorted by id and many ids are filled at once, so work does not go by the call. They are
    dealt by a hash of the id: dealt by the id itself, the shuffle would be dropped for the one of the
    windows before, whose partitions are merged by size although the work per byte is high here.
    """
    cols = list(cols)
    schema = T.StructType(
        [
            T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType)
            for f in panel.schema.fields
        ]
    )

    def changed(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = [rows[c].cast(pa.float64()).to_numpy() for c in cols]
        full = fill(np.column_stack(values).astype(float), starts)
        for i, c in enumerate(cols):
            place = rows.column_names.index(c)
            rows = rows.set_column(place, c, pa.array(full[:, i], pa.float64(), from_pandas=True))
        yield from rows.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            starts = _starts(rows["id"])
            # The last id may go on in the next batch.
            if starts[-1]:
                yield from changed(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
            n = 0 if starts[-1] else n
        if n or held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield from changed(rows, _starts(rows["id"]))

    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = panel.repartition(n, F.xxhash64("id")).sortWithinPartitions("id", "date")
    return dealt.mapInArrow(run, schema)


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where each id starts among rows that are sorted by it; a missing id is one like any other."""
    codes = ids.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(codes, prepend=-1))


def _nearest_fill(values: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Fill holes with the mean of the k nearest rows that hold the column."""
    seen = ~np.isnan(values)
    filled = np.where(seen, values, 0.0)
    out = values.copy()
    width = values.shape[1]
    column_mean = np.divide(
        filled.sum(0), seen.sum(0), out=np.zeros(width), where=seen.sum(0) > 0
    )
    for start in range(0, len(values), block):
        rows = np.arange(start, min(start + block, len(values)))
        rows = rows[(~seen[rows]).any(1)]
        if not len(rows):
            continue
        a, m = filled[rows], seen[rows].astype(float)
        common = m @ seen.T.astype(float)
        squares = (
            (a**2) @ seen.T.astype(float) + m @ (filled**2).T - 2 * (a @ filled.T)
        )
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.maximum(squares, 0.0) * width / common
        distance[common == 0] = np.inf
        distance = np.round(distance, 9)
        for j in range(width):
            need = np.flatnonzero(~seen[rows, j])
            donors = np.flatnonzero(seen[:, j])
            if not len(need) or not len(donors):
                continue
            near = distance[np.ix_(need, donors)]
            order = np.argsort(near, axis=1, kind="stable")[:, :k]
            picked = np.take_along_axis(near, order, axis=1)
            usable = np.isfinite(picked)
            held = np.where(usable, values[donors[order], j], 0.0)
            count = usable.sum(1)
            out[rows[need], j] = np.where(
                count > 0, held.sum(1) / np.maximum(count, 1), column_mean[j]
            )
    return out


def impute_knn(panel: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Per id: holes take the mean of the k nearest rows by missing-aware Euclidean distance.

    Ties go to the earlier date; a column an id never has becomes 0. An id holds at most one
    row per calendar day, and its distances are computed a block of rows at a time.
    """

    def fill(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = values.copy()
        for own in np.split(out, starts[1:]):
            own[:, np.isnan(own).all(0)] = 0.0
            if np.isnan(own).any():
                own[:] = _nearest_fill(own, k)
        return out

    return _filled_per_id(panel, cols, fill)


# Sums of one column's regressions, an id each, to the coefficients: products of the others, products
# with the column, rows and squares of the column.
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _one_round(full: np.ndarray, hole: np.ndarray, starts: np.ndarray, turns: np.ndarray, fit: Fit) -> None:
    """Regress each column on the others and fill its holes, for all ids side by side.

    ``full`` and ``hole`` have a row per column, in every id's own order of turns; ``turns`` says in
    which ids a column is filled.
    """
    k = len(full)
    ids = np.repeat(np.arange(len(starts)), np.diff(starts, append=full.shape[1]))
    for j in range(k):
        live = np.flatnonzero(turns[j])
        if not len(live):
            continue
        seen = ~hole[j]
        n = np.maximum(np.add.reduceat(seen, starts, dtype=float), 1.0)
        others = [i for i in range(k) if i != j]

        def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mid = np.add.reduceat(x * seen, starts) / n
            return x - mid[ids], mid

        gaps = [centred(full[i])[0] for i in others]
        marked = [g * seen for g in gaps]
        y, top = centred(full[j])
        y = y * seen
        with_y = np.zeros((len(starts), k - 1))
        among = np.zeros((len(starts), k - 1, k - 1))
        for a in range(k - 1):
            with_y[:, a] = np.add.reduceat(marked[a] * y, starts)
            for b in range(a, k - 1):
                among[:, a, b] = among[:, b, a] = np.add.reduceat(marked[a] * marked[b], starts)
        beta = np.zeros((len(starts), k - 1))
        beta[live] = fit(among[live], with_y[live], n[live], np.add.reduceat(y * y, starts)[live])
        guess = top[ids]
        for a in range(k - 1):
            guess = guess + gaps[a] * beta[ids, a]
        filled = hole[j] & turns[j][ids]
        full[j] = np.where(filled, guess, full[j])


def _chained(
    values: np.ndarray, starts: np.ndarray, fit: Fit, rounds: int, least: int, tolerance: float | None = None
) -> np.ndarray:
    """Holes of many ids' rows filled by regressing each column on the others, in rounds.

    Holes start at the id's mean of the column, or 0 without values; columns with fewer holes go first,
    and those with fewer than ``least`` values keep their start. With ``tolerance`` an id ends when
    none of its filled values moves by more than that times its largest value.
    """
    ids = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
    missing = np.isnan(values)
    counts = np.add.reduceat(~missing, starts, axis=0, dtype=int)
    holes = np.add.reduceat(missing, starts, axis=0, dtype=int)
    known = np.where(missing, 0.0, values)
    start = np.add.reduceat(known, starts, axis=0) / np.maximum(counts, 1)
    order = np.argsort(holes, axis=1, kind="stable")
    full = np.take_along_axis(np.where(missing, start[ids], values), order[ids], 1).T.copy()
    hole = np.take_along_axis(missing, order[ids], 1).T.copy()
    turns = np.take_along_axis((holes > 0) & (counts >= least), order, 1).T.copy()
    limit = None
    if tolerance is not None:
        limit = tolerance * np.maximum.reduceat(np.abs(known).max(1), starts)
    live = turns.any(0)
    for _ in range(rounds):
        if not live.any():
            break
        rows = live[ids]
        part, sizes = full[:, rows], np.diff(starts, append=len(values))[live]
        own = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before = part.copy()
        _one_round(part, hole[:, rows], own, turns[:, live], fit)
        full[:, rows] = part
        if limit is not None:
            moved = np.maximum.reduceat(np.abs(part - before).max(0), own)
            live[np.flatnonzero(live)[moved < limit[live]]] = False
    out = np.empty_like(values)
    np.put_along_axis(out, order[ids], full.T, 1)
    return out


def impute_regression(
    panel: DataFrame, cols: Sequence[str], rounds: int = 10, penalty: float = 1e-3
) -> DataFrame:
    """Per id, chained ridge regressions: each column on the others, ``rounds`` times.

    Holes start at the column mean. A column with fewer than two values keeps that start.
    """

    def fit(among: np.ndarray, with_y: np.ndarray, n: np.ndarray, squares: np.ndarray) -> np.ndarray:
        ridge = among + penalty * np.eye(among.shape[1])
        return np.linalg.solve(ridge, with_y[:, :, None])[:, :, 0]

    def fill(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        full = _chained(values, starts, fit, rounds, least=2)
        ids = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
        some = np.logical_or.reduceat(~np.isnan(values).all(1), starts)
        return np.where(some[ids, None], full, values)

    return _filled_per_id(panel, cols, fill)


def _evidence(
    among: np.ndarray,
    with_y: np.ndarray,
    n: np.ndarray,
    squares: np.ndarray,
    steps: int = 300,
    tolerance: float = 1e-3,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge regressions whose penalties are estimated: (coefficients, weight and noise precisions).

    One regression per row of the sums: products of the columns, products with the target, rows and
    squares of the target, all centred. Weights have a normal prior and errors are normal; both
    precisions are raised to the maximum of the evidence in turn with the weights, under flat gamma
    priors. All steps work on the eigenvalues of the columns' products; a regression that no longer
    moves takes part no more.
    """
    tiny = 1e-6
    all_lengths, all_axes = np.linalg.eigh(among)
    all_lengths = np.maximum(all_lengths, 0.0)
    all_along = np.matmul(all_axes.transpose(0, 2, 1), with_y[:, :, None])[:, :, 0]
    all_noise, all_weight = 1.0 / (squares / n + np.finfo(float).eps), np.ones(len(n))
    open_ = np.arange(len(n))
    lengths, axes, along, noise, weight = all_lengths, all_axes, all_along, all_noise, all_weight
    rows, total, before = n, squares, None
    for _ in range(steps):
        if not len(open_):
            break
        w = along / (lengths + (weight / noise)[:, None])
        error = np.maximum(total - 2 * (w * along).sum(1) + (lengths * w * w).sum(1), 0.0)
        # Number of weights that the data determine, rather than the prior.
        pulled = noise[:, None] * lengths
        known = (pulled / (weight[:, None] + pulled)).sum(1)
        weight = (known + 2 * tiny) / ((w * w).sum(1) + 2 * tiny)
        noise = (rows - known + 2 * tiny) / (error + 2 * tiny)
        all_noise[open_], all_weight[open_] = noise, weight
        if before is not None:
            moved = np.abs(np.matmul(axes, (w - before)[:, :, None])[:, :, 0]).sum(1)
            on = moved >= tolerance
            if not on.all():
                open_, lengths, axes, along = open_[on], lengths[on], axes[on], along[on]
                noise, weight, rows, total, w = noise[on], weight[on], rows[on], total[on], w[on]
        before = w
    w = all_along / (all_lengths + (all_weight / all_noise)[:, None])
    return np.matmul(all_axes, w[:, :, None])[:, :, 0], all_weight, all_noise


def evidence_ridge(
    x: np.ndarray, y: np.ndarray, steps: int = 300, tolerance: float = 1e-3
) -> tuple[np.ndarray, float, float]:
    """One regression with estimated penalty: (coefficients, weight and noise precision).

    ``x`` and ``y`` are centred.
    """
    n, squares = np.array([float(len(y))]), np.array([float(y @ y)])
    beta, weight, noise = _evidence((x.T @ x)[None], (x.T @ y)[None], n, squares, steps, tolerance)
    return beta[0], float(weight[0]), float(noise[0])


def chained_evidence(
    values: np.ndarray, starts: np.ndarray, rounds: int = 10, tolerance: float = 1e-3
) -> np.ndarray:
    """Holes of ids' rows filled by chained regressions with estimated penalties, in rounds.

    ``starts`` are the ids' first rows. Holes start at the column's mean; columns with fewer holes go
    first. An id ends when none of its filled values moves by more than ``tolerance`` times its largest
    value. A column that an id never has stays missing.
    """

    def fit(*sums: np.ndarray) -> np.ndarray:
        return _evidence(*sums)[0]

    full = _chained(values, starts, fit, rounds, least=1, tolerance=tolerance)
    ids = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
    never = np.logical_and.reduceat(np.isnan(values), starts, axis=0)
    return np.where(never[ids], np.nan, full)


def impute_evidence(
    panel: DataFrame, cols: Sequence[str], rounds: int = 10, longest: int | None = 7
) -> DataFrame:
    """Per id, chained regressions with estimated penalties; long gaps stay missing.

    Values inside runs of more than ``longest`` missing rows are used to fill others but are not
    kept (None keeps all). An id's panel has at most one row per calendar day.
    """
    cols = list(cols)
    masks = [f"_long_{c}" for c in cols]
    if longest is not None:
        for c, m in zip(cols, masks):
            panel = long_gap_mask(panel, c, longest, m)

    def fill(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return chained_evidence(values, starts, rounds)

    filled = _filled_per_id(panel, cols, fill)
    if longest is None:
        return filled
    return restore_long_gaps(filled, cols, masks).drop(*masks)


def imputation_report(methods: dict[str, DataFrame], col: str) -> DataFrame:
    """Mean, spread, median and count of a column under several imputations."""
    stacked = None
    for name, df in methods.items():
        part = df.select(F.lit(name).alias("method"), F.col(col).cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    from panelrank.functions.stats import sample_skew

    moments = stacked.groupBy("method").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        sample_skew(F.col("value")).alias("skew"),
    )
    middle = scale.quantiles(stacked, ["value"], [0.5], by=["method"])
    return moments.join(
        middle.select("method", F.col("q")[0].alias("median")), "method", "left"
    )
