"""Linear models of many splits at once, from sums of products per group of rows.

A least-squares fit, its penalised forms and its error on other rows need nothing but the sums of
products of (1, columns, target). So the rows are read once: every task multiplies its batches as
matrices, one small matrix per group (a day, an id, a fold, a replicate), and equal cells combine
before and after the shuffle. Expanding windows are differences of prefix sums over days, held-out
ids and folds are subtractions from the total, and resampled tables are weighted sums. The models
of all splits are then solved side by side, each from (columns + 2)^2 numbers; only numbers of that
size, or one row per fold or replicate, ever reach the driver.

Missing columns count as 0 (as before any model here); rows without a target take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale, splits
from panelrank.operators.ml import _error, _solve, centre

# Numbers that a task holds: products of its rows at a time, and sums of groups before it sends them on.
HELD = 1_000_000


# --- sums ---------------------------------------------------------------------------------


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def unpacked(sums: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle, row by row."""
    sums = np.asarray(sums, float)
    n = int((math.isqrt(8 * len(sums) + 1) - 1) // 2)
    out = np.zeros((n, n))
    i, j = _upper(n)
    out[i, j] = out[j, i] = sums
    return out


def _parts(batch: pd.DataFrame, cells: int) -> Iterator[pd.DataFrame]:
    """Rows of a batch whose products, so many ``cells`` a row, may be held at a time."""
    step = max(16, HELD // cells)
    for start in range(0, len(batch), step):
        yield batch.iloc[start : start + step]


def _product_rows(batch: pd.DataFrame, names: Sequence[str], off: np.ndarray) -> np.ndarray:
    """One row of products per row of the batch; a row without a target is all zeros."""
    values = batch[list(names)].to_numpy(float)
    known = ~np.isnan(values[:, -1])
    x = np.column_stack([np.ones(len(values)), np.nan_to_num(values) - off]) * known[:, None]
    i, j = _upper(x.shape[1])
    return x[:, i] * x[:, j]


def _combined(parts: DataFrame, by: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Sums of equally long arrays per group, place by place."""
    zipped = F.posexplode(F.arrays_zip(*arrays))
    cells = parts.select(*by, zipped).select(*by, "pos", "col.*")
    cells = cells.groupBy(*by, "pos").agg(*[F.sum(a).alias(a) for a in arrays])
    listed = F.array_sort(F.collect_list(F.struct("pos", *arrays)))

    def values(name: str):
        return F.transform("_cells", lambda x: x[name]).alias(name)

    grouped = cells.groupBy(*by).agg(listed.alias("_cells"))
    return grouped.select(*by, *[values(a) for a in arrays])


def sums_by(
    df: DataFrame, cols: Sequence[str], target: str, by: Sequence[str], middle: np.ndarray
) -> DataFrame:
    """(by..., sums): upper triangle of the products of (1, columns, target), less ``middle``."""
    by, names = list(by), [f"t{i}" for i in range(len(cols) + 1)]
    terms = df.select(
        *by,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, names)],
        F.col(target).cast("double").alias(names[-1]),
    )
    schema = terms.select(*by).schema.simpleString()[len("struct<") : -1]
    cells = len(_upper(len(cols) + 2)[0])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(list(held), columns=by, dtype=object)
            frame["sums"] = list(held.values())
            held.clear()
            return frame

        for batch in (part for whole in batches for part in _parts(whole, cells)):
            products = _product_rows(batch, names, middle)
            groups = batch.groupby(by, dropna=False, sort=False)
            codes = groups.ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            totals = np.add.reduceat(products[order], starts, axis=0)
            keys = batch[by].iloc[order[starts]].itertuples(index=False, name=None)
            for key, total in zip(keys, totals):
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = held[key] + total if key in held else total
            if len(held) * cells > HELD:
                yield out()
        if held:
            yield out()

    parts = terms.mapInPandas(run, f"{schema.replace(':', ' ')}, sums array<double>")
    return _combined(parts, by, ["sums"])


def _report(fit: np.ndarray, check: np.ndarray, used: Sequence[int], beta: np.ndarray) -> dict:
    """Errors of a model on the rows summed up in ``check``."""
    n = check[0, 0]
    if n <= 0:
        return {"mse": None, "r2": None, "baseline_mse": None}
    mse = max(_error(check, used, beta), 0.0)
    mean = fit[0, -1] / fit[0, 0]
    spread = check[-1, -1] / n - (check[0, -1] / n) ** 2
    base = check[-1, -1] / n - 2 * mean * check[0, -1] / n + mean**2
    return {
        "mse": float(mse),
        "r2": float(1 - mse / spread) if spread > 1e-12 else None,
        "baseline_mse": float(max(base, 0.0)),
    }


def _fitted(fit: np.ndarray, check: np.ndarray, penalty: float) -> dict:
    used = list(range(fit.shape[0] - 1))
    return _report(fit, check, used, _solve(fit, used, penalty))


def _solved(
    df: DataFrame, keep: Sequence[str], model: Callable[[dict[str, np.ndarray]], dict], schema: str
) -> DataFrame:
    """Run ``model`` on the matrices of every row (all array columns) beside the kept columns."""
    arrays = [c for c in df.columns if c not in keep]
    kept = df.select(*keep).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model({a: unpacked(row[a]) for a in arrays}) for _, row in batch.iterrows()]
            if found:
                yield pd.concat([batch[list(keep)].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    return df.mapInPandas(run, f"{kept}, {schema}")


# --- windows over days, held-out groups ---------------------------------------------------

ERRORS = "mse double, r2 double, baseline_mse double"


def over_windows(
    df: DataFrame, windows: DataFrame, cols: Sequence[str], target: str, penalty: float = 1e-10
) -> DataFrame:
    """Fit before, test within every window (split, test_start, test_end): one row per window.

    The sums of each day are added up along the calendar; what a window trains on is the sum before
    its first day, what it is tested on the difference of two sums. No row is read twice, however
    many windows overlap.
    """
    middle = centre(df, cols, target)
    days = sums_by(df, cols, target, ["date"], middle).select("date", F.posexplode("sums").alias("cell", "v"))
    # One row per day and cell: a cell's days are as many as the calendar has.
    along = Window.partitionBy("cell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    upto = scale.cut_lineage(
        days.select("date", "cell", "v", F.sum("v").over(along).alias("upto"))
    )
    first = upto.select(F.col("date").alias("test_start"), "cell", (F.col("upto") - F.col("v")).alias("fit"))
    last = upto.select(F.col("date").alias("test_end"), "cell", "upto")
    cells = windows.join(first, "test_start").join(last, ["test_end", "cell"])
    keep = ["split", "test_start", "test_end"]
    listed = F.array_sort(F.collect_list(F.struct("cell", "fit", "upto")))
    rows = cells.groupBy(*keep).agg(listed.alias("all"))
    rows = rows.select(
        *keep,
        F.transform("all", lambda x: x["fit"]).alias("fit"),
        F.transform("all", lambda x: x["upto"] - x["fit"]).alias("check"),
    )

    def model(m: dict[str, np.ndarray]) -> dict:
        counts = {"n_train": int(round(m["fit"][0, 0])), "n_test": int(round(m["check"][0, 0]))}
        return counts | _fitted(m["fit"], m["check"], penalty)

    return _solved(rows, keep, model, f"n_train long, n_test long, {ERRORS}")


def leave_groups_out(
    df: DataFrame,
    group: str,
    cols: Sequence[str],
    target: str,
    penalty: float = 1e-10,
    least: int = 3,
    strongest: int | None = None,
    shrink: tuple[float, float] | None = None,
) -> DataFrame:
    """Every group once as the test set of a model of all others: one row per group.

    A model's sums are the total less the group's own. ``strongest`` keeps that many columns, those
    with the largest correlation with the target among the other groups; ``shrink`` (penalty,
    l1 share) fits an elastic net instead of least squares. Groups with fewer than ``least`` rows
    with a target keep a row without errors.
    """
    middle = centre(df, cols, target)
    sums = scale.cut_lineage(sums_by(df, cols, target, [group], middle))
    total = _total(sums)

    def model(m: dict[str, np.ndarray]) -> dict:
        own = m["sums"]
        fit = total - own
        out = {"n_train": int(round(fit[0, 0])), "n_test": int(round(own[0, 0])), "n_columns": None}
        if out["n_test"] < least or out["n_train"] < least:
            return out | {"mse": None, "r2": None, "baseline_mse": None}
        used = list(range(fit.shape[0] - 1))
        if strongest is not None:
            tied = correlations(fit)
            used = [0, *sorted(1 + np.argsort(-np.abs(tied), kind="stable")[:strongest])]
        beta = _solve(fit, used, penalty) if shrink is None else elastic_net(fit, used, *shrink)
        return out | {"n_columns": len(used) - 1} | _report(fit, own, used, beta)

    return _solved(sums, [group], model, f"n_train long, n_test long, n_columns int, {ERRORS}")


def _total(sums: DataFrame) -> np.ndarray:
    cells = sums.select(F.posexplode("sums").alias("cell", "v"))
    rows = cells.groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    return unpacked([r["v"] for r in rows]) if rows else np.zeros((2, 2))


def mean_and_spread(rows: DataFrame, cols: Sequence[str] = ("mse", "r2")) -> DataFrame:
    """Number of scored splits, and mean and population spread of each score over them."""
    return rows.filter(F.col(cols[0]).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_splits"),
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
    )


# --- penalties ----------------------------------------------------------------------------


def _moments(fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation matrix of the columns, their covariance with the target over own spread, spreads."""
    n = fit[0, 0]
    cov = fit[1:, 1:] / n - np.outer(fit[0, 1:], fit[0, 1:]) / n**2
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    wide = np.where(spread > 1e-9, spread, np.inf)[:-1]
    return cov[:-1, :-1] / np.outer(wide, wide), cov[:-1, -1] / wide, wide


def correlations(fit: np.ndarray) -> np.ndarray:
    """Correlation of every column with the target; 0 for a constant one."""
    _, c, _ = _moments(fit)
    n = fit[0, 0]
    spread = math.sqrt(max(fit[-1, -1] / n - (fit[0, -1] / n) ** 2, 0.0))
    return c / spread if spread > 1e-12 else np.zeros_like(c)


def _unscaled(fit: np.ndarray, used: Sequence[int], w: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Coefficients (intercept first) for the columns as they are summed up."""
    beta = w / wide
    n = fit[0, 0]
    intercept = fit[0, -1] / n - beta @ (fit[0, list(used[1:])] / n)
    return np.concatenate([[intercept], beta])


def elastic_net(
    fit: np.ndarray,
    used: Sequence[int],
    penalty: float,
    l1_share: float,
    start: np.ndarray | None = None,
    rounds: int = 10_000,
    tolerance: float = 1e-12,
) -> np.ndarray:
    """Coefficients on standardised columns that minimise
    ``mse / 2 + penalty * (l1_share * |w| + (1 - l1_share) / 2 * w^2)``, by coordinate descent.
    """
    part = fit[np.ix_([*used, -1], [*used, -1])]
    r, c, wide = _moments(part)
    ridge, lasso = penalty * (1 - l1_share), penalty * l1_share
    if l1_share == 0:
        w = np.linalg.solve(r + (ridge + 1e-12) * np.eye(len(c)), c)
        return _unscaled(fit, used, w, wide)
    w = np.zeros(len(c)) if start is None else start.copy()
    left = c - r @ w
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            if r[j, j] <= 0:
                continue
            pull = left[j] + r[j, j] * w[j]
            new = math.copysign(max(abs(pull) - lasso, 0.0), pull) / (r[j, j] + ridge)
            if new != w[j]:
                left -= r[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tolerance:
            break
    return _unscaled(fit, used, w, wide)


def penalty_grid(fit: np.ndarray, l1_share: float, n: int = 100, least: float = 1e-3) -> list[float]:
    """Penalties from the smallest that leaves no column down to ``least`` times it, evenly in log."""
    _, c, _ = _moments(fit)
    top = float(np.max(np.abs(c))) / max(l1_share, 1e-3)
    return [float(x) for x in np.geomspace(max(top, 1e-12), max(top, 1e-12) * least, n)]


def penalty_path(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    fold: str,
    l1_shares: Sequence[float] = (1.0,),
    penalties: Sequence[float] | None = None,
) -> DataFrame:
    """Held-out error of every penalty: (l1_share, penalty, folds, mse, mse_std, chosen).

    ``fold`` splits the rows; a fold's model is fitted to the sums of all others, in which every
    penalty of the path is solved. The penalty with the least mean error is chosen per l1 share, the
    larger one where two tie. Without ``penalties`` every l1 share has its own grid.
    """
    fits, checks, total = _fold_sums(df, cols, target, fold, centre(df, cols, target))
    rows = _path_rows(fits, checks, total, l1_shares, penalties)
    return df.sparkSession.createDataFrame(
        rows, "l1_share double, penalty double, folds int, mse double, mse_std double, chosen boolean"
    )


def _fold_sums(df: DataFrame, cols: Sequence[str], target: str, fold: str, middle: np.ndarray):
    found = sums_by(df, cols, target, [fold], middle).orderBy(fold).collect()
    own = [unpacked(r["sums"]) for r in found]
    own = [g for g in own if g[0, 0] > 0]
    total = sum(own, np.zeros((len(cols) + 2, len(cols) + 2)))
    return [total - g for g in own], own, total


def _path_rows(fits, checks, total, l1_shares, penalties) -> list[tuple]:
    used = list(range(total.shape[0] - 1))
    rows = []
    for share in l1_shares:
        tried = []
        for penalty in sorted(penalties or penalty_grid(total, share), reverse=True):
            errors = [
                _error(check, used, elastic_net(fit, used, penalty, share))
                for fit, check in zip(fits, checks)
                if fit[0, 0] > 0
            ]
            if errors:
                tried.append((float(np.mean(errors)), float(np.std(errors)), penalty, len(errors)))
        if not tried:  # no rows to fit to
            continue
        best = min(range(len(tried)), key=lambda i: (round(tried[i][0], 12), i))
        rows += [
            (float(share), float(p), n, mse, std, i == best) for i, (mse, std, p, n) in enumerate(tried)
        ]
    return rows


def penalised_models(
    train: DataFrame,
    test: DataFrame,
    cols: Sequence[str],
    target: str,
    fold: str,
    kinds: Mapping[str, tuple[Sequence[float], Sequence[float] | None]],
) -> DataFrame:
    """Chosen penalties refitted on all training rows and scored on the test rows, one per kind.

    ``kinds`` maps a name to (l1 shares, penalties or None for grids), such as
    ``{"lasso": ((1.0,), None), "ridge": ((0.0,), (0.01, 0.1, 1, 10, 100))}``.
    """
    middle = centre(train, cols, target)
    fits, checks, total = _fold_sums(train, cols, target, fold, middle)
    check = _total(sums_by(test.withColumn("_all", F.lit(1)), cols, target, ["_all"], middle))
    used = list(range(total.shape[0] - 1))
    rows = []
    for name, (shares, penalties) in kinds.items():
        path = [r for r in _path_rows(fits, checks, total, shares, penalties) if r[5]]
        if not path:
            continue
        share, penalty, _, mse, _, _ = min(path, key=lambda r: r[3])
        beta = elastic_net(total, used, penalty, share)
        scores = _report(total, check, used, beta)
        kept = int(np.count_nonzero(beta[1:]))
        rows.append((name, share, penalty, mse, kept, scores["mse"], scores["r2"], scores["baseline_mse"]))
    return train.sparkSession.createDataFrame(
        rows,
        "model string, l1_share double, penalty double, cv_mse double, n_columns int, " + ERRORS,
    )


# --- bootstrap ----------------------------------------------------------------------------

def out_of_bag(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    key: Sequence[str],
    replicates: int = 200,
    seed: int = 42,
    penalty: float = 1e-10,
) -> DataFrame:
    """A model per resampled table, tested on the rows it did not draw: one row per replicate.

    Every row draws a Poisson(1) weight per replicate from a hash, so no task needs the table's size
    and a lost task draws the same again. All replicates are summed in one pass: weights times
    products is one matrix product per batch, and rows of weight 0 make the test sums.
    """
    names = [f"t{i}" for i in range(len(cols) + 1)]
    middle = centre(df, cols, target)
    terms = df.select(
        splits.row_numbers(key, seed).alias("number"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, names)],
        F.col(target).cast("double").alias(names[-1]),
    )
    keys = splits.replicate_keys(replicates, seed)
    cells = len(_upper(len(cols) + 2)[0])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn, rest = np.zeros((replicates, cells)), np.zeros((replicates, cells))
        for batch in (part for whole in batches for part in _parts(whole, cells)):
            products = _product_rows(batch, names, middle)
            w = splits.drawn_weights(batch["number"].to_numpy(), keys)
            drawn += w.T.astype(float) @ products
            rest += (w == 0).T.astype(float) @ products
        yield pd.DataFrame({"replicate": range(replicates), "fit": list(drawn), "rest": list(rest)})

    parts = terms.mapInPandas(run, "replicate int, fit array<double>, rest array<double>")
    sums = _combined(parts, ["replicate"], ["fit", "rest"])

    def model(m: dict[str, np.ndarray]) -> dict:
        n = {"n_in": int(round(m["fit"][0, 0])), "n_out": int(round(m["rest"][0, 0]))}
        none = {"mse_in": None, "mse": None, "r2": None, "baseline_mse": None}
        if n["n_in"] == 0 or n["n_out"] == 0:
            return n | none
        own = _fitted(m["fit"], m["fit"], penalty)["mse"]
        return n | {"mse_in": own} | _fitted(m["fit"], m["rest"], penalty)

    return _solved(sums, ["replicate"], model, f"n_in long, n_out long, mse_in double, {ERRORS}")


def estimate_632(
    df: DataFrame, replicates: DataFrame, cols: Sequence[str], target: str, penalty: float = 1e-10
) -> DataFrame:
    """0.368 times the error on the fitted rows plus 0.632 times the mean out-of-bag error."""
    total = _total(sums_by(df.withColumn("_all", F.lit(1)), cols, target, ["_all"], centre(df, cols, target)))
    own = _fitted(total, total, penalty)
    scores = replicates.agg(
        F.count("mse").alias("replicates"), F.avg("mse").alias("mse_oob"), F.avg("r2").alias("r2_oob")
    )
    return scores.select(
        "replicates",
        *[
            column
            for name in ("mse", "r2")
            for column in (
                F.lit(own[name]).alias(f"{name}_train"),
                F.col(f"{name}_oob"),
                (0.368 * F.lit(own[name]) + 0.632 * F.col(f"{name}_oob")).alias(f"{name}_632"),
            )
        ],
    )
