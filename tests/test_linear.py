"""Models over many splits against a plain solver on the same rows."""

import datetime as dt

import numpy as np
import pytest

from panelrank.operators import linear, splits

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(900):
        x = rng.normal(5, [1, 2, 3, 0.5])
        y = 3 + x[0] - 0.5 * x[1] + 0.1 * x[2] + rng.normal(0, 0.7)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 40)))
        cells = [None if rng.random() < 0.05 else float(v) for v in x]
        out.append((f"p{i % 23}" if i % 29 else None, day, i, *cells, None if i % 31 == 0 else float(y)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    schema = "id string, date date, n long, " + ", ".join(f"{c} double" for c in COLS) + ", y double"
    return spark.createDataFrame(rows, schema).repartition(3)


def arrays(rows):
    rows = [r for r in rows if r[-1] is not None]
    x = np.array([[0.0 if v is None else v for v in r[3:-1]] for r in rows]).reshape(-1, len(COLS))
    return x, np.array([r[-1] for r in rows], float)


def fitted(train, test, weight=None):
    x, y = arrays(train)
    z, t = arrays(test)
    w = np.ones(len(y)) if weight is None else weight
    x1 = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(x1 * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    error = t - np.column_stack([np.ones(len(z)), z]) @ beta
    mse = np.mean(error**2)
    return mse, 1 - mse / np.var(t), np.mean((t - np.average(y, weights=w)) ** 2)


def close(row, want):
    assert np.allclose([row.mse, row.r2, row.baseline_mse], want, rtol=1e-6)


def test_windows_equal_a_fit_per_window(table, rows):
    known = table.filter("y IS NOT NULL")
    windows = splits.walk_forward(known, 7)
    got = linear.over_windows(table, windows, COLS, "y").collect()
    assert len(got) == windows.count() >= 2
    for r in got:
        train = [x for x in rows if x[1] < r.test_start]
        test = [x for x in rows if r.test_start <= x[1] <= r.test_end]
        assert (r.n_train, r.n_test) == (len(arrays(train)[1]), len(arrays(test)[1]))
        close(r, fitted(train, test))


def test_left_out_groups_equal_a_fit_per_group(table, rows):
    got = linear.leave_groups_out(table, "id", COLS, "y", least=3).collect()
    assert {r.id for r in got} == {x[0] for x in rows}
    for r in got:
        train, test = [x for x in rows if x[0] != r.id], [x for x in rows if x[0] == r.id]
        assert r.n_columns == 4
        close(r, fitted(train, test))
    few = linear.leave_groups_out(table, "n", COLS, "y", least=3).first()
    assert few.mse is None and few.n_test <= 1


def soft(x, y, penalty, share):
    """Elastic net on standardised columns by proximal steps."""
    z, mid = x - x.mean(0), y.mean()
    z = z / x.std(0)
    w, step = np.zeros(x.shape[1]), 1 / (np.linalg.norm(z.T @ z / len(y), 2) + penalty)
    for _ in range(5000):
        g = z.T @ (z @ w - (y - mid)) / len(y) + penalty * (1 - share) * w
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty * share, 0)
    return lambda t: mid + (t - x.mean(0)) / x.std(0) @ w


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_penalties_equal_a_plain_solver(table, rows, share):
    folded = splits.group_kfold(table, "id", 4)
    fold = {r.n: r.fold for r in folded.select("n", "fold").collect()}
    got = linear.penalty_path(folded, COLS, "y", "fold", (share,), (0.05, 0.4)).collect()
    for r in got:
        errors = []
        for f in sorted(set(fold.values())):
            x, y = arrays([q for q in rows if fold[q[2]] != f])
            t, u = arrays([q for q in rows if fold[q[2]] == f])
            errors.append(np.mean((u - soft(x, y, r.penalty, share)(t)) ** 2))
        assert r.folds == len(errors) and np.allclose([r.mse, r.mse_std], [np.mean(errors), np.std(errors)], rtol=1e-6)
    assert sum(r.chosen for r in got) == 1


def test_chosen_models(table):
    folded = splits.group_kfold(table, "id", 4)
    kinds = {"lasso": ((1.0,), None), "ridge": ((0.0,), (0.01, 1.0)), "net": ((0.2, 0.8), None)}
    got = {r.model: r for r in linear.penalised_models(folded, folded, COLS, "y", "fold", kinds).collect()}
    assert set(got) == set(kinds)
    assert all(r.mse < 0.8 * r.baseline_mse and r.n_columns >= 3 for r in got.values()), got


def test_strongest_columns_with_elastic_net(table, rows):
    got = linear.leave_groups_out(table, "id", COLS, "y", strongest=2, shrink=(0.1, 0.5)).collect()
    for r in got[:4]:
        x, y = arrays([q for q in rows if q[0] != r.id])
        t, u = arrays([q for q in rows if q[0] == r.id])
        best = np.sort(np.argsort(-np.abs([np.corrcoef(x[:, j], y)[0, 1] for j in range(4)]))[:2])
        error = u - soft(x[:, best], y, 0.1, 0.5)(t[:, best])
        assert r.n_columns == 2 and np.isclose(r.mse, np.mean(error**2), rtol=1e-6)


def test_out_of_bag_refits(table, rows):
    got = linear.out_of_bag(table, COLS, "y", ["n"], replicates=12).collect()
    numbers = {r.n: r.number for r in table.select("n", splits.row_numbers(["n"]).alias("number")).collect()}
    known = [r for r in rows if r[-1] is not None]
    drawn = splits.drawn_weights(np.array([numbers[r[2]] for r in known]), splits.replicate_keys(12))
    assert len(got) == 12
    for r in got:
        w = drawn[:, r.replicate].astype(float)
        rest = [q for q, n in zip(known, w) if n == 0]
        assert (r.n_in, r.n_out) == (w.sum(), len(rest))
        close(r, fitted(known, rest, w))
    assert abs(np.mean([r.n_out for r in got]) / len(known) - np.exp(-1)) < 0.03


def test_weights_follow_the_distribution():
    numbers = np.arange(1, 200_000) * 7919 % splits.PRIME
    drawn = splits.drawn_weights(numbers, splits.replicate_keys(5)).ravel()
    for k, p in enumerate(np.exp(-1) / np.array([1, 1, 2, 6, 24])):
        assert abs(np.mean(drawn == k) - p) < 0.005
    assert len(splits.poisson_cuts()) > 10


def test_tables_without_rows(table):
    none = table.filter("n < 0")
    assert linear.leave_groups_out(none, "id", COLS, "y").count() == 0
    assert linear.penalty_path(splits.group_kfold(table.filter("y IS NULL"), "id"), COLS, "y", "fold", (1.0,), (0.1,)).count() == 0


def test_products_held_do_not_grow_with_rows_or_columns():
    import pandas as pd

    batch = pd.DataFrame({"x": range(10_000)})
    for cells in (3, 528, 20_000):
        parts = list(linear._parts(batch, cells))
        assert pd.concat(parts).equals(batch)
        assert all(len(p) * cells <= linear.HELD for p in parts)


def test_sums_of_groups_that_go_on_in_the_next_part(spark):
    rng = np.random.default_rng(4)
    n, cols = 6_000, [f"c{i}" for i in range(40)]
    data = rng.normal(size=(n, len(cols) + 1))
    rows = [(int(i % 7) or None, *map(float, r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in [*cols, "y"])).coalesce(1)
    got = {r.g: linear.unpacked(r.sums) for r in linear.sums_by(df, cols, "y", ["g"], np.zeros(len(cols) + 1)).collect()}
    x = np.column_stack([np.ones(n), data])
    for g in range(7):
        own = x[np.arange(n) % 7 == g]
        np.testing.assert_allclose(got[g or None], own.T @ own, rtol=1e-9, atol=1e-8)
