"""Chained regressions with estimated penalties, folds and fences against plain versions."""

import datetime as dt

import numpy as np
import pytest

from panelrank.operators import clean, impute, profile, splits, windows


def dense(x, y, steps=300):
    """The same maximum by matrix inverses."""
    n, p = x.shape
    noise, weight, before = 1 / (np.var(y) + np.finfo(float).eps), 1.0, None

    def mean():
        cov = np.linalg.inv(weight * np.eye(p) + noise * x.T @ x)
        return cov, noise * cov @ x.T @ y

    for _ in range(steps):
        cov, w = mean()
        known = p - weight * np.trace(cov)
        weight = (known + 2e-6) / (w @ w + 2e-6)
        noise = (n - known + 2e-6) / (np.sum((y - x @ w) ** 2) + 2e-6)
        if before is not None and np.abs(w - before).sum() < 1e-3:
            break
        before = w
    return mean()[1], weight, noise


@pytest.mark.parametrize("n, p", [(40, 3), (12, 5), (200, 1)])
def test_evidence_equals_matrix_inverses(n, p):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p))
    y = x @ rng.normal(size=p) + rng.normal(size=n)
    x, y = x - x.mean(0), y - y.mean()
    for a, b in zip(impute.evidence_ridge(x, y), dense(x, y)):
        assert np.allclose(a, b, rtol=1e-6)


def test_imputed_values_follow_the_others(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for i in ("p", "q"):
        for d in range(60):
            a = float(rng.normal())
            b, c = 2 * a + 0.01 * float(rng.normal()), None
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            truth[i, day] = b
            rows.append((i, day, a, None if d in (5, 6, 20) or 30 <= d < 40 else b, c))
    panel = spark.createDataFrame(rows, "id string, date date, a double, b double, c double")
    got = {(r.id, r.date): r for r in impute.impute_evidence(panel, ["a", "b", "c"], longest=7).collect()}
    assert len(got) == len(rows)
    for i, day, a, b, _ in rows:
        r = got[i, day]
        d = (day - dt.date(2024, 1, 1)).days
        assert r.a == a and r.c is None or np.isnan(r.c)
        if 30 <= d < 40:
            assert r.b is None
        else:
            assert abs(r.b - truth[i, day]) < 0.1
    kept = impute.impute_evidence(panel, ["a", "b"], longest=None).filter("b IS NULL OR isnan(b)")
    assert kept.count() == 0


def one_by_one(values, rounds=10):
    """A single id's chain of regressions, column by column."""
    missing = np.isnan(values)
    usable = np.flatnonzero(~missing.all(0))
    held, hole = values[:, usable], missing[:, usable]
    if not hole.any():
        return values
    full = np.where(hole, np.nanmean(held, axis=0), held)
    limit = 1e-3 * np.max(np.abs(held[~hole]))
    for _ in range(rounds if len(usable) > 1 else 0):
        before = full.copy()
        for j in np.argsort(hole.sum(0), kind="stable"):
            gaps, x = hole[:, j], np.delete(full, j, axis=1)
            if gaps.any():
                middle, mean = x[~gaps].mean(0), full[~gaps, j].mean()
                beta, _, _ = dense(x[~gaps] - middle, full[~gaps, j] - mean)
                full[gaps, j] = mean + (x[gaps] - middle) @ beta
        if np.max(np.abs(full - before)) < limit:
            break
    out = values.copy()
    out[:, usable] = full
    return out


def table_of_ids(rng, n_ids, rows=40):
    """Ids of 30 to ``rows`` days with holes; every fifth never has one of the columns."""
    ids = []
    for i in range(n_ids):
        v = rng.normal(50, 5, (int(rng.integers(30, rows)), 4))
        v[:, 1] += v[:, 0]
        v[rng.random(v.shape) < 0.15] = np.nan
        if i % 5 == 0:
            v[:, i % 4] = np.nan
        ids.append(v)
    return ids


def test_ids_filled_side_by_side_equal_one_by_one():
    ids = table_of_ids(np.random.default_rng(7), 60)
    ids[3][:], ids[4] = np.nan, ids[4][:1]
    starts = np.cumsum([0, *[len(v) for v in ids[:-1]]])
    got = np.split(impute.chained_evidence(np.concatenate(ids), starts), starts[1:])
    for a, b in zip(got, ids):
        np.testing.assert_allclose(a, one_by_one(b) if not np.isnan(b).all() else b, rtol=1e-6)


@pytest.mark.parametrize("at_once", [1, 64, 100_000])
@pytest.mark.parametrize("method", ["regression", "evidence", "knn"])
def test_ids_across_batches(spark, monkeypatch, at_once, method):
    monkeypatch.setattr(impute, "ROWS_AT_ONCE", at_once)
    ids = table_of_ids(np.random.default_rng(8), 9)
    start = dt.date(2024, 1, 1)
    rows = [
        (i or None, start + dt.timedelta(days=d), f"{i}-{d}", *[None if np.isnan(x) else float(x) for x in r])
        for i, v in enumerate(ids)
        for d, r in enumerate(v)
    ]
    cols = list("abcd")
    whole = spark.createDataFrame(rows[::-1], "id int, date date, note string, a double, b double, c double, d double")
    made = {
        "regression": lambda df: impute.impute_regression(df, cols),
        "evidence": lambda df: impute.impute_evidence(df, cols, longest=None),
        "knn": lambda df: impute.impute_knn(df, cols),
    }[method]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.note: r for r in made(whole).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for i in range(len(ids)):
        own = made(whole.filter("id IS NULL" if not i else f"id = {i}")).collect()
        assert len(own) == len(ids[i])
        for r in own:
            assert got[r.note][:3] == r[:3]
            np.testing.assert_allclose(
                np.array(got[r.note][3:], float), np.array(r[3:], float), rtol=1e-9
            )


def test_ids_are_spread_after_windows(spark):
    rows = [(i, dt.date(2024, 1, d), float(d), None if d == 2 else 1.0) for i in range(40) for d in (1, 2, 3)]
    panel = spark.createDataFrame(rows, "id int, date date, a double, b double")
    marked = impute.long_gap_mask(panel, "b", 3)
    made = impute.impute_regression(marked, ["a", "b"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    # Without a shuffle of its own the fill keeps the windows' partitions, which are merged by size.
    assert plan.index("MapInArrow") < plan.index("REPARTITION_BY_NUM")


def greedy(sizes, k):
    load = [0] * k
    for n in sorted(sizes, reverse=True):
        load[load.index(min(load))] += n
    return load


@pytest.mark.parametrize("seed", range(4))
def test_balanced_folds_equal_dealing_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 1, 1, 2, 3, 7, 40], size=60) if seed else np.full(13, 3)
    rows = [(f"g{g}" if g else None, i) for g, n in enumerate(sizes) for i in range(n)]
    got = splits.balanced_kfold(spark.createDataFrame(rows, "g string, i long"), "g", 4).collect()
    assert len(got) == len(rows)
    folds = {}
    for r in got:
        assert folds.setdefault(r.g, r.fold) == r.fold
    load = [sum(r.fold == f for r in got) for f in range(4)]
    assert sorted(load) == sorted(greedy(list(sizes), 4))


def test_dealing_large_numbers_at_once():
    plan = splits._dealt([(1, 10**9), (10**6, 3), (7, 11)], 5)
    total = 10**9 + 3 * 10**6 + 77
    load = [0] * 5
    for rows, ends in plan:
        for f, (end, before) in enumerate(zip(ends, [0, *ends])):
            load[f] += rows * (end - before)
    assert sum(load) == total and max(load) - min(load) <= 1


def test_missing_variable_has_its_own_fence(spark):
    rows = [(None, float(v)) for v in [*range(1, 20), 900]] + [("a", 5.0), ("a", 6.0)]
    got = clean.iqr_filter_long(spark.createDataFrame(rows, "variable string, value double"), 1.5)
    kept = sorted(r.value for r in got.collect() if r.variable is None and r.value is not None)
    assert kept == [float(v) for v in range(1, 20)]


def test_correlations_with_holes(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(50, 3, (400, 6))
    x[:, 1] += x[:, 0]
    x[:, 4] = 7.0
    x[:, 5] = np.round(x[:, 0])
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abcdef"))
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame))
    for name, got, want in (
        ("r", profile.correlation_pairs(df, list("abcdef")), frame.corr()),
        ("rho", profile.spearman_matrix(df, list("abcdef")), frame.rank().corr()),
    ):
        for r in got.collect():
            expected = want.loc[r.a, r.b]
            assert (r[name] is None) == (np.isnan(expected) or "e" in (r.a, r.b))
            assert r[name] is None or abs(r[name] - expected) < 1e-9


def test_exponential_mean_keeps_a_huge_early_value(spark):
    import pandas as pd

    values = [1e25, *[float(i % 7) for i in range(150)]]
    rows = [("p", dt.date(2024, 1, 1) + dt.timedelta(days=i), v if i % 9 != 4 else None) for i, v in enumerate(values)]
    got = windows.ema(spark.createDataFrame(rows, "id string, date date, x double"), ["x"], (3, 7, 30))
    found = [r for r in got.orderBy("date").collect()]
    series = pd.Series([r[2] for r in rows], dtype=float)
    for span in (3, 7, 30):
        want = series.ewm(span=span, ignore_na=False).mean().shift(1)
        for r, w in list(zip(found, want))[1:]:
            assert abs(r[f"x_ema{span}"] - w) <= 1e-9 * abs(w)


def test_rows_stay_whole_while_they_take_ranks(spark):
    rows = [(float(i % 13), None if i % 7 == 0 else float(i * i % 101), float(i)) for i in range(500)]
    ranked = profile.average_ranks(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    # Putting rows together again from long ones held a table of all rows in every task.
    assert "Aggregate" not in plan
    got = sorted(tuple(r) for r in ranked.select("c", "a", "b").collect())
    import pandas as pd

    want = pd.DataFrame(rows, columns=["a", "b", "c"]).rank().sort_values("c")
    np.testing.assert_allclose(np.array(got, float), want[["c", "a", "b"]].to_numpy())
