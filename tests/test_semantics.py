"""Hand fixtures: window and fill semantics against pandas and worked numbers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelrank.functions.stats import (
    binomial_half_two_sided,
    chi2_1_tail,
    chi2_tail,
    normal_two_sided,
    sample_kurtosis,
    sample_skew,
)
from panelrank.operators import clean, impute, metrics, ml, profile, rollup, significance, windows

START = dt.date(2024, 1, 1)


def panel(spark, values, id_="a", name="x"):
    rows = [(id_, START + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"id string, date date, {name} double")


def column(df, name):
    return df.orderBy("id", "date").toPandas()[name].to_numpy(float)


HOLES = [3.0, None, 4.0, 1.0, 5.0, 9.0, None, 2.0, 6.0, 5.0]


def test_interpolation_multiplies_before_it_divides(spark):
    """Engines agree to the last bit, so a mean of exactly 40 is on the same side of a cut of 40."""
    values = [62.55, None, None, None, None, 36.41, 16.76, 28.91]
    got = column(impute.interpolate_linear(panel(spark, values), ["x"]), "x")
    between = [62.55 + (36.41 - 62.55) * k / 5 for k in range(1, 5)]
    assert list(got) == [62.55, *between, *values[5:]]
    mean = windows.rolling_features(impute.interpolate_linear(panel(spark, [*values, 0.0]), ["x"]), ["x"], aggs=("mean",))
    assert mean.filter("date = '2024-01-09'").first()["x_mean"] == 40.0


def test_interpolation_matches_pandas(spark):
    got = column(impute.interpolate_linear(panel(spark, [None, *HOLES, None]), ["x"]), "x")
    want = pd.Series([None, *HOLES, None], dtype=float).interpolate("linear", limit_direction="both")
    np.testing.assert_allclose(got, want)


def test_fill_is_idempotent(spark):
    once = impute.forward_backward_fill(panel(spark, [None, *HOLES]), ["x"])
    twice = impute.forward_backward_fill(once, ["x"])
    want = pd.Series([None, *HOLES], dtype=float).ffill().bfill()
    np.testing.assert_allclose(column(once, "x"), want)
    np.testing.assert_allclose(column(twice, "x"), want)


@pytest.mark.parametrize("span", [3, 7])
def test_ema_matches_pandas(spark, span):
    long = [float(v) if i % 4 else None for i, v in enumerate(np.sin(np.arange(400)) * 5 + 20)]
    long[100:300] = [None] * 200
    got = column(windows.ema(panel(spark, long), ["x"], (span,)), f"x_ema{span}")
    want = pd.Series(long, dtype=float).ewm(span=span, min_periods=1).mean().shift(1)
    np.testing.assert_allclose(got, want, rtol=1e-12, equal_nan=True)


def test_ewm_std_matches_pandas(spark):
    got = column(windows.ewm_std(panel(spark, HOLES), ["x"]), "x_ewstd")
    series = pd.Series(HOLES, dtype=float)
    want = [series.iloc[max(0, i - 7) : i].ewm(span=7, min_periods=1).std().iloc[-1] if i else np.nan for i in range(len(series))]
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_ewm_mean_matches_pandas(spark):
    got = column(windows.ema_weighted_mean(panel(spark, HOLES), ["x"]), "x_ewmean")
    series = pd.Series(HOLES, dtype=float)
    want = [series.iloc[max(0, i - 7) : i].ewm(span=7, min_periods=1).mean().iloc[-1] if i else np.nan for i in range(len(series))]
    np.testing.assert_allclose(got, want, equal_nan=True)


def test_rolling_fixture(spark):
    rows = windows.rolling_features(panel(spark, HOLES), ["x"], aggs=("median", "trend", "mean"))
    last = rows.orderBy(F.desc("date")).first()
    assert last["x_median"] == 4.5
    assert last["x_trend"] == pytest.approx(0.2795031, abs=1e-7)
    assert rows.count() == len(HOLES) - 7


def test_skew_and_kurtosis(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]], "x double")
    row = df.agg(sample_skew(F.col("x")).alias("s"), sample_kurtosis(F.col("x")).alias("k")).first()
    assert row["s"] == pytest.approx(0.5974377, abs=1e-7)
    assert row["k"] == pytest.approx(0.5980861, abs=1e-7)


def test_gap_runs_of_every_length(spark):
    values = [None, 1, None, None, 1, None, None, None, 1, *[None] * 7, 1, *[None] * 8]
    df = panel(spark, [None if v is None else float(v) for v in values])
    lengths = sorted(r["gap_days"] for r in impute.gap_runs(df, "x").collect())
    assert lengths == [1, 2, 3, 7, 8]
    masked = impute.long_gap_mask(df, "x", 7)
    assert masked.filter("in_long_gap").count() == 8
    assert impute.delete_long_gaps(df, "x", 2).count() == len(values) - 18


def test_momentum_counts_the_opposite_day(spark):
    # changes: +1 +1 -1 -1 -1
    rows = windows.momentum(panel(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.0]), "x")
    last = rows.orderBy(F.desc("date")).first()
    assert (last["up_days"], last["down_days"], last["reversal"]) == (1, 3, 1)
    clean_stop = windows.momentum(panel(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.0]), "x", exact=False)
    last = clean_stop.orderBy(F.desc("date")).first()
    assert (last["up_days"], last["down_days"]) == (0, 3)


def test_rollup_of_missing_values(spark):
    rows = [
        ("a", START, "m", None),
        ("a", START, "s", None),
        ("a", START, "c", None),
        ("a", START + dt.timedelta(days=1), "m", 4.0),
    ]
    df = spark.createDataFrame(rows, "id string, date date, variable string, value double")
    rules = {"m": ("m", "mean"), "s": ("s", "sum"), "c": ("c", "count")}
    first, second = rollup.daily_rollup(df, rules).orderBy("date").collect()
    assert (first["m"], first["s"], first["c"]) == (None, 0.0, 0.0)
    assert (second["m"], second["s"], second["c"]) == (4.0, None, None)
    with pytest.raises(ValueError):
        rollup.daily_rollup(df, {"m": ("m", "mode")})


def test_bounds_keep_missing(spark):
    df = panel(spark, [None, -1.0, 0.5, 2.0])
    got = column(clean.null_out_of_range(df, {"x": (0, 1)}), "x")
    np.testing.assert_allclose(got, [np.nan, np.nan, 0.5, np.nan], equal_nan=True)
    capped = column(clean.cap_values(df, ["x"], 1.0), "x")
    np.testing.assert_allclose(capped, [np.nan, -1, 0.5, 1.0], equal_nan=True)
    logged = column(clean.log1p_columns(df, ["x"]), "x")
    np.testing.assert_allclose(logged, [np.nan, 0.0, math.log(1.5), math.log(3)], equal_nan=True)


def brute_knn(values, k):
    """Column by column, row by row: mean over the k nearest rows that hold the column."""
    out = values.copy()
    for i, row in enumerate(values):
        for j in np.flatnonzero(np.isnan(row)):
            found = []
            for n, other in enumerate(values):
                both = ~np.isnan(row) & ~np.isnan(other)
                if n != i and not np.isnan(other[j]) and both.any():
                    gap = ((row[both] - other[both]) ** 2).sum() * len(row) / both.sum()
                    found.append((round(gap, 9), n, other[j]))
            near = [v for _, _, v in sorted(found)[:k]]
            out[i, j] = np.mean(near) if near else np.nanmean(values[:, j])
    return out


def test_knn_imputation_against_brute_force(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 4)).round(3)
    values[rng.random(values.shape) < 0.3] = np.nan
    rows = [("a", START + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, date date, p double, q double, r double, s double")
    got = impute.impute_knn(df, ["p", "q", "r", "s"], 3).orderBy("date").toPandas()
    np.testing.assert_allclose(got[["p", "q", "r", "s"]], brute_knn(values, 3))


def test_regression_imputation_recovers_a_linear_relation(spark):
    rows = []
    for i in range(30):
        x = float(i % 7)
        rows.append(("a", START + dt.timedelta(days=i), x, None if i % 5 == 0 else 2 * x + 1))
    df = spark.createDataFrame(rows, "id string, date date, x double, y double")
    got = impute.impute_regression(df, ["x", "y"]).toPandas()
    np.testing.assert_allclose(got["y"], 2 * got["x"] + 1, atol=1e-2)


def groups_table(spark, rows):
    return spark.createDataFrame(rows, "g int, i int, rel int, score double")


def brute_ndcg(rel, score, k=5):
    order = sorted(range(len(rel)), key=lambda i: (-score[i], i))
    gain = sum(rel[i] / math.log2(p + 2) for p, i in enumerate(order[:k]))
    best = sum(r / math.log2(p + 2) for p, r in enumerate(sorted(rel, reverse=True)[:k]))
    return gain / best if best else 0.0


def test_ndcg_edge_groups(spark):
    cases = {
        1: ([0, 0, 0], [3.0, 2.0, 1.0]),
        2: ([1, 0, 5], [0.1, 0.2, 0.3]),
        3: ([5, 0, 1, 1, 0, 1, 5], [1.0] * 7),
        4: ([1, 1, 1, 5, 5, 5, 5], [7.0, 6, 5, 4, 3, 2, 1]),
    }
    rows = [(g, i, r, float(s)) for g, (rel, score) in cases.items() for i, (r, s) in enumerate(zip(rel, score))]
    got = {r["g"]: r["ndcg"] for r in metrics.ndcg_per_group(groups_table(spark, rows), ["g"], "rel", "score", ["i"]).collect()}
    for g, (rel, score) in cases.items():
        assert got[g] == pytest.approx(brute_ndcg(rel, score))
    shuffled = groups_table(spark, rows[::-1]).repartition(5)
    again = {r["g"]: r["ndcg"] for r in metrics.ndcg_per_group(shuffled, ["g"], "rel", "score", ["i"]).collect()}
    assert again == pytest.approx(got)


def test_tail_probabilities(spark):
    row = spark.range(1).select(
        chi2_1_tail(F.lit(3.841458820694124)).alias("a"),
        normal_two_sided(F.lit(-1.959963984540054)).alias("b"),
        binomial_half_two_sided(F.lit(2), F.lit(10)).alias("c"),
        chi2_tail(F.lit(18.307038053275146), F.lit(10.0)).alias("d"),
        chi2_tail(F.lit(2.0), F.lit(5.0)).alias("e"),
    ).first()
    assert row["a"] == pytest.approx(0.05)
    assert row["b"] == pytest.approx(0.05)
    assert row["c"] == pytest.approx(0.109375)
    assert row["d"] == pytest.approx(0.05)
    assert row["e"] == pytest.approx(0.8491450)


def test_wilcoxon_with_ties(spark):
    d = [1.0, -1.0, 2.0, 3.0, 0.0, -2.0, 4.0]
    df = spark.createDataFrame([(v, 0.0) for v in d], "a double, b double")
    row = significance.wilcoxon_signed_rank(df, "a", "b").first()
    assert (row["pairs"], row["w_plus"], row["w_minus"]) == (6, 1.5 + 3.5 + 5 + 6, 1.5 + 3.5)


def test_pacf_of_first_order_series(spark):
    rng = np.random.default_rng(0)
    x = [0.0]
    for _ in range(400):
        x.append(0.7 * x[-1] + float(rng.normal()))
    got = {r["lag"]: r["pacf"] for r in profile.pacf_per_id(panel(spark, x), "x", 5).collect()}
    assert got[1] == pytest.approx(0.7, abs=0.1)
    assert all(abs(got[k]) < 0.15 for k in (2, 3, 4, 5))


def test_constant_columns_have_no_correlation(spark):
    df = panel(spark, [1.0] * 12).withColumn("y", F.dayofmonth("date").cast("double"))
    assert profile.correlation_pairs(df, ["x", "y"]).first()["r"] is None
    flat = windows.rolling_autocorr(panel(spark, [1.0] * 12), "x")
    assert set(column(flat, "x_autocorr1")) == {0.0}


def test_exact_binomial_tail_against_plain_sums():
    from math import comb

    from panelrank.functions import stats

    tail = stats.binomial_half_two_sided.func
    for n in (0, 1, 2, 3, 7, 20, 101, 400):
        for k in range(0, n + 1, max(1, n // 13)):
            want = min(1.0, 2 * sum(comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
            assert abs(tail(k, n) - want) <= 1e-12 + 1e-9 * want, (k, n)
    assert 0.9 < tail(500_000_000, 1_000_000_001) <= 1.0
    assert 0.0 <= tail(499_900_000, 1_000_000_000) < 1e-8


def test_model_of_a_column_that_is_constant_in_training(spark):
    """Its spread is zero, not a last bit, so it says nothing about the rows after."""
    y = [31.7, 55.13, 42.9, 18.37, 77.1, 60.03, 25.61, 39.99, 48.2, 71.3, 12.9, 33.33, 40.1, 52.0, 61.7]
    x = [0.1] * 12 + [0.1, 0.5, 0.9]
    rows = [("a", START + dt.timedelta(days=i), *v) for i, v in enumerate(zip(x, y))]
    rows += [(None, START, 1.0, 2.0), ("b", START, 1.0, None)]
    table = spark.createDataFrame(rows, "id string, date date, x double, y double")
    got = {r["id"]: r for r in ml.per_id_models(table, ["x"], "y").collect()}
    assert set(got) == {"a", None} and got[None]["reason"] == "too few rows"
    assert got["a"]["n_train"] == 12 and got["a"]["n_test"] == 3 and got["a"]["reason"] is None
    np.testing.assert_allclose(got["a"]["mse"], got["a"]["baseline_mse"], rtol=1e-12)
    np.testing.assert_allclose(got["a"]["baseline_mse"], np.mean((np.array(y[12:]) - np.mean(y[:12])) ** 2))
