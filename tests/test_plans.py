"""Compositions agree with the single operators they are made of."""

import pytest
from pyspark.sql import functions as F

from panelrank.operators import ml, scale, windows
from panelrank.plans.cleaning import CleanOptions, clean_daily
from panelrank.plans.instances import build_instances
from panelrank.queries.models import FEATURES, ROLES
from panelrank.queries.panel import COLS, interpolated, measurements
from panelrank.queries.registry import rounded
from tests.conftest import SMALL


def test_instances_match_single_operators(spark):
    panel = interpolated(spark, SMALL)
    built = build_instances(panel, FEATURES)
    singles = {
        "volatility": windows.volatility(panel, "mood"),
        "momentum": windows.momentum(panel, "mood"),
        "ema": windows.ema(panel, ["mood", "strain", "spend"]),
        "autocorr": windows.rolling_autocorr(panel, "mood"),
        "rmssd": windows.rmssd(panel, "mood"),
        "adaptive": windows.adaptive_direction(panel, "mood"),
        "rolling": windows.rolling_features(panel, COLS),
        "missing": windows.missing_share(panel, COLS),
    }
    for name, single in singles.items():
        made = [c for c in single.columns if c not in ("id", "date", *COLS)]
        keys = built.select("id", "date")
        want = rounded(single.join(keys, ["id", "date"]).select("id", "date", *made))
        got = rounded(built.select("id", "date", *made))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name


@pytest.mark.parametrize("imputation", ["ffill", "linear", "knn", "hybrid", "regression", "none"])
def test_cleaned_panel_has_no_holes(spark, imputation):
    options = CleanOptions(
        **ROLES,
        outliers="zscore",
        outlier_cols=["spend"],
        mark_gaps_over=5,
        conditional_fill_min=2,
        imputation=imputation,
        density_merge_into="spend",
        density=0.3,
    )
    df = clean_daily(measurements(spark, SMALL), options)
    assert "in_long_gap" in df.columns
    assert df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in COLS]).first().asDict() == dict.fromkeys(COLS, 0)


def test_unknown_methods_raise(spark):
    rows = measurements(spark, SMALL)
    with pytest.raises(ValueError):
        clean_daily(rows, CleanOptions(**ROLES, outliers="guess"))
    with pytest.raises(ValueError):
        clean_daily(rows, CleanOptions(**ROLES, imputation="guess"))
    with pytest.raises(ValueError):
        ml.estimator("boosting", "ranking")


def test_forward_selection_finds_the_used_columns(spark):
    df = spark.range(400).select(
        *[((F.col("id") * p) % 97 / 97).alias(c) for c, p in (("a", 7), ("b", 11), ("c", 13), ("d", 29))]
    )
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("c") + 1)
    steps = ml.forward_selection(df, df, ["a", "b", "c", "d"], "y", "a").collect()
    assert [r["column"] for r in steps][:2] == ["a", "c"]
    assert steps[1]["mse"] < 1e-6


def test_ranker_learns_the_sign(spark):
    df = spark.range(600).select(
        (F.col("id") % 60).alias("g"),
        ((F.col("id") * 37) % 101 / 101).alias("a"),
        ((F.col("id") * 53) % 103 / 103).alias("b"),
    )
    df = df.withColumn("rel", F.when(F.col("a") - F.col("b") > 0.5, 5).otherwise(0))
    weights = ml.fit_ranker(df, ["g"], ["a", "b"], "rel")
    assert weights["a"] > 0 > weights["b"]


def test_clusters_are_read_not_made_again(spark):
    clusters = ml.cluster_ids(interpolated(spark, SMALL), COLS)
    assert "Aggregate" not in clusters._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(90).select((F.col("id") % 9).alias("id"), (F.col("id") * 7 % 13).cast("double").alias("x"))
    rows = ml.assemble(rows.withColumn("y", F.col("x") * F.when(F.col("id") < 4, 2).otherwise(-1)), ["x"], "y", keep=["id"])
    sides = spark.range(8).select("id", (F.col("id") >= 4).cast("int").alias("cluster"))
    got = ml.cluster_models(rows, rows, sides, lambda: ml.estimator("ridge", "regression", regParam=0.0))
    assert got.filter("abs(prediction - label) > 1e-6").count() == 0
    assert got.groupBy("cluster").count().orderBy("cluster").collect() == [(0, 40), (1, 40)]


def test_stacked_models_read_written_rows(spark, monkeypatch):
    rows = spark.range(120).select((F.col("id") * 7 % 13).cast("double").alias("x"), "id", (F.col("id") % 3).cast("int").alias("fold"))
    rows = ml.assemble(rows.withColumn("y", 2 * F.col("x") + 1), ["x"], "y", keep=["id", "fold"])
    written, cut = [], scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    ridge = ml.estimator("ridge", "regression", regParam=0.0)
    got = ml.stacking(rows, rows, {"a": ridge}, ridge, "fold", 3, ["id"])
    assert [c for c in written if "features" in c] == [rows.columns] * 2 and ["id", "label", "a"] in written
    assert got.count() == 120 and got.filter("abs(prediction - label) > 1e-3").count() == 0

