"""Properties of priors, splits, segments and sweeps."""

import pytest
from pyspark.sql import functions as F

from panelrank.operators import groups, metrics, rules, splits

SCHEMA = "srch int, item int, fold int, clicked int"


def test_prior_never_sees_its_own_fold(spark):
    rows = [(s, s % 4, s % 5, (s * 3) % 2) for s in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    base = groups.oof_priors(df, ["item"], "fold", {"clicked": 1.0}, rates={"clicked": 0.3})
    flipped = df.withColumn("clicked", F.when(F.col("fold") == 2, 1 - F.col("clicked")).otherwise(F.col("clicked")))
    other = groups.oof_priors(flipped, ["item"], "fold", {"clicked": 1.0}, rates={"clicked": 0.3})
    pick = lambda d: {r["srch"]: r["clicked_rate"] for r in d.filter("fold = 2").collect()}
    assert pick(base) == pick(other)
    outside = lambda d: {r["srch"]: r["clicked_rate"] for r in d.filter("fold <> 2").collect()}
    assert outside(base) != outside(other)


def test_key_of_one_fold_gets_the_overall_rate(spark):
    df = spark.createDataFrame([(1, 7, 0, 1), (2, 7, 0, 1), (3, 8, 1, 0), (4, 7, None, 0), (5, 9, None, 0)], SCHEMA)
    got = {r["srch"]: r for r in groups.oof_priors(df, ["item"], "fold", {"clicked": 1.0}).collect()}
    overall = 2 / 3
    assert got[1]["clicked_rate"] == pytest.approx(overall)
    assert got[1]["impressions_log1p"] == 0.0
    assert got[4]["clicked_rate"] == pytest.approx((2 + 20 * overall) / 22)
    assert got[5]["clicked_rate"] == pytest.approx(overall)
    assert len(got) == 5


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("g"))
    row = splits.check_split(splits.split_groups(df, "g"), "g").first()
    assert (row["groups"], row["torn_groups"], row["unassigned_rows"]) == (400, 0, 0)
    sizes = {r["part"]: r["n"] for r in splits.split_groups(df, "g").groupBy("part").agg(F.count_distinct("g").alias("n")).collect()}
    assert 280 < sizes["train"] < 360 and sum(sizes.values()) == 400


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 10.0, 10.5, 40.0, 41.0)], "x double")
    label = groups.bin_right_closed(F.col("x"), [0, 10, 20, 40], ["a", "b", "c"])
    assert [r[0] for r in df.select(label).collect()] == [None, "a", "a", "b", "c", None]


def test_bootstrap_weights_have_mean_one(spark):
    df = spark.range(3000).select(F.col("id").alias("key"))
    got = splits.bootstrap_weights(df, ["key"], 5).groupBy("replicate").agg(F.avg("weight").alias("m")).collect()
    assert len(got) == 5 and all(0.93 < r["m"] < 1.07 for r in got)


def test_class_scores_with_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    counts = metrics.confusion_counts(df, "t", "p")
    scores = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.class_scores(counts).collect()}
    assert scores[2] == (0.0, 0.0, 0.0)
    assert scores[0] == (1.0, 0.5, pytest.approx(2 / 3))
    report = metrics.classification_report(counts).first()
    assert (report["n"], report["accuracy"]) == (4, 0.5)
    assert report["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_short_groups_still_divide_exposure_by_k(spark):
    rows = [(1, 0, 1, 2.0, "low"), (1, 1, 0, 1.0, "high")]
    df = spark.createDataFrame(rows, "g int, i int, rel int, score double, seg string")
    row = metrics.segment_metrics(df, ["g"], "rel", "score", "seg", ["i"]).first()
    assert (row["seg"], row["groups"], row["exposure"], row["supported"]) == ("low", 1, 0.2, False)


def test_lambda_rule_prefers_the_strongest_admissible(spark):
    rows = []
    for g in range(20):
        for i in range(8):
            seg = "high" if i < 5 else ("low" if i < 7 else "medium")
            rows.append((g, i, 1 if i in (0, 5, 7) else 0, 10.0 - i, seg))
    df = spark.createDataFrame(rows, "g int, i int, rel int, score double, seg string")
    boosts = {"low": 5.0, "medium": 5.0, "high": 0.0}
    loose = metrics.lambda_sweep(df, ["g"], "rel", "score", "seg", boosts, ["i"], (0.0, 0.5, 5.0), tolerance=1.0)
    assert [r["lambda"] for r in loose.filter("chosen").collect()] == [5.0]
    strict = metrics.lambda_sweep(df, ["g"], "rel", "score", "seg", boosts, ["i"], (0.0, 0.01), tolerance=0.0)
    assert [r["lambda"] for r in strict.filter("chosen").collect()] == [0.0]


def test_redundant_generalisation_is_dropped(spark):
    tree = spark.createDataFrame([("cola", "drink"), ("tea", "drink")], "item string, ancestor string")
    found = spark.createDataFrame(
        [
            (["cola"], "bread", 0.50, 1.2, 0.100),
            (["drink"], "bread", 0.51, 1.2, 0.105),
            (["drink"], "jam", 0.30, 1.1, 0.200),
            (["cola"], "drink", 1.00, 2.0, 0.200),
        ],
        "antecedent array<string>, consequent string, confidence double, lift double, support double",
    )
    kept = {(r["antecedent"][0], r["consequent"]) for r in rules.drop_redundant_rules(found, tree).collect()}
    assert kept == {("cola", "bread"), ("drink", "jam")}
