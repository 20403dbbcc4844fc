"""Paths for data beyond one task, and the shape of physical plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrank.operators import groups, metrics, ml, neighbours, profile, scale, significance, splits, windows
from panelrank.queries.panel import cleaned, COLS
from panelrank.queries.ranking import TIE, interactions
from panelrank.queries.registry import rounded
from tests.conftest import SMALL


def same(a, b):
    cols = sorted(a.columns)
    left = sorted(map(tuple, rounded(a).select(*cols).collect()), key=repr)
    right = sorted(map(tuple, rounded(b).select(*cols).collect()), key=repr)
    assert left == right


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, with ties and missing values."""
    n = F.col("id")
    return spark.range(3000).select(
        F.when(n % 3 == 0, 0).otherwise(n % 50).cast("int").alias("g"),
        n.alias("row"),
        F.when(n % 11 != 0, (n * 7919 % 97).cast("double")).alias("x"),
    )


def test_running_total_in_slices(spark, skewed):
    small = scale.running_total(skewed, ["g"], ["row"], F.lit(2), "t")
    sliced = scale.running_total(skewed, ["g"], ["row"], F.lit(2), "t", limit=0)
    same(small, sliced)
    whole = scale.running_total(skewed, [], [F.desc("row")], F.lit(1), "t", limit=0)
    assert whole.filter(F.col("t") + F.col("row") != 2999).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_in_slices(spark, skewed, by):
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    small = scale.quantiles(skewed, ["x", "row"], probs, by=by)
    sliced = scale.quantiles(skewed, ["x", "row"], probs, by=by, limit=0)
    flat = lambda d: d.select(*by, "column", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(5)])
    same(flat(small), flat(sliced))


@pytest.mark.parametrize("descending", [False, True])
def test_rank_of_oversized_groups(spark, skewed, descending):
    large = scale.oversized_groups(skewed, ["g"], most=500, limit=0)
    assert [r["g"] for r in large.collect()] == [0]
    plain = scale.rank_in_group(skewed, ["g"], "x", "r", descending)
    split = scale.rank_in_group(skewed, ["g"], "x", "r", descending, oversized=large)
    same(plain, split)
    assert split.count() == 3000


def test_no_oversized_groups(spark, skewed):
    assert scale.oversized_groups(skewed, ["g"]) is None
    assert scale.oversized_groups(skewed, ["g"], most=10_000, limit=0) is None


def test_whole_table_orders_in_slices(spark):
    panel = cleaned(spark, SMALL)
    same(profile.acf_pooled(panel, "mood"), profile.acf_pooled(panel, "mood", limit=0))
    rows = panel.select("id", "date")
    same(
        splits.tail_validation(rows, ["id", "date"]),
        splits.tail_validation(rows, ["id", "date"], limit=0),
    )
    df = spark.range(500).select(
        F.col("id").alias("key"),
        (F.col("id") % 17).cast("double").alias("y"),
        (F.col("id") % 5).cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
    )
    same(
        metrics.hardest_share(df, "y", "a", "b", ["key"]),
        metrics.hardest_share(df, "y", "a", "b", ["key"], limit=0),
    )
    same(
        significance.wilcoxon_signed_rank(df, "a", "b"),
        significance.wilcoxon_signed_rank(df, "a", "b", limit=0),
    )
    same(profile.group_size_ecdf(df, ["y"]), profile.group_size_ecdf(df, ["y"], limit=0))


def test_acf_blocks_overlap(spark, monkeypatch):
    panel = cleaned(spark, SMALL)
    whole = profile.acf_pooled(panel, "mood").collect()
    monkeypatch.setattr(profile, "ACF_BLOCK", 32)
    blocks = profile.acf_pooled(panel, "mood").collect()
    np.testing.assert_allclose([r["r"] for r in whole], [r["r"] for r in blocks])


def brute_nearest(queries, points, k, exclude):
    out = {}
    for q, *a in queries:
        found = sorted(
            (round(float(np.sqrt(sum((u - v) ** 2 for u, v in zip(a, b)))), 9), p)
            for p, *b in points
            if not (exclude and p == q)
        )
        out[q] = found[:k]
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_rows_against_brute_force(spark, exclude):
    rng = np.random.default_rng(5)
    points = [(i, *map(float, rng.normal(size=3).round(2))) for i in range(300)]
    # A third of all points share one place.
    points = [(i, 0.5, 0.5, 0.5) if i % 3 == 0 else (i, *p) for i, *p in points]
    df = spark.createDataFrame(points, "key long, a double, b double, c double")
    queries = df if exclude else df.filter("key < 60")
    got = neighbours.nearest_rows(
        queries, df, ["a", "b", "c"], 4, "key", "key",
        exclude_same=exclude, pivots=12, block_points=25, block_queries=20,
    )
    found = {}
    for r in got.orderBy("key", "place").collect():
        found.setdefault(r["key"], []).append((r["distance"], r["neighbour"]))
    asked = points if exclude else points[:60]
    assert found == brute_nearest(asked, points, 4, exclude)


def test_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "key long, a double")
    got = neighbours.nearest_rows(df, df, ["a"], 5, "key", "key", exclude_same=True)
    assert sorted((r["key"], r["neighbour"]) for r in got.collect()) == [(1, 2), (2, 1)]


def test_nearest_rows_with_holes_against_brute_force(spark):
    rng = np.random.default_rng(8)
    points = []
    for i in range(160):
        row = [float(x) if rng.random() > 0.15 else None for x in rng.normal(size=3).round(2)]
        points.append((i, *row))
    points += [(900, None, None, None), (901, 0.1, None, None)]
    df = spark.createDataFrame(points, "key long, a double, b double, c double")

    def gap(p, q):
        both = [(u - v) ** 2 for u, v in zip(p[1:], q[1:]) if u is not None and v is not None]
        return round(float(np.sqrt(sum(both) * 3 / len(both))), 9) if both else None

    want = {}
    for q in points:
        found = sorted((gap(q, p), p[0]) for p in points if p[0] != q[0] and gap(q, p) is not None)
        want[q[0]] = [p for _, p in found[:4]]
    for sizes in ({}, {"pivots": 8, "block_points": 20, "block_queries": 30}):
        got = neighbours.nearest_rows(df, df, ["a", "b", "c"], 4, "key", "key", exclude_same=True, **sizes)
        found = {}
        for r in got.orderBy("key", "place").collect():
            found.setdefault(r["key"], []).append(r["neighbour"])
        assert found == {q: near for q, near in want.items() if near}
    only_holes = df.filter("key = 901")
    assert neighbours.nearest_rows(df, only_holes, ["a", "b", "c"], 1, "key", "key").count() > 0


def test_smote_copies_a_class_of_one_row(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "a", 2.0), (4, "b", 7.0), (5, None, 1.0)], "key long, y string, x double")
    made = neighbours.smote(df, ["x"], "y", "key", k=2)
    assert sorted(map(tuple, made.collect())) == [(4, 1, "b", 7.0), (4, 2, "b", 7.0)]


def test_smote_balances_classes(spark):
    df = spark.range(60).select(
        F.col("id").alias("key"),
        F.when(F.col("id") < 40, "big").when(F.col("id") < 53, "mid").otherwise("few").alias("y"),
        F.col("id").cast("double").alias("a"),
    )
    made = neighbours.smote(df, ["a"], "y", "key", k=3)
    per_class = {r["y"]: r["count"] for r in made.groupBy("y").count().collect()}
    assert set(per_class) == {"mid", "few"}
    # Copies are exact in whole multiples and drawn for the remainder.
    assert 26 <= per_class["mid"] <= 39 and 28 <= per_class["few"] <= 35
    ends = made.groupBy("y").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).collect()
    bounds = {"mid": (40, 52), "few": (53, 59)}
    assert all(bounds[r["y"]][0] <= r["lo"] and r["hi"] <= bounds[r["y"]][1] for r in ends)


def test_rolling_features_need_one_exchange_by_id(spark):
    panel = cleaned(spark, SMALL)
    base = plan(panel).count("Exchange hashpartitioning(id")
    built = plan(windows.rolling_features(panel, COLS))
    assert built.count("Exchange hashpartitioning(id") == base
    assert "CartesianProduct" not in built and "NestedLoop" not in built


def test_top_k_is_limited_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scale, "fits_one_task", lambda *_: False)
    rows = interactions(spark, SMALL)
    text = plan(metrics.ndcg_per_group(rows, ["srch"], "rel", "score_b", TIE))
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(metrics.ndcg_per_group(interactions(spark, SMALL), ["srch"], "rel", "score_b", TIE))
    for unused in ("l_extendedprice", "l_tax", "l_shipdate"):
        assert unused not in text


@pytest.fixture(scope="module")
def holes(spark):
    """Groups, a missing group among them, with ties and missing values."""
    n = F.col("id")
    return spark.range(600).select(
        F.when(n % 3 != 0, (n % 4).cast("int")).alias("g"),
        n.alias("row"),
        F.when(n % 11 != 0, (n * 7919 % 97).cast("double")).alias("x"),
    )


@pytest.mark.parametrize("limit", [scale.SMALL_BYTES, 0])
def test_a_missing_group_is_a_group(spark, holes, limit):
    table = holes.toPandas()
    codes = table["g"].fillna(-1)
    total = scale.running_total(holes, ["g"], ["row"], F.lit(1), "t", limit=limit).toPandas()
    assert len(total) == 600
    assert total.sort_values("row")["t"].tolist() == table.groupby(codes).cumcount().tolist()
    middle = scale.quantiles(holes, ["x"], [0.5], by=["g"], limit=limit).collect()
    want = table.groupby(codes)["x"].median()
    assert {(-1 if r["g"] is None else r["g"]): r["q"][0] for r in middle} == want.to_dict()
    boxes = profile.boxplot_stats(holes, ["g"], "x")
    assert boxes.count() == 5


def test_a_missing_group_in_ranks_and_statistics(spark, holes):
    large = scale.oversized_groups(holes, ["g"], most=150, limit=0)
    assert [r["g"] for r in large.collect()] == [None]
    same(
        scale.rank_in_group(holes, ["g"], "x", "r"),
        scale.rank_in_group(holes, ["g"], "x", "r", oversized=large),
    )
    stats = scale.with_group_stats(holes, ["g"], {"m": F.avg("x")})
    assert stats.count() == 600 and stats.filter("m IS NULL").count() == 0
    named = holes.select(F.col("g").cast("string").alias("variable"), F.col("x").alias("value"))
    assert profile.variable_stats(named).filter("median IS NULL").count() == 0


@pytest.mark.parametrize("limit", [scale.SMALL_BYTES, 0])
def test_hardest_share_counts_usable_rows_only(spark, limit):
    n = F.col("id")
    df = spark.range(100).select(
        n.alias("key"),
        F.when(n % 10 != 0, n.cast("double")).alias("y"),
        F.lit(0.0).alias("a"),
        F.lit(1.0).alias("b"),
    )
    got = {r["hard"]: r for r in metrics.hardest_share(df, "y", "a", "b", ["key"], limit=limit).collect()}
    assert got[True]["n"] == 9 and got[False]["n"] == 81
    assert got[True]["mse_first"] == sum(k * k for k in range(91, 100)) / 9
    nothing = df.filter("y IS NULL")
    assert metrics.hardest_share(nothing, "y", "a", "b", ["key"], limit=limit).count() == 0


def test_r2_of_a_large_target_with_a_small_spread(spark):
    df = spark.range(100).select((F.col("id") % 3 + 1e9).alias("y"), (F.col("id") % 3 + 1e9).alias("p"))
    assert metrics.regression_report(df, F.col("y"), F.col("p")).first()["r2"] == 1.0


def test_lookup_join_counts_before_it_broadcasts(spark, skewed, monkeypatch):
    lookup = skewed.groupBy("g").agg(F.avg("x").alias("m"))
    small = scale.join_lookup(skewed, lookup, ["g"])
    monkeypatch.setattr(scale, "fits_one_task", lambda *_: False)
    counted = scale.join_lookup(skewed, lookup, ["g"])
    assert "BroadcastHashJoin" in plan(counted)
    same(small, counted)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    same(small, scale.join_lookup(skewed, lookup, ["g"]))


@pytest.mark.parametrize("name", ["oof_priors", "iqr_filter_long", "segment_metrics", "ranking_features", "iqr_filter", "top_k_or_tail"])
def test_queries_on_the_large_path(spark, duck, name, monkeypatch):
    """Every size check answers "large": the results must not change."""
    from check import differences

    from panelrank.queries import oracles, spark_queries

    want = spark_queries()[name](spark, SMALL).toPandas() if name not in oracles() else duck.execute(oracles()[name]).df()
    monkeypatch.setattr(scale, "fits_one_task", lambda *_: False)
    got = spark_queries()[name](spark, SMALL).toPandas()
    assert differences(got, want) is None


def test_blends_move_their_rows_once(spark, monkeypatch):
    """One exchange by page whatever the number of weights; large pages give the same means."""
    rows = interactions(spark, SMALL)
    args = (["srch"], "rel", ["score_a", "score_c"], "score_b", TIE, (0.0, 0.25, 0.5, 1.0))
    found = metrics.blend_sweep(rows, *args)
    assert "explode" not in plan(found) and len(re.findall(r"Exchange hashpartitioning\(srch", plan(found))) <= 1
    monkeypatch.setattr(scale, "fits_one_task", lambda *_: False)
    for largest in (1, 4, 6, 1000):
        same(found, metrics.blend_sweep(rows, *args, largest=largest))


def exchanges(df):
    return len(re.findall(r"Exchange (hash|range)partitioning", plan(df)))


def all_oversized(df, keys, *_):
    return df.select(*keys).distinct()


def test_group_features_stay_where_the_rows_lie(spark, skewed):
    rows = skewed.repartition(4, "g")
    found = groups.within_group_features(rows, ["g"], "row", ["x"])
    assert exchanges(found) == exchanges(rows)
    same(found, groups.within_group_features(rows, ["g"], "row", ["x"], oversized=all_oversized(rows, ["g"])))


def test_submission_moves_its_rows_once(spark, skewed, monkeypatch):
    small = metrics.rank_submission(skewed, "g", "row", "x", ["row"])
    monkeypatch.setattr(scale, "fits_one_task", lambda *_: False)
    found = metrics.rank_submission(skewed, "g", "row", "x", ["row"])
    assert exchanges(found) == 1
    monkeypatch.setattr(scale, "oversized_groups", all_oversized)
    sliced = metrics.rank_submission(skewed, "g", "row", "x", ["row"])
    assert small.collect() == found.collect() == sliced.collect()


def test_contrasts_move_their_rows_once(spark, skewed, monkeypatch):
    rows = skewed.withColumn("rel", (F.col("row") % 5 == 0).cast("int")).fillna(0.0).cache()
    found = ml.contrast_rows(rows, ["g"], ["x", "row"], "rel")
    assert exchanges(found) == 1
    monkeypatch.setattr(scale, "oversized_groups", all_oversized)
    same(found, ml.contrast_rows(rows, ["g"], ["x", "row"], "rel"))


def test_priors_of_pairs_that_occur_once_need_no_row(spark):
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 2).alias("hit"))
    attached = groups.oof_sums(rows, ["id"], "fold", {"hit": 1.0})
    assert attached.filter("_n IS NOT NULL").count() == 0
    got = groups.oof_priors(rows, ["id"], "fold", {"hit": 1.0}, rates={"hit": 0.3})
    assert {(r["impressions_log1p"], round(r["hit_rate"], 9)) for r in got.collect()} == {(0.0, 0.3)}


def test_distances_held_do_not_grow_with_pivots():
    import pandas as pd

    frame = pd.DataFrame({"x": range(10_000)})
    for others in (0, 1, 64, 980, 4096, 3_000_000):
        parts = list(neighbours._slices(frame, others))
        assert pd.concat(parts).equals(frame)
        assert all(len(p) * others <= max(neighbours.HELD, others) for p in parts)
