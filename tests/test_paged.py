"""Pages gathered once against the same work on plain rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrank.operators import metrics, ml, paged, ranker, scale

COLS = ["a", "b"]
WEIGHTS = {"a": 0.7, "b": -1.5}


def table(spark, seed=4):
    """Pages of many sizes, one without an id; some rows come twice, some with another score, some without a grade."""
    r = random.Random(seed)
    rows = []
    for g in range(50):
        for line in range(r.choice([1, 2, 4, 9, 30])):
            rel = r.choice([None, 0, 0, 0, 1, 5])
            row = (g or None, "odd" if g % 2 else "even", line or None, rel, round(r.gauss(0, 1), 1), round(r.random(), 2))
            rows.append(row)
            if r.random() < 0.2:
                rows.append((*row[:4], row[4] + r.choice([0, 0.5]), row[5]))
    return spark.createDataFrame(rows, "g long, part string, line int, rel int, a double, b double").repartition(3)


def arranged(rows, most):
    return paged.arrange(rows, ["g"], COLS, "rel", ["line"], keep=["part"], most=most)


@pytest.fixture(params=[1000, 5])
def both(spark, request, monkeypatch):
    rows = scale.cut_lineage(table(spark))
    monkeypatch.setattr(scale, "fits_one_task", lambda df, limit=0: False)
    pages = arranged(rows, request.param)
    assert (pages.large is None) == (request.param == 1000)
    return rows, pages


@pytest.mark.parametrize("k, weights", [(5, WEIGHTS), (2, {"a": -0.2, "b": 0.9}), (50, {"a": 3.0})])
def test_gradient_equals_plain_pairs(both, k, weights):
    rows, pages = both
    want = ranker.gradient(ranker.pairs(rows, ["g"], COLS, "rel", ["line"], weights, k), COLS).collect()
    got = ranker.page_gradient(pages, weights, k).collect()
    order = lambda r: r["column"]
    for x, y in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert (x["column"], x.pairs) == (y["column"], y.pairs) and x.pairs > 50
        assert np.allclose(x[1:2] + x[3:], y[1:2] + y[3:])


def test_ndcg_equals_plain(both):
    rows, pages = both
    scored = rows.withColumn("score", ml.linear_score(WEIGHTS))
    want = metrics.ndcg_per_group(scored, ["part", "g"], "rel", "score", ["line"])
    for part in ("odd", "even"):
        x = ranker.page_ndcg(pages.filter(F.col("part") == part), WEIGHTS).toPandas()["ndcg"]
        y = want.filter(F.col("part") == part).toPandas()["ndcg"]
        assert np.allclose(np.sort(x), np.sort(y)) and len(x) > 20


def test_contrasts_equal_plain(both):
    rows, pages = both
    want = np.array(sorted(map(tuple, ml._contrasts(rows, ["g"], COLS, "rel").collect())))
    got = paged.contrasts(pages, ml.WEIGHT)
    if pages.large is not None:
        got = got.union(ml._contrasts(pages.large, ["g"], COLS, "rel"))
    assert np.allclose(np.array(sorted(map(tuple, got.collect()))).sum(0), want.sum(0)) and got.count() == len(want) > 20
    assert ml.fit_ranker(pages, ["g"], COLS, "rel") == pytest.approx(ml.fit_ranker(rows, ["g"], COLS, "rel"))


def test_steps_move_no_rows(spark, monkeypatch):
    """Rows are shuffled by page once, not in every step."""
    rows = scale.cut_lineage(table(spark))
    for module, name in ((ranker, "pairs"), (metrics, "ndcg"), (metrics, "ndcg_per_group")):
        monkeypatch.setattr(module, name, lambda *a, **k: pytest.fail(f"{name} moves rows"))
    weights, history = ranker.fit(rows, rows, ["g"], COLS, "rel", ["line"], steps=2)
    assert len(history) == 3
    plan = ranker.page_gradient(arranged(rows, 1000), weights)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == plan.count("hashpartitioning(place#") > 0


def test_empty_pages(spark):
    pages = arranged(table(spark).limit(0), 1000)
    assert ranker.page_ndcg(pages, WEIGHTS).count() == 0
    assert [r.pairs for r in ranker.page_gradient(pages, WEIGHTS).collect()] == [0, 0]


def test_shuffles_go_with_their_job(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with scale.shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
        found = scale.cut_lineage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(name) == before and found.count() == 7
