"""Pair weights and gradients against every pair of a page."""

import math
import random

import numpy as np
import pytest

from panelrank.operators import ranker

COLS = ["a", "b"]


def pages(seed=2, n=60):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        for line in range(r.choice([1, 2, 4, 9, 30])):
            rel = r.choice([0, 0, 0, 1, 5])
            rows.append((g if g else None, line, rel, round(r.gauss(rel * 0.3, 1), 1), round(r.random(), 2)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), "g long, line int, rel int, a double, b double")


def plain(rows, weights, k):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    n, loss, slope, bend = 0, 0.0, np.zeros(2), np.zeros(2)
    gain = lambda place: 1 / math.log2(place + 1) if place <= k else 0.0
    for page in by.values():
        score = lambda r: 0.0 + r[3] * weights["a"] + r[4] * weights["b"]
        page = sorted(page, key=lambda r: (-score(r), r[1]))
        ideal = sum(rel * gain(p) for p, rel in enumerate(sorted((r[2] for r in page), reverse=True), 1))
        for i, x in enumerate(page, 1):
            for j, y in enumerate(page, 1):
                if x[2] > y[2] and j <= k:
                    delta = (x[2] - y[2]) * abs(gain(i) - gain(j)) / ideal
                    gap, d = score(x) - score(y), np.array(x[3:]) - np.array(y[3:])
                    wrong = 1 / (1 + math.exp(gap))
                    n += 1
                    loss += delta * math.log1p(math.exp(-gap))
                    slope -= delta * wrong * d
                    bend += delta * wrong * (1 - wrong) * d * d
    return n, loss, slope, bend


@pytest.mark.parametrize("k, weights", [(5, {"a": 0.0, "b": 0.0}), (3, {"a": 0.7, "b": -1.5}), (50, {"a": 9.0, "b": 40.0})])
def test_gradient_equals_all_pairs(table, k, weights):
    found = ranker.pairs(table, ["g"], COLS, "rel", ["line"], weights, k)
    got = {r["column"]: r for r in ranker.gradient(found, COLS).collect()}
    n, loss, slope, bend = plain(pages(), weights, k)
    assert [got[c].pairs for c in COLS] == [n, n]
    assert np.isclose(got["a"].loss, loss)
    assert np.allclose([got[c].slope for c in COLS], slope) and np.allclose([got[c].bend for c in COLS], bend)


def test_learning_raises_ndcg(table):
    weights, history = ranker.fit(table, table, ["g"], COLS, "rel", ["line"], steps=4)
    assert weights["a"] > 0
    assert max(n for _, n in history) > history[0][1] and min(x for x, _ in history) < history[0][0]


def test_no_pairs(table):
    none = table.filter("rel = 0")
    assert ranker.fit(none, none, ["g"], COLS, "rel", ["line"], steps=2)[0] == {"a": 0.0, "b": 0.0}
    assert ranker.gradient(ranker.pairs(none.limit(0), ["g"], COLS, "rel", ["line"], {"a": 1.0}), COLS).count() == 2


def test_what_the_optimizer_knows_stays_small(spark):
    """The known facts of a plan grow with the columns, not with the choices between their names."""
    cols = [f"c{n}" for n in range(8)]
    rows = spark.range(20).selectExpr("id % 4 AS g", "CAST(id % 3 AS int) AS rel", "id AS line", *[f"id * {n + 1.5} AS {c}" for n, c in enumerate(cols)])
    found = ranker.pairs(rows, ["g"], cols, "rel", ["line"], {c: 0.1 for c in cols})

    def facts(plan):
        yield plan.validConstraints().size()
        for n in range(plan.children().size()):
            yield from facts(plan.children().apply(n))

    assert max(facts(found._jdf.queryExecution().optimizedPlan())) < 100
