"""Information by nearest neighbours against comparing all rows with each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrank.operators import information


def digamma(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def plain(x, y, k=3):
    keep = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
    x, y = (np.array([v[i] for i in keep], float) for v in (x, y))
    n = len(x)
    if n <= k:
        return n, None
    x, y = (np.round(v / (v.std() or 1.0), 9) for v in (x, y))
    far = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(far, np.inf)
    e = np.sort(far, axis=1)[:, k - 1]
    total = 0.0
    for i in range(n):
        for v in (x, y):
            inside = (v > v[i] - e[i]) & (v < v[i] + e[i]) if e[i] > 0 else v == v[i]
            total += digamma(max(int(inside.sum()) - 1, 0) + 1)
    return n, max(digamma(k) + digamma(n) - total / n, 0.0)


@pytest.mark.parametrize("cell, k", [(1024, 3), (16, 3), (7, 1), (2, 5)])
def test_equals_comparing_all_rows(spark, monkeypatch, cell, k):
    monkeypatch.setattr(information, "CELL", cell)
    rng = np.random.default_rng(cell)
    n = 300
    y = rng.normal(size=n).round(2)
    columns = {
        "close": y + rng.normal(size=n) * 0.3,
        "none": rng.normal(size=n),
        "zeros": np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n)),
        "steps": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 2.0),
    }
    holes = {c: [None if rng.random() < 0.1 else float(v) for v in values] for c, values in columns.items()}
    holes["few"] = [1.0, 2.0, *[None] * (n - 2)]
    target = [None if i % 40 == 0 else float(v) for i, v in enumerate(y)]
    rows = list(zip(target, *holes.values()))
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in holes))
    got = {r["column"]: r for r in information.neighbour_information(df, list(holes), "y", k).collect()}
    for c, values in holes.items():
        size, value = plain(values, target, k)
        assert got[c].n == size
        if value is None:
            assert got[c].mutual_information is None
        else:
            assert math.isclose(got[c].mutual_information, value, abs_tol=1e-6), c


def test_digamma(spark):
    got = spark.range(1, 60).select("id", information.digamma(F.col("id")).alias("d")).collect()
    assert all(math.isclose(r.d, digamma(r.id), abs_tol=1e-9) for r in got)
