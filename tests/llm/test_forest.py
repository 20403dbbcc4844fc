import math

import numpy as np
import pytest

from panelrank.llm import forest, queries

FOLDER = "/root/testdata/sf0.01"


def plain(rows, every=20, k=20):
    usable = {
        (i, tuple(v))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    out = {}
    for q, x in usable:
        if q % every == 0:
            near = out.setdefault(q, {})
            for i, y in usable:
                if i != q and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(x, y):
                        s += a * b
                    near[i, s] = None
    return {q: sorted(((-s, i) for i, s in near))[:k] for q, near in out.items()}


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    for found in out.values():
        assert sorted(found) == list(range(1, len(found) + 1))
    return {q: [found[i] for i in sorted(found)] for q, found in out.items()}


def awkward(n=150, dim=6):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=dim)]) for i in range(n)]
    same = rows[40][1]
    rows += [(200 + i, same) for i in range(60)] + [(40, same), (40, same)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None), (420, []), (440, [0.0] * dim), (460, [1.0, None, 2.0, 0.0, 0.0, 1.0])]
    rows += [(480, [nan] + [1.0] * 5), (500, [inf] + [1.0] * 5), (None, same), (520, [1.0, 2.0])]
    rows += [(521, [2.0, 1.0]), (540, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (541, [0.0, 1.0, 0.0, 0.0, 0.0, -0.0])]
    rows += [(20, [float(x) for x in random.normal(size=dim)])]
    return rows


@pytest.mark.parametrize("chunk", [4096, 16])
def test_all_candidates_give_the_exact_answer(spark, chunk):
    rows = awkward()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS h1", "2 AS v", "3 AS dim"
    )
    got = answers(forest.nearest(table, share=forest.TREES, chunk=chunk))
    want = {q: near for q, near in plain(rows).items() if near}
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_prefix_sizes_are_exact(spark):
    random = np.random.default_rng(1)
    codes = random.integers(0, 1 << 8, (300, forest.TREES)) << (forest.BITS - 8)
    rows = [(i, i, 4, [int(c) for c in codes[i]]) for i in range(300)]
    coded = spark.createDataFrame(rows, "h1 long, h2 long, dim int, codes array<long>")
    got = {(r.tree, r.depth, r.prefix): r.n for r in forest.prefix_sizes(coded).collect()}
    for tree in (0, 5):
        for depth in (0, 3, 8, 12):
            prefix, n = np.unique(codes[:, tree] >> (forest.BITS - depth), return_counts=True)
            for p, c in zip(prefix.tolist(), n.tolist()):
                assert got.get((tree, depth, p), 1) == c


def test_recall_on_a_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    got = answers(queries.op4_prefix_forest(spark, FOLDER))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        order = np.lexsort((ids, -scores))
        best = [i for i in ids[order] if i != q][:20]
        found = [i for _, i in got[q]]
        hits += len(set(best) & set(found))
        total += 20
        for s, i in got[q]:
            assert -s == pytest.approx(float(scores[ids == i][0]), abs=1e-12)
    assert len(got) == (ids % 20 == 0).sum() and hits / total >= 0.9


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.nearest(table).count() == 0
