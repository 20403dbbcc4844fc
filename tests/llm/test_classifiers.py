import zlib

import numpy as np
import pytest

from panelrank.llm import arrays, quality, queries, toxicity
from panelrank.llm.common import fold
from tests.llm.conftest import AWKWARD

FOLDER = "/root/testdata/sf0.01"


def auc(score, truth):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    ones = truth.sum()
    return (order[truth == 1].mean() - (ones - 1) / 2) / (len(truth) - ones)


@pytest.mark.parametrize(
    "name, label, least", [("op1_quality", "quality", 0.93), ("op8_toxicity", "toxic", 0.8)]
)
def test_held_out_documents(spark, name, label, least):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    cut = {"op1_quality": 0.3, "op8_toxicity": 0.5}[name]
    assert (got.predicted == (got.score >= cut)).all()
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    both = got[got.held_out].merge(truth, on="doc_id")
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least


def test_runs_hash_by_content_only():
    texts = [b"the cat, the dog", b"", b"dog the"]
    data, bounds = arrays.joined(texts)
    starts, ends, hashes = arrays.runs(data, quality._KIND[data])
    words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert words == [b"the", b"cat", b",", b"the", b"dog", b"dog", b"the"]
    assert len(set(hashes.tolist())) == len(set(words))
    assert hashes[0] == hashes[3] == hashes[6]
    assert arrays.per_text(starts, bounds).tolist() == [0, 5, 5, 7]


def test_grams_match_a_plain_loop():
    text = "Ab1 idiot!! é"
    clean = b" ab1 idiot   \xc3\xa9 "
    got = [len(b) for b, _ in toxicity.grams([text])]
    want = []
    for n in toxicity.GRAMS:
        grams = [clean[i : i + n] for i in range(len(clean) - n + 1)]
        want.append(sum(b" " not in g[1:-1] for g in grams))
    assert got == want
    buckets, shares = toxicity.bags([text])[0]
    assert shares.sum() == pytest.approx(1) and len(buckets) <= sum(want)


def test_scores_do_not_depend_on_neighbours():
    random = np.random.default_rng(3)
    model = toxicity.Model(
        random.normal(size=(toxicity.BUCKETS, 4)).astype("f"), random.normal(size=(4, 2)), np.zeros(2)
    )
    texts = ["some words here", None, "", "andere Wörter", "x" * 300_000, "some words here"]
    run = toxicity.scores(model)
    together, alone = run(texts), [run([t])[0] for t in texts]
    assert together.tolist() == alone and together[0] == together[5] and together[1] == 0.5


def test_unseen_misspelling_is_caught():
    random = np.random.default_rng(1)
    pool = ["table", "window", "river", "mountain", "garden", "silver", "people", "morning"]
    clean = [" ".join(random.choice(pool, 20)) for _ in range(200)]
    bad = [" ".join([*random.choice(pool, 18), "horrible", "disgusting"]) for _ in range(200)]
    model = toxicity.fit(clean + bad, [0] * 200 + [1] * 200, epochs=8)
    run = toxicity.scores(model)
    plain, misspelt = run([" ".join(pool * 2), " ".join(pool * 2) + " horribble disgustingg"])
    assert plain < 0.5 < misspelt


def test_awkward_rows_and_missing_labels(spark, documents):
    docs = documents(AWKWARD)
    labels = spark.createDataFrame(
        [(1, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int"
    )
    for chosen in (labels, labels.limit(0)):
        vectors = quality.word_vectors(docs)
        net = quality.fit(*quality.training_rows(docs, chosen, "quality", vectors))
        got = quality.score(docs, vectors, net).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
        model = toxicity.fit(*toxicity.sample(docs, chosen, "toxic"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert fold(None) == fold(None)
    empty = docs.limit(0)
    assert quality.word_vectors(empty).shape == (quality.BUCKETS, quality.WIDTH)
    assert toxicity.score(empty, toxicity.fit([], [])).count() == 0
    assert toxicity.scores(toxicity.fit([], []))(["a"])[0] == 0.5


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = quality.word_vectors(docs.coalesce(1))
    assert np.array_equal(one, quality.word_vectors(docs.repartition(7)))


def test_temperature_and_network_learn():
    random = np.random.default_rng(5)
    x = random.normal(size=(3000, 2 * quality.WIDTH + 1))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality.fit(x, y.tolist())
    assert ((net.probability(x) > 0.5) == y).mean() > 0.85 and net.temperature > 0
