import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from panelrank.llm import bpe, lines, toxicity
from tests.llm import test_decontaminate, test_lines, test_shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Short documents of a table with planted cases, and the other tables the stages read."""
    out = str(tmp_path_factory.mktemp("tables"))
    given = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{given}/documents.parquet").filter("length(text) < 700")
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(250).collect()]
    passage = spark.read.parquet(f"{given}/benchmark.parquet").first().text
    copy = rows[30][1]
    words = [f"word{i}" for i in range(70)]
    near = [*words[:35], "other", *words[36:]]  # 61 of 71 shingles are shared
    far = [*words[:20], "one", *words[21:40], "two", *words[41:60], "three", *words[61:]]
    extra = [
        (5010, " ".join(words), "en", "a", 1),
        (5011, " ".join(near), "en", "a", 1),
        (5012, " ".join(far), "en", "a", 1),
        (5000, copy, "en", "a", len(copy)),
        (5001, None, None, None, None),
        (5002, "", "en", "a", 0),
        (5002, "", "en", "a", 0),
        (None, "no id but words that nobody else has used so far", "en", "a", 3),
        (5003, f"a start of its own {passage} and an end", "en", "a", 4),
        (5004, "you stupid worthless idiot, pathetic moron and clown", "en", "a", 5),
    ]
    spark.createDataFrame(rows + extra, COLUMNS).coalesce(1).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]

    # toxicity: the same model, scored text by text
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic"))
    score = toxicity.scores(model)
    got = corpus_pipeline.drop_toxic(spark, docs, folder)
    rows = [r for r in rows if score([r[1]])[0] < 0.5]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)

    docs = spark.createDataFrame(rows, COLUMNS)
    got = sorted(map(tuple, corpus_pipeline.dedup_lines(spark, docs, folder).collect()), key=str)
    want = test_lines.plain([r[:2] for r in rows], exact=1)
    assert sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in got if r[0]) == sorted(
        (w[0], w[4]) for w in want if w[0]
    )
    assert all(r[4] == (len(r[1]) if r[1] is not None else r[4]) for r in got)

    rows, docs = got, spark.createDataFrame(got, COLUMNS)
    got = [tuple(r) for r in corpus_pipeline.dedup_documents(spark, docs, folder).collect()]
    groups = {}
    roots = test_shingles.plain_groups([r[1] for r in rows])
    for r, g in zip(rows, roots):
        groups.setdefault(g, []).append(r)
    ids = [min((r[0] is None, r[0] or 0) for r in group) for group in groups.values()]
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(ids)
    assert set(got) <= set(rows)
    stayed = {r[0] for r in got}
    assert 5010 in stayed and 5011 not in stayed and 5012 in stayed

    rows, docs = got, spark.createDataFrame(got, COLUMNS)
    got = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {x[0] for x in test_decontaminate.plain([r[:2] for r in rows], items) if x[2]}
    assert sorted(got, key=str) == sorted((r for r in rows if r[0] not in hit), key=str)
    assert 5003 not in {r[0] for r in got} and hit

    rows, docs = got, spark.createDataFrame(got, COLUMNS)
    got = corpus_pipeline.encode(spark, docs, folder).collect()
    whole = tiktoken.Encoding(
        "whole",
        pat_str=P.PATTERN,
        mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)),
        special_tokens={},
    )
    text = {r[0]: r[1] for r in rows}
    assert sorted(map(str, text)) == sorted(str(r.doc_id) for r in got)
    for r in got:
        assert r.lossless and r.n_tokens == len(whole.encode_ordinary(text[r.doc_id] or ""))


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert 5004 not in {r.doc_id for r in got.collect()}


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        docs = out if out.columns == docs.columns else docs


def test_registered():
    names = set(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()


def test_lines_stage_matches_the_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = lines.judged(docs).select(F.sum("n_removed")).first()[0]
    assert kept > 0
