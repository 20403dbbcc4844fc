import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from panelrank.llm import bpe
from tests.llm.conftest import AWKWARD

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello world, it's 2024!  Two  spaces\n\n\nand <|endoftext|>",
    "unbelievableness " * 40 + "x" * 1000,
    "aaaaaaaaaaaaaaaaaaaaaa" * 100,
    "thorreoundernt ndblewhst éèçàü ß 漢字 🙂🙂",
    "$$$ ### &&&!!!\t\r\n",
]


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding(
        "whole", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def test_ids_equal_the_library(spark, documents, whole):
    rows = [*AWKWARD, *[(10 + i, t) for i, t in enumerate(TEXTS)]]
    coded = bpe.encode(documents(rows), PATH, P.PATTERN)
    got = {(r.doc_id, tuple(r.ids)) for r in coded.collect()}
    assert got == {(i, tuple(whole.encode_ordinary(t or ""))) for i, t in rows}
    back = {(r.doc_id, bytes(r.data)) for r in bpe.decode(coded, PATH, P.PATTERN).collect()}
    assert back == {(i, (t or "").encode()) for i, t in rows}


def test_round_trip_digests(spark, documents, whole):
    rows = [*AWKWARD, *[(10 + i, t) for i, t in enumerate(TEXTS)]]
    got = bpe.round_trip(documents(rows), PATH, P.PATTERN).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    text = {i: t for i, t in rows}
    for r in got:
        ids = whole.encode_ordinary(text[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_queue_and_rows_agree():
    coder = bpe.Coder(PATH, P.PATTERN)
    words = ["thorreoundernt" * 5, "zzzzabcabcabc" * 9, "éèééèç" * 12, "antidisestablishment"]
    coder._contract(words)
    for word in words:
        queued = coder._queue(word.encode())
        assert coder.seen[word] == __import__("numpy").array(queued, dtype="int32").tobytes()


def test_empty_table(spark, documents):
    assert bpe.round_trip(documents([]), PATH, P.PATTERN).count() == 0


def test_workers_keep_nothing_for_later_stages(spark, documents):
    rows = [(i, f"thorreoundernt ndblewhst {i}") for i in range(64)]
    docs = documents(rows).repartition(8)
    assert bpe.round_trip(docs, PATH, P.PATTERN).count() == 64
    coded = bpe.encode(docs, PATH, P.PATTERN)
    assert bpe.decode(coded, PATH, P.PATTERN).count() == 64

    def held(batches):
        import pyarrow as pa

        from panelrank.llm import bpe

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"coders": pa.array([len(bpe._CODERS)], pa.int64())})

    found = spark.range(64, numPartitions=32).mapInArrow(held, "coders long").collect()
    assert len(found) == 32 and not any(r.coders for r in found)


def test_words_in_use_stay_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    coder, asked = bpe.Coder(PATH, P.PATTERN), []
    contract = coder._contract
    coder._contract = lambda words: (asked.extend(words), contract(words))
    first = coder.encode(["thorreoundernt ndblewhst", "zzzzabcabcabc qqxqqx"])
    again = coder.encode(["thorreoundernt ndblewhst vvkvvk"])
    assert list(again[0][: len(first[0])]) == list(first[0])
    assert asked.count("thorreoundernt") == 1 and set(coder.seen) == {
        "thorreoundernt", " ndblewhst", " vvkvvk"
    }
