import hashlib
import random
from collections import Counter

import pytest

from panelrank.llm import queries, suffixes
from tests.llm.conftest import AWKWARD


def plain(docs, span):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + span] for _, b in data for k in range(len(b) - span + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def got(df):
    return sorted(
        (
            (r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept))
            for r in df.collect()
        ),
        key=str,
    )


def corpus(seed, alphabet, n=50):
    r = random.Random(seed)
    shared = ["".join(r.choice(alphabet) for _ in range(r.randint(60, 400))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            passage = r.choice(shared)
            if r.random() < 0.6:
                a = r.randrange(len(passage))
                passage = passage[a : r.randint(a, len(passage))]
            parts += [passage, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))]
        docs.append((i, "".join(parts)))
    docs += [(n, docs[3][1]), (n, docs[3][1]), (n + 1, "ab" * 150), (n + 2, "z" * 500)]
    return docs


@pytest.mark.parametrize("alphabet, span, hot", [("abé ", 40, 20_000), ("abcdefghij é\n", 60, 20_000), ("ab", 40, 3), ("abé ", 20, 0)])
def test_equals_brute_force(spark, documents, monkeypatch, alphabet, span, hot):
    monkeypatch.setattr(suffixes, "BATCH", 7)
    docs = [*AWKWARD, *corpus(span, alphabet)]
    assert got(suffixes.dedup(documents(docs), span, hot=hot)) == plain(docs, span)


def test_long_texts_in_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 97)
    r = random.Random(9)
    passage = "".join(r.choice("abcdef") for _ in range(700))
    docs = [(1, "".join(r.choice("abcdef") for _ in range(900)) + passage), (2, "xyz" + passage[30:])]
    assert got(suffixes.dedup(documents(docs), 200)) == plain(docs, 200)


def test_levels_mark_what_occurs_twice():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(10, 40))).encode() for _ in range(90)]
    import numpy as np

    index, span = suffixes.Levels(10), 10
    for k in range(0, 90, 10):
        batch = texts[k : k + 10]
        index.add(batch, np.array([len(t) - span + 1 for t in batch]))
    windows = [t[k : k + span] for t in texts for k in range(len(t) - span + 1)]
    seen = Counter(windows)
    assert index.marks().tolist() == [seen[w] > 1 for w in windows]
    assert len(index.levels) <= 5


@pytest.mark.parametrize("span", [8, 13, 40, 200])
def test_levels_are_sorted_by_their_bytes(span):
    import numpy as np

    r = random.Random(span)
    base = "".join(r.choice("ab\0") for _ in range(900))
    texts = []
    for k in range(80):
        size, a = r.randint(span, span + 60), r.randrange(500)
        text = base[a : a + size] if k % 2 else "".join(r.choice("ab") for _ in range(size))
        texts.append(text.encode())
    index = suffixes.Levels(span)
    for k in range(0, 80, 8):
        batch = texts[k : k + 8]
        index.add(batch, np.array([len(t) - span + 1 for t in batch]))
    windows = [t[k : k + span] for t in texts for k in range(len(t) - span + 1)]
    seen = Counter(windows)
    assert index.marks().tolist() == [seen[w] > 1 for w in windows]
    held = [[x.data[p : p + span].tobytes() for p in x.where] for x in index.levels]
    assert all(x == sorted(set(x)) for x in held)
    assert sorted(w for x in held for w in x) == sorted(seen)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = [
        (i, n, gone, spans, hashlib.sha256(kept).hexdigest())
        for i, n, gone, spans, kept in plain([tuple(r) for r in rows], 200)
    ]
    found = queries.op6_suffix_dedup(spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert any(x[2] for x in want)


def test_empty_table(spark, documents):
    assert suffixes.dedup(documents([])).count() == 0
