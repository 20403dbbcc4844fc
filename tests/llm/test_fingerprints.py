import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelrank.llm import fingerprints, queries
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD


def pieces(text):
    """Paragraphs with their counts, by the definition."""
    found = []
    for line in text.split("\n"):
        cut = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", line) if len(line) > fingerprints.LONG else [line]
        found += [p for p in cut if re.search(r"[^ \t\n\x0b\f\r]", p)]
    return Counter(found)


def like(a, b):
    shared, either = sum((a & b).values()), sum((a | b).values())
    return shared / either if either else 1.0


def plain(rows):
    """(doc_id, n_chars, edited text's digest, near_edited, near_next, paragraphs) per row."""

    def place(row):
        i, text = row
        name = "-" if i is None else f"{len(str(i))}:{i}"
        return i is not None, i or 0, hashlib.md5(f"{name} {text or ''}".encode()).hexdigest()

    rows = sorted(rows, key=place)
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = pieces(text), pieces(edited), pieces(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), sha, like(own, other), like(own, following), own, other))
    return out


def rows_of(docs):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in docs]


def expected(rows):
    return sorted([(i, n, s, round(a, 9), round(b, 9)) for i, n, s, a, b, _, _ in plain(rows)], key=str)


MANY = "\n".join(f"line {i % 1700} of a long text" for i in range(3000))
ROWS = [
    *AWKWARD,
    (10, "one\ntwo\nthree\nfour\n\n \nfive"),
    (11, "one\ntwo\nthree\nfour\nfive\nfive\nfive"),
    (12, MANY),
    (13, MANY.replace("line 7 ", "LINE 7 ")),
    (14, " ".join(f"Sentence {i}. Is it? Yes!" for i in range(60))),
    (15, "🙂é\n" * 30),
    (16, "same"),
    (17, "same"),
]


def test_equals_brute_force(spark, documents):
    rows = ROWS + [(20, "a\nb\nc\nd")] * 2500
    got = fingerprints.fingerprints(documents(rows)).collect()
    assert sorted(rows_of(got), key=str) == expected(rows)
    assert {r.fingerprint for r in got if r.doc_id in (16, 17)}.__len__() == 1
    prints = {r.fingerprint for r in got if r.doc_id in (10, 11, 12, 13, 14)}
    assert len(prints) == 5


def test_small_tables(spark, documents):
    assert fingerprints.fingerprints(documents([])).count() == 0
    for rows in ([(1, "lone\ntext\nhere")], [(1, None)], [(2, "b\nb"), (1, "a\nb")], [(1, "x"), (1, "x")]):
        assert sorted(rows_of(fingerprints.fingerprints(documents(rows)).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("cells", [3, 6, 24])
def test_peeling_recovers_the_differing_digests(spark, monkeypatch, cells):
    monkeypatch.setattr(fingerprints, "CELLS", cells)
    first, second = list(range(0, 60)), [*range(20, 75), 5, 5, 5]
    sides = spark.createDataFrame(
        [(7, 1, 1, first), (7, 1, -1, second), (8, 1, 1, first), (8, 1, -1, first), (9, 1, -1, [1])],
        "pos long, pair int, side int, hashes array<long>",
    )
    got = {r.pos: r for r in fingerprints.differences(sides).collect()}
    both = fingerprints.members(sides, "pos", "pair", "side").collect()

    def side(pos, s):
        return {r.digest for r in both if r.pos == pos and r.side == s}

    assert 8 not in got
    for pos in (7, 9):
        assert set(got[pos].gone) == side(pos, 1) - side(pos, -1)
        assert set(got[pos].come) == side(pos, -1) - side(pos, 1)
    assert len(got[7].gone) == 19 and len(got[7].come) == 17


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = fingerprints.versions(rows := fingerprints._identified(docs, "doc_id", "text"), fingerprints.ring(rows))
    keys = ("pos", "pair", "cells", "side")
    pairs = fingerprints.pairs(found).withColumn("cells", F.lit(24))
    cells = fingerprints.sketch(fingerprints.members(pairs, *keys), F.col("cells"), *keys)
    for df in (found, fingerprints.peel(fingerprints.subtract(cells))):
        assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_query_equals_brute_force_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_document_sketch(spark, folder).collect()
    assert sorted(rows_of(got), key=str) == expected(rows)
    alike = {}
    for i, _, _, _, _, own, other in plain(rows):
        alike.setdefault(frozenset(own.items()), set()).add(i)
    prints = {r.doc_id: r.fingerprint for r in got}
    for ids in alike.values():
        assert len({prints[i] for i in ids}) == 1
    assert len(set(prints.values())) == len(alike)
