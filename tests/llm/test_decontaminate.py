import re

import pytest
from check import connect, differences

from panelrank.llm import decontaminate, queries
from tests.llm.conftest import AWKWARD

PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain(docs, items, span=10):
    def words(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return PATTERN.findall(text)

    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(span, len(p))
            windows = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), tuple(sorted(found))))
    return sorted(out, key=str)


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve thirteen"),
    (2, "three four five six seven eight nine ten eleven twelve"),
    (10, "short item é"),
    (11, "short"),
    (12, None),
    (13, "... !!"),
    (14, "a a a a a a a a a a a a a"),
    (2, "short item again and again"),
]
DOCS = [
    (20, "x one, two three four five six seven eight nine ten y"),
    (21, "zero. three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (22, "one two three four five six seven eight nine"),
    (23, "SHORT ITEM É short! item é"),
    (24, "a " * 40 + "b " + "a " * 9),
    (25, "short item again and again short item again and again"),
    (25, "short item again and again"),
    (26, "w " * 5000 + "three four five six seven eight nine ten eleven twelve" + " w" * 5000),
]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_equals_brute_force(spark, documents, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs = [*AWKWARD, *DOCS]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS span")
    got = decontaminate.contamination(documents(docs), items).collect()
    found = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in got]
    assert sorted(found, key=str) == plain(docs, [x for x in ITEMS if x[1]])


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(documents(DOCS), items).collect()
    assert len(got) == len(DOCS) and all(r.n_hit == 0 for r in got)
    assert decontaminate.contamination(documents([]), items).count() == 0


def test_fingerprints_cover_every_window():
    import numpy as np

    hashes = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint64)
    for span in (1, 2, 5, 7, 10):
        where, _ = decontaminate.winnow(hashes, span)
        k = min(span, decontaminate.GRAM)
        for start in range(len(hashes) - span + 1):
            assert ((where >= start) & (where + k <= start + span)).any()


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op3_decontamination(spark, folder).toPandas()
    want = connect(folder).execute(queries.OP3_SQL).df()
    assert differences(got, want) is None and got.contaminated.any() and not got.contaminated.all()
