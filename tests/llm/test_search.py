import math
import re
from collections import Counter

import pytest
from check import connect, differences

from panelrank.llm import queries, search
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD

PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(items, docs, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for place, (i, w) in enumerate(held):
            m, counts, score = 10 + (90 * len(w) * n_docs) // total, Counter(w), 0
            for t in wanted & counts.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0, place, i))
        for rank, (s, _, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


ITEMS = [
    (1, "Alpha beta GAMMA delta"),
    (2, "alpha, alpha! épsilon x1"),
    (3, "the the the of"),
    (3, "rare"),
    (4, None),
    (5, "... !"),
    (6, "nowhere to be found"),
    (None, "beta of"),
]


def corpus():
    docs = [*AWKWARD, (10, "rare " + "the " * 40), (11, "x" * 50_000 + " rare"), (12, "the of " * 30_000)]
    for i in range(300):
        common = "the of " * (i % 7) + "alpha " * (i % 5 == 0) + "Beta " * (i % 11 == 0)
        docs.append((100 + i, common + f"gamma-delta w{i} " * (i % 17 == 0) + "épsilon X1" * (i % 50 == 0)))
    docs += [(500, "alpha beta the same text")] * 3 + [(i, "alpha beta the same text") for i in range(501, 540)]
    return docs


@pytest.mark.parametrize("first, rows, part", [(256, 500_000, 200_000), (3, 500_000, 200_000), (3, 0, 4)])
def test_equals_brute_force(spark, documents, monkeypatch, first, rows, part):
    monkeypatch.setattr(search, "FIRST", first)
    monkeypatch.setattr(search, "PIECE", 1000)
    monkeypatch.setattr(search, "PART_TERMS", part)
    monkeypatch.setattr(search.scale, "BROADCAST_ROWS", rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr(
        "*", "1 AS term", "2 AS item", "3 AS no", "'x' AS row"
    )
    docs = corpus()
    got = search.search(items, documents(docs), "item_id", "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(ITEMS, docs)


def test_fewer_and_ties(spark, documents):
    docs = [(9, "a b"), (3, "a b"), (None, "b a"), (4, "c"), (4, "c")]
    items = spark.createDataFrame([(1, "a"), (2, "c")], "item_id long, text string")
    got = search.search(items, documents(docs), "item_id", "doc_id", k=2).collect()
    assert sorted(map(tuple, got), key=str) == plain([(1, "a"), (2, "c")], docs, 2)
    assert [r.doc_id for r in got if r.item_id == 1] == [None, 3]


def test_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for asked, docs in ((items, []), (none, corpus()), (items, [(1, None), (2, "")]), (items, [(1, "zzz")])):
        got = search.search(asked, documents(docs), "item_id", "doc_id")
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_query_matches_sql(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        got = queries.op11_ranked_search(spark, folder).toPandas()
        want = connect(folder).execute(queries.OP11_SQL).df()
        assert differences(got, want) is None and len(got)
