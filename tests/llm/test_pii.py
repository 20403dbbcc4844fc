import hashlib
import itertools
import random
import re

import numpy as np

from panelrank.llm import pii, queries
from tests.llm.conftest import AWKWARD


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


def plain(text):
    """The base spans by the patterns as they are defined."""
    out = []
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out += [("email", m.start(), m.end()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


CASES = [
    "a@b.c a@b.c.d..e x@y a.b@c-d.e@f.g @a.b a@@b.c é@b.c a%+-_.@-.- a@b.c@d.e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 255.255.255.255 0001.002.3.4 1.2.3 1..2.3.4 9.9.9.9.",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111  1111 5500005555555559",
    "+1 (476) 555-5473 +12 +1 2 +123456789012345 +1234567890123456 ++49 30 1234567- +1 () 9",
]


def test_base_spans_follow_the_patterns():
    r = random.Random(0)
    texts = CASES + ["".join(r.choice("ab1234 .@+-()é\n5") for _ in range(200)) for _ in range(400)]
    for t in texts:
        assert pii.base_spans(t) == plain(t)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a" * 100_000 + "@" * 1000, "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def exact(g, field):
    """Marginals by listing every labelling."""
    n = len(g.places)
    total = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        if any(g.label[i] and g.label[i] != labels[i] for i in range(n)):
            continue
        score = sum(field.own[g.features[i], labels[i]].sum() for i in range(n))
        score += sum(field.transition[labels[a], labels[b]] for a, b in g.chain)
        for i in range(n):
            nodes = {node for token, node in g.member if token == i}
            kinds = {g.label[t] for t, node in g.member if node in nodes and t != i} - {0}
            score += field.alike * (not g.label[i] and labels[i] in kinds)
        total[range(n), labels] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_belief_propagation_is_exact_without_loops():
    random_ = np.random.default_rng(0)
    field = pii.Field(
        random_.normal(size=(pii.FEATURES, pii.LABELS)) * 0.4,
        random_.normal(size=(pii.LABELS, pii.LABELS)),
        1.5,
    )
    graphs = []
    for chain, member in (
        ([(0, 1), (1, 2)], [(2, 0), (3, 0)]),
        ([], [(0, 0), (3, 0), (0, 1), (3, 1), (1, 2), (3, 2)]),
        ([], []),
    ):
        features = random_.integers(0, pii.FEATURES, (4, 10)).tolist()
        label = np.array([0, 0, 0, 2])
        graphs.append(pii.Graph([(0, 1)] * 4, features, label, chain, member))
    for g, p in zip(graphs, pii.marginals(graphs, field, settled=1e-9)):
        assert np.allclose(p, exact(g, field), atol=1e-3)


def test_repeats_are_labelled_like_their_model():
    field = pii.train(pii_sample())
    text = "call +1 (476) 555-5473 today. words and words later 555-5473 again, room 12."
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], field, 0.9)[0]
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "555-5473")]
    clean = "the year 2024, version 3.1 and 16 items for 1,200 people"
    assert pii.added_spans([clean], [[]], field, 0.9) == [[]]


def pii_sample():
    r = random.Random(4)
    out = []
    for _ in range(300):
        number = "".join(r.choice("0123456789") for _ in range(7))
        kind = r.choice(
            [
                f"+1 ({r.randint(200, 999)}) {number[:3]}-{number[3:]}",
                f"u{number[:3]}.x@mail{number[0]}.example.com",
                f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}",
                f"{r.randint(1900, 2100)}",
                f"{r.randint(1, 99)} items",
                f"version {r.randint(1, 9)}.{r.randint(0, 9)}",
            ]
        )
        out.append(f"some words {kind} more words")
    return out


def test_query_equals_the_patterns(spark):
    folder = "/root/testdata/sf0.01"
    text = {
        r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
    }
    got = queries.op10_personal_data(spark, folder).collect()
    assert len(got) == len(text)
    for r in got:
        base = plain(text[r.doc_id] or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        for k in pii.KINDS:
            assert r[f"n_{k}"] == sum(s[0] == k for s in base)
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans) and len(spans) == len(listed) + r.n_added
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)


def test_awkward_rows(spark, documents):
    docs = documents([*AWKWARD, (9, "🙂 é a@b.co 🙂 a@b.co"), (10, "12 " * 3000), (11, "x" * 300_000)])
    field = pii.train(pii.sample(docs))
    got = {(r.doc_id, tuple(map(tuple, r.base))) for r in pii.find(docs, field).collect()}
    assert (9, (("email", 4, 10), ("email", 13, 19))) in got and (1, ()) in got and (None, ()) in got
    empty = docs.limit(0)
    assert pii.find(empty, pii.train(pii.sample(empty))).count() == 0


def test_repeats_without_evidence_add_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for field in (pii.train(pii_sample()), pii.train(pii.sample(docs))):
        for token in ("10.5.1", "1,200,000", "555-5473", "2024", "16"):
            for times in (1, 2, 5, 50):
                text = " and then ".join(f"we saw {token} there" for _ in range(times))
                once = pii.added_spans([f"we saw {token} there"], [[]], field, 0.95)[0]
                assert len(pii.added_spans([text], [pii.base_spans(text)], field, 0.95)[0]) == times * len(once) == 0


def test_one_full_number_reaches_all_its_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for field in (pii.train(pii_sample()), pii.train(pii.sample(docs))):
        text = "call +1 (476) 555-5473 today. " + " ".join(f"word{'x' * (i % 7)} 555-5473 more" for i in range(50))
        added = pii.added_spans([text], [pii.base_spans(text)], field, 0.9)[0]
        assert sum(text[a:b] == "555-5473" and k == "phone" for k, a, b in added) == 50


def test_equal_tokens_share_what_their_places_tell():
    """Two free tokens of one node move towards each other and never beyond."""
    r = np.random.default_rng(2)
    field = pii.Field(r.normal(size=(pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 3.0)
    features = r.integers(0, pii.FEATURES, (2, 10)).tolist()
    apart = pii.Graph([(0, 1)] * 2, features, np.zeros(2, int), [], [])
    linked = pii.Graph([(0, 1)] * 2, features, np.zeros(2, int), [], [(0, 0), (1, 0)])
    alike = pii.Graph([(0, 1)] * 2, [features[0]] * 2, np.zeros(2, int), [], [(0, 0), (1, 0)])
    a, b, c = pii.marginals([apart, linked, alike], field, settled=1e-9)
    assert np.abs(b[0] - b[1]).sum() < np.abs(a[0] - a[1]).sum()
    assert np.allclose(c, a[[0, 0]], atol=1e-6)


def test_very_long_text_with_repeats():
    field = pii.train(pii_sample())
    text = "call +1 (476) 555-5473 today. " + "555-5473 and 12 or 3.4 " * 20_000
    added = pii.added_spans([text], [pii.base_spans(text)], field, 0.9)[0]
    assert sum(text[a:b] == "555-5473" for _, a, b in added) == 20_000
