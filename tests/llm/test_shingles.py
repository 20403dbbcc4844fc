import random

import pytest

import corpus_pipeline
from panelrank.llm import shingles
from tests.llm.conftest import AWKWARD


def plain_set(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_groups(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def near_copies(seed=3):
    """Texts with copies of which some words are changed, and a passage that many texts share."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "🙂x"]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for k in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 160))]
        if k % 2:
            words += passage
        out.append(words)
    for _ in range(60):
        words = list(r.choice(out[:6] if r.random() < 0.6 else out))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [words[at], "extra"]])
        out.append(words)
    return [(k, r.choice([" ", "\n", "  "]).join(w).replace("w1", "W1" if k % 3 else "w1")) for k, w in enumerate(out)]


def stays(rows):
    groups = {}
    for (i, _), g in zip(rows, plain_groups([t for _, t in rows])):
        groups.setdefault(g, []).append((i is None, i or 0))
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("most, buckets, classes", [(64, 1 << 18, 128), (2, 1 << 18, 8), (2, 7, 1)])
def test_keep_one_equals_brute_force(spark, documents, most, buckets, classes):
    rows = [*[(i if i is None else i + 1000, t) for i, t in AWKWARD], *near_copies()]
    got = shingles.keep_one(documents(rows), most=most, buckets=buckets, classes=classes)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == stays(rows)


def test_stage_links_similar_texts(spark, documents):
    words = [f"word{k}" for k in range(100)]
    changed = [*words[:50], "other", *words[51:]]  # 91 of 101 shingles are shared
    far = [*words[:30], "one", *words[31:60], "two", *words[61:80], "three", *words[81:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(far))]
    got = corpus_pipeline.dedup_documents(spark, documents(rows), "")
    assert got.columns == documents(rows).columns
    assert sorted(r.doc_id for r in got.collect()) == [i for _, i in stays(rows)] == [1, 3]
    assert shingles.keep_one(documents(rows).limit(0)).count() == 0


def test_counters_never_rule_out_what_is_shared():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (3, 40, 5_000, 60_000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
        a, b = (np.frombuffer(shingles._classes(s), np.uint8) for s in (x, y))
        least = np.minimum(a, b)
        shared = len(np.intersect1d(x, y))
        assert (least == 255).any() or least.sum(dtype=int) >= shared


def test_similar_by_just_enough(spark, documents):
    """Pairs with a similarity between 0.8 and 0.95, and just below, in texts of many sizes."""
    rows = []
    for k, size in enumerate((12, 30, 60, 200, 900)):
        words = [f"t{k}w{i}" for i in range(size)]
        for j, changes in enumerate((0, max(1, size // 100), max(1, size // 50), max(1, size // 25))):
            text = list(words)
            for c in range(changes):
                text[(c * size) // changes] = f"new{j}x{c}"
            rows.append((10 * k + j, " ".join(text)))
    got = shingles.keep_one(documents(rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == stays(rows)
    assert len(rows) > len(stays(rows)) > 5


def test_trie_links_close_sets_first(spark, documents):
    import numpy as np

    r = np.random.default_rng(2)
    near = [np.unique(r.integers(0, 1 << 63, 2_000, dtype=np.uint64)) for _ in range(30)]
    sets = [*near, *(s[1:] for s in near[:20])]
    fps = [shingles._fingerprint(s) for s in sets]
    nodes = [(k, f) for k, f in enumerate(fps)]
    got = {tuple(p) for p in shingles._alike(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= shingles.BITS}
    assert got == want and len(want) >= 15


def test_rows_that_wait_are_linked(spark, documents, monkeypatch):
    """The turns on frequent shingles leave the other rows alone, whose pairs are still all found."""
    monkeypatch.setattr(shingles, "BITS", 0)
    rows = near_copies(seed=9)
    got = shingles.keep_one(documents(rows), most=4)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == stays(rows)
