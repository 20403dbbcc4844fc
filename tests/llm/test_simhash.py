import numpy as np
import pytest
import xxhash

from panelrank.llm import queries, simhash
from tests.llm.conftest import AWKWARD


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(fps, budget=2):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near(random, n):
    """Fingerprints with chains and clusters of near ones."""
    out = [int(x) for x in random.integers(0, 1 << 62, n)]
    for i in range(n):
        out.append(out[i // 2] ^ (1 << int(random.integers(64))) ^ (1 << int(random.integers(64))))
    for _ in range(3 * n):
        out.append(out[int(random.integers(len(out) // 2, len(out)))] ^ (1 << int(random.integers(64))))
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("most", [1_000_000, 64, 3])
def test_links_connect_like_brute_force(spark, most):
    fps = sorted(set(near(np.random.default_rng(2), 60)) | {0, 1, (1 << 64) - 1, (1 << 64) - 2})
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = simhash.components(simhash.links(table, 2, most)).collect()
    root = {signed(x): signed(x) for x in fps} | {r.node: r.root for r in found}
    groups, plain = {}, {}
    for x, r in zip(fps, plain_groups(fps)):
        plain.setdefault(r, set()).add(signed(x))
        groups.setdefault(root[signed(x)], set()).add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_block_traversal_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    fps = np.unique(np.array(near(np.random.default_rng(4), 150), dtype=np.uint64))
    got = {(i, j) for a, b in simhash.joined(fps, None, 0, 0, 2) for i, j in zip(a, b)}
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert got == {(i, j) for i, j in want if i < j}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op5_simhash(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = plain_groups(fps)
    least = {}
    for r, g in zip(rows, root):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert len(got) == len(rows)
    for r, fp, g in zip(rows, fps, root):
        assert got[r.doc_id].fingerprint == f"{fp:016x}"
        assert got[r.doc_id].component_id == least[g]


def test_awkward_rows(spark, documents):
    docs = documents([*AWKWARD, (9, "A  b\tC d"), (8, "a b c D"), (7, "x" * 200_000)])
    found = simhash.classes(docs).collect()
    assert len(found) == len(AWKWARD) + 3
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert by[8] == by[9] and {c for _, c in by[9]} == {8}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
