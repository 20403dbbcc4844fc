import hashlib
import zlib

import pytest
from check import connect, differences

from panelrank.llm import manifest, queries
from tests.conftest import SMALL

ROWS = [
    (7, "a b", "en", "s", 3),
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (2, "", "en", None, 0),
    (None, "x" * 300_000, "en", "s", 5),
    (None, None, "en", None, None),
    (3, "é🙂", None, "s", 2),
    (14, "lone", "zz", "s", 4),
    (21, "-", "", "-", 1),
    (4, "1:a", "de", "s", 3),
    (5, "b", "de", "s", 1),
    (9, "c", "de", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows, fanout=2):
    """(doc_id, leaf, subroot, root, siblings, folded root) by the definition, level by level."""

    def leaf(r, more=0):
        i, text, lang, source, n = r
        n = None if n is None else n + more
        cells = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)]
        return H(*cells)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, place):
        for nodes in tree[:-1]:
            start = place // fanout * fanout
            yield nodes[start:place], nodes[place + 1 : start + fanout]
            place //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    crown = levels([trees[g][-1][0] for g in names]) if names else []
    out = []
    for place, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            steps = [*path(trees[g], k), *path(crown, place)]
            tried = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, 1) if tried else leaf(r)
            for before, after in steps:
                h = H(*before, h, *after)
            proof = "".join("".join(b + a) for b, a in steps)
            out.append((r[0], leaf(r), trees[g][-1][0], crown[-1][0], proof, h))
    return sorted(out, key=str)


def built(spark, rows, fanout):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS g", "2 AS pos", "'x' AS digest", "3 AS n")
    other = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.manifest(
        docs, "doc_id", "lang", FIELDS, fanout, {"g": F.when(tampered, manifest.leaf(other))}
    )
    got = found.select(
        "doc_id", "leaf", "subroot", "root",
        manifest.siblings(F.col("proof")), manifest.folded(F.coalesce("g", "leaf"), F.col("proof")),
    )
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("block", [1024, 4])
def test_equals_the_definition(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    many = ROWS + [(100 + i, f"t{i}", "en", "s", i) for i in range(41)]
    assert built(spark, many, fanout) == plain(many, fanout)


def test_small_tables(spark):
    assert built(spark, [], 2) == []
    one = [(14, "lone", "zz", "s", 4)]
    (row,) = built(spark, one, 2)
    assert row[1] == row[2] == row[3] and row[4] == ""
    assert built(spark, one, 2) == plain(one)


def test_a_change_anywhere_changes_the_root(spark):
    changed = [*ROWS[:-1], (9, "C", "de", "s", 1)]
    assert plain(changed)[0][3] != built(spark, ROWS, 2)[0][3]


def test_query_matches_sql(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        got = queries.op12_merkle_manifest(spark, folder).toPandas()
        want = connect(folder).execute(queries.OP12_SQL).df()
        assert differences(got, want) is None
        assert not got.verified.all() and got.verified.mean() > 0.8
        assert got.root.nunique() == 1
