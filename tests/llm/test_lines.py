import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelrank.llm import lines, queries
from tests.llm.conftest import AWKWARD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def text_hash(text, second=False):
    import xxhash

    if text is None:
        return signed(xxhash.xxh64_intdigest(b"second", 42)) if second else 42
    seed = 42 if not second else xxhash.xxh64_intdigest(b"second", 42)
    return signed(xxhash.xxh64_intdigest(text.encode(), seed))


def plain(docs, tau=2, least=20, exact=None):
    """Brute force: every pair of lines that take part, shorter ones only where they repeat."""

    def taken(line):
        return len(line) >= least or exact is not None and len(line) >= exact and line.strip(" \t\r\x0b\x0c")

    place = lambda i, t: (i is None, i or 0, text_hash(t), text_hash(t, True))
    first, near = {}, {}
    for i, t in docs:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            if taken(line):
                here = (*place(i, t), no)
                first[line] = min(first.get(line, here), here)
    all_lines = sorted(x for x in first if len(x) >= least)
    for n, a in enumerate(all_lines):
        for b in all_lines[:n]:
            if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
    out = []
    for i, t in docs:
        own = t.split("\n") if t is not None else []
        kept, links = [], 0
        for no, line in enumerate(own):
            links += len(near.get(line, ()))
            earlier = any(first[o] < first[line] for o in near.get(line, ()))
            if not taken(line) or (first[line] == (*place(i, t), no) and not earlier):
                kept.append(line)
        text = "\n".join(kept) if len(kept) < len(own) else t or ""
        out.append(
            (i, len(own), len(own) - len(kept), links, hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=str)


def varied(seed=0, n=60):
    """Lines with copies, edits of one to four characters, and templates that share long parts."""
    r = random.Random(seed)
    words = ["über", "the", "river", "stone", "ñandú", "quick", "lamp", "of", "🙂x", "anode"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(4, 14))) for _ in range(n)]
    base += [f"request number {k:04d} was answered without error" for k in range(40)]
    out = []
    for _ in range(4 * n):
        line = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
            at = r.randrange(len(line))
            kind = r.choice("sid")
            if kind == "s":
                line[at] = r.choice("abcé🙂")
            elif kind == "i":
                line.insert(at, r.choice("abcé🙂"))
            else:
                del line[at]
        out.append("".join(line))
    docs = [(k, "\n".join(out[5 * k : 5 * k + 5])) for k in range(len(out) // 5)]
    return docs


@pytest.mark.parametrize("most, rows", [(1000, 200_000), (2, 200_000), (2, 0)])
def test_equals_brute_force(spark, documents, monkeypatch, most, rows):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows)
    docs = [*AWKWARD, *varied()]
    docs += [(300, docs[9][1]), (300, docs[9][1]), (301, ""), (302, "x" * 30 + "\n\n" + "x" * 31)]
    got = lines.judged(documents(docs), most=most).select(
        "_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("kept", F.lit("")), 256)
    )
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


def test_edit_distance(spark):
    r = random.Random(1)
    rows = []
    for _ in range(400):
        a = "".join(r.choice("ab🙂é") for _ in range(r.randint(0, 12)))
        b = "".join(r.choice("ab🙂é") for _ in range(r.randint(0, 12)))
        rows.append((a, b))
    rows += [("kitten sitting" * 30, "kitten sitting" * 29 + "kittensittin")]
    points = [lines.code_points(F.col(c)).alias(p) for c, p in (("a", "p"), ("b", "q"))]
    table = spark.createDataFrame(rows, "a string, b string").select("a", "b", *points).cache()
    for tau in (1, 2, 3):
        got = table.select("a", "b", lines.edit_distance(F.col("p"), F.col("q"), tau)).collect()
        assert all(d == min(tau + 1, distance(a, b)) for a, b, d in got)


def test_dedup_keeps_rows_and_columns(spark, documents):
    long = "a line of text that is long enough"
    docs = documents([(1, f"{long}\nshort\nshort"), (2, f"short\n{long}!"), (3, None)])
    got = lines.dedup(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: f"{long}\nshort\nshort",
        2: "short",
        3: None,
    }
    assert lines.dedup(docs.limit(0)).count() == 0


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op2_line_dedup(spark, folder)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "n_links", "kept_sha256"]
    want = plain([tuple(r) for r in rows if len(r.text or "") < 3000])
    small = spark.createDataFrame([r for r in rows if len(r.text or "") < 3000], "doc_id long, text string")
    again = lines.judged(small).select(
        "_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("kept", F.lit("")), 256)
    )
    assert sorted(map(tuple, again.collect()), key=str) == want
    assert got.count() == len(rows)


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
