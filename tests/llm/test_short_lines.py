import hashlib

from panelrank.llm import lines, queries
from tests.llm.conftest import AWKWARD
from tests.llm.test_lines import text_hash


def test_short_lines_repeat_exactly(spark, documents):
    docs = documents([*AWKWARD, (6, "Yes.\n\n \nYes.\nYet."), (7, "Yes.\n \nNo é\nno é"), (8, "No é")])
    got = {r._id: r.kept for r in lines.judged(docs, exact=1).collect()}
    assert got[6] == "Yes.\n\n \nYet." and got[7] == " \nNo é\nno é" and got[8] == ""
    assert got[3] == " \n\t " and got[4] == "a" and got[1] is None


def test_query_drops_every_exact_repeat(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = lines.judged(table, exact=1).select("_id", "kept", "n_removed").collect()
    hashed = {r.doc_id: r.kept_sha256 for r in queries.op2_line_dedup(spark, folder).collect()}
    assert {r._id: hashlib.sha256((r.kept or "").encode()).hexdigest() for r in got} == hashed
    seen, short = set(), 0
    for r in got:
        for line in (r.kept or "").split("\n"):
            if line.strip():
                assert line not in seen
                seen.add(line)
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, text_hash(r.text)))
    first = {}
    for r in order:
        for line in (r.text or "").split("\n"):
            if line.strip() and len(line) < 20:
                short += line in first
                first.setdefault(line, r.doc_id)
    assert short and set(first) <= seen
