import duckdb
from check import differences

from panelrank.llm import decontaminate, queries
from tests.llm.test_decontaminate import DOCS, ITEMS


def test_items_without_id_hit(spark, documents):
    items = spark.createDataFrame([(None, ITEMS[1][1]), (11, "zero")], "item_id long, text string")
    docs = documents([DOCS[1], DOCS[2], (30, DOCS[1][1].removeprefix("zero. "))])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {21: (11, ["11"]), 22: (0, []), 30: (10, [])}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [22]


def test_sql_counts_them_too(spark, documents, tmp_path):
    items = spark.createDataFrame([(None, ITEMS[1][1]), (11, "zero"), (None, "nine")], "item_id long, text string")
    documents([*DOCS, (30, DOCS[1][1].removeprefix("zero. "))]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = queries.op3_decontamination(spark, str(tmp_path)).toPandas()
    assert differences(got, con.execute(queries.OP3_SQL).df()) is None
    assert (got.contaminated & (got.n_items == 0)).any()
