import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrank.sources import tables


def test_measurements_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        ",id,time,variable,value\n0,A1,2014-02-26 13:00:00.000,mood,6\n1,A1,2014-02-27 00:10:00.000,mood,NA\n"
    )
    rows = tables.read_measurements(spark, str(path)).orderBy("time").collect()
    assert [r["value"] for r in rows] == [6.0, None]
    assert str(rows[1]["date"]) == "2014-02-27" and "row" not in rows[0]


def test_interactions_csv_with_bad_time(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("srch_id,date_time,price_usd\n1,2013-04-04 08:32:15,104.77\n2,never,NULL\n")
    schema = T.StructType(
        [
            T.StructField("srch_id", T.IntegerType()),
            T.StructField("date_time", T.TimestampType()),
            T.StructField("price_usd", T.DoubleType()),
        ]
    )
    rows = tables.read_interactions(spark, str(path), schema).orderBy("srch_id").collect()
    assert rows[0]["date_time"].hour == 8
    assert rows[1]["date_time"] is None and rows[1]["price_usd"] is None


def test_checked_parquet_split_and_versions(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("group_id"), F.lit("train").alias("part"))
    back = tables.write_parquet_checked(df, str(tmp_path / "p"))
    assert back.count() == 10 and back.schema == df.schema or back.columns == df.columns
    tables.write_split(df, str(tmp_path / "s"))
    taken = tables.take_part(
        spark.range(20).withColumnRenamed("id", "g"), tables.read_split(spark, str(tmp_path / "s")), "g", "train"
    )
    assert taken.count() == 10
    tables.versioned_write(df, str(tmp_path / "v"), "20240101", 0.41706)
    with pytest.raises(Exception):
        tables.versioned_write(df, str(tmp_path / "v"), "20240101", 0.41706)
    tables.versioned_write(df.limit(3), str(tmp_path / "v"), "20240102", 0.5)
    assert spark.read.parquet(str(tmp_path / "v" / "latest")).count() == 3
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 10
    assert tables.read_parquet(spark, str(tmp_path / "p"), ["part"]).columns == ["part"]


def test_schema_diff(spark):
    a, b = spark.range(1).selectExpr("id", "1 AS x"), spark.range(1).selectExpr("id", "2 AS y")
    assert sorted(map(tuple, tables.schema_diff(a, b).collect())) == [("x", "first"), ("y", "second")]


def test_report_cards_skip_broken_files(spark, tmp_path):
    for n, f1 in ((2, 0.4), (10, 0.5)):
        folder = tmp_path / f"iter_{n:02d}"
        folder.mkdir()
        card = {
            "iteration": f"iter_{n:02d}",
            "timestamp": "2026-01-01",
            "n_features": 10 * n,
            "classification": {"rf": {"f1_macro": f1, "accuracy": 0.6, "confusion_matrix": [[1, 2], [3, 4]]}},
            "regression": {"gb": {"mse": 0.3, "r2": 0.2}},
        }
        (folder / "report_card.json").write_text(json.dumps(card, indent=1))
    broken = tmp_path / "iter_05"
    broken.mkdir()
    (broken / "report_card.json").write_text('{"iteration": "iter_05", "classification": {"rf": {"f1_m')
    cards = tables.load_report_cards(spark, str(tmp_path))
    assert [(r["run"], r["task"]) for r in cards.collect()] == [
        (2, "classification"), (2, "regression"), (10, "classification"), (10, "regression")
    ]
    deltas = tables.compare_runs(cards, ["f1_macro"]).filter("run = 10 AND task = 'classification'").first()
    assert deltas["f1_macro_delta"] == pytest.approx(0.1)
