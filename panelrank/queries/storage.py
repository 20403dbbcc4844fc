"""Readers and writers: tables that go out to the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelrank.operators import metrics, scale, splits
from panelrank.queries.panel import M, measurements
from panelrank.queries.ranking import sql_uniform
from panelrank.queries.registry import query, rd, rounded
from panelrank.queries.reports import _REG, PRED, predictions
from panelrank.sources import tables


def _place(spark, name: str) -> str:
    return f"{scale.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "measurements_csv",
    f"""WITH {M} SELECT id::VARCHAR AS id, time, CASE WHEN value <= 150 THEN variable END AS variable,
    {rd("CASE WHEN value > 2 THEN value END", "value")}, date FROM m""",
)
def _(spark, sf):
    rows = measurements(spark, sf).withColumns(
        {
            "variable": F.when(F.col("value") <= 150, F.col("variable")),
            "value": F.when(F.col("value") > 2, F.col("value")),
        }
    )
    out = rows.select(F.monotonically_increasing_id().alias("row"), "id", "time", "variable", "value")
    path = _place(spark, "measurements")
    tables.write_csv(out.fillna("NA", ["variable"]).withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("NA"))), path)
    return rounded(tables.read_measurements(spark, path))


@query(
    "interactions_csv",
    """SELECT l_orderkey, l_quantity::DOUBLE AS l_quantity,
    CASE WHEN l_linenumber > 1 THEN l_shipdate::TIMESTAMP END AS date_time FROM lineitem""",
)
def _(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("double").alias("l_quantity"),
        F.when(F.col("l_linenumber") > 1, F.col("l_shipdate").cast("timestamp_ntz").cast("string"))
        .otherwise(F.lit("not a time"))
        .alias("date_time"),
    )
    path = _place(spark, "interactions")
    tables.write_csv(rows, path)
    schema = rows.schema
    found = tables.read_interactions(spark, path, schema)
    return found.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


@query(
    "schema_diff",
    """WITH c AS (SELECT table_name, column_name FROM information_schema.columns)
    SELECT column_name AS "column", 'first' AS only_in FROM c WHERE table_name = 'documents' AND column_name NOT IN (SELECT column_name FROM c WHERE table_name = 'benchmark')
    UNION ALL SELECT column_name, 'second' FROM c WHERE table_name = 'benchmark' AND column_name NOT IN (SELECT column_name FROM c WHERE table_name = 'documents')""",
)
def _(spark, sf):
    return tables.schema_diff(tables.table(spark, sf, "documents"), tables.table(spark, sf, "benchmark"))


@query(
    "checked_parquet",
    f"WITH {M} SELECT id, time, variable, {rd('value')} FROM m",
)
def _(spark, sf):
    rows = measurements(spark, sf).drop("date")
    return rounded(tables.write_parquet_checked(rows, _place(spark, "checked")))


@query(
    "split_round_trip",
    f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE {sql_uniform("l_orderkey")} >= 0.8 AND {sql_uniform("l_orderkey")} < 0.9""",
)
def _(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    pages = rows.select(F.col("l_orderkey").alias("group_id")).distinct()
    path = _place(spark, "split")
    tables.write_split(splits.split_groups(pages, "group_id"), path)
    return tables.take_part(rows, tables.read_split(spark, path), "l_orderkey", "val")


def _cards(spark, sf) -> str:
    """One JSON file per run with the errors of one guess on one part."""
    path = _place(spark, "cards")
    rows = predictions(spark, sf)
    for run, (part, guess) in enumerate((p, g) for p in ("train", "val", "holdout") for g in "ab"):
        report = metrics.regression_report(rows.filter(F.col("part") == part), F.col("y"), F.col(guess))
        card = report.select(
            F.lit(f"iter_{run:02d}").alias("iteration"),
            F.lit("2024-01-01").alias("timestamp"),
            F.lit(run).cast("long").alias("n_features"),
            F.create_map(F.lit("guess"), F.struct("mse", "rmse", "mae", "r2")).alias("regression"),
        )
        card.coalesce(1).write.mode("append").json(path)
    return path


_RUNS = f"""{PRED}, runs AS (
  {" UNION ALL ".join(f"SELECT {run} AS run, {_REG.format(y='y', p=g)} FROM pred WHERE part = '{p}'" for run, (p, g) in enumerate((p, g) for p in ("train", "val", "holdout") for g in "ab"))})"""


@query(
    "report_cards",
    f"""WITH {_RUNS} SELECT run::INT AS run, 'regression' AS task, 'guess' AS model, {rd("mae")}, {rd("r2")} FROM runs""",
)
def _(spark, sf):
    found = tables.load_report_cards(spark, _cards(spark, sf))
    return rounded(found.select("run", "task", "model", "mae", "r2"))


@query(
    "compare_runs",
    f"""WITH {_RUNS} SELECT run::INT AS run, {rd("mae - lag(mae) OVER (ORDER BY run)", "mae_delta")}, {rd("r2 - lag(r2) OVER (ORDER BY run)", "r2_delta")} FROM runs""",
)
def _(spark, sf):
    found = tables.compare_runs(tables.load_report_cards(spark, _cards(spark, sf)), ["mae", "r2"])
    return rounded(found.select("run", "mae_delta", "r2_delta"))


@query("versioned_write", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, sf):
    root = _place(spark, "versions")
    nations = tables.table(spark, sf, "nation")
    for region, score in ((0, 0.25), (1, 0.5)):
        rows = nations.filter(F.col("n_regionkey") == region).select("n_nationkey", "n_name")
        tables.versioned_write(rows, root, f"2024010{region + 1}", score)
    archived = tables.read_parquet(spark, f"{root}/archive").count()
    latest = tables.read_parquet(spark, f"{root}/latest", ["n_nationkey", "n_name"])
    if archived <= latest.count():
        raise ValueError("the archive lost a version")
    return latest
