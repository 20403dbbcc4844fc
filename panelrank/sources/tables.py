"""Typed readers, checked writers and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASUREMENT_CSV = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """CSV of long measurements; the leading row index is dropped, ``date`` derived."""
    return (
        spark.read.schema(MEASUREMENT_CSV)
        .option("nullValue", "NA")
        .csv(path, header=True)
        .drop("row")
        .withColumn("date", F.to_date("time"))
    )


def read_interactions(
    spark: SparkSession, path: str, schema: T.StructType, time_col: str = "date_time"
) -> DataFrame:
    """Wide CSV with an explicit schema; an unreadable time becomes missing."""
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == time_col else f.dataType)
            for f in schema.fields
        ]
    )
    return (
        spark.read.schema(as_text)
        .option("nullValue", "NULL")
        .csv(path, header=True)
        .withColumn(time_col, F.try_to_timestamp(F.col(time_col)))
    )


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that only one of two tables has; metadata only."""
    rows = [(c, "first") for c in a.columns if c not in b.columns]
    rows += [(c, "second") for c in b.columns if c not in a.columns]
    return a.sparkSession.createDataFrame(rows, "column string, only_in string")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; times keep their microseconds."""
    exact = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    df.write.mode(mode).option("timestampNTZFormat", exact).csv(path, header=True)


def write_parquet_checked(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write snappy parquet, read it back, compare row count and column types.

    The rows are counted while they are written, so the input is computed once.
    """
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option(
        "compression", "snappy"
    ).parquet(path)
    back = df.sparkSession.read.parquet(path)
    wanted = [(f.name, f.dataType) for f in df.schema.fields]
    if [(f.name, f.dataType) for f in back.schema.fields] != wanted:
        raise ValueError(f"schema changed on the way to {path}")
    if back.count() != seen.get["rows"]:
        raise ValueError(f"row count changed on the way to {path}")
    return back


def write_split(parts: DataFrame, path: str) -> None:
    """Membership table (group_id, part)."""
    parts.select("group_id", "part").write.mode("overwrite").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def take_part(df: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    ids = parts.filter(F.col("part") == part).select(F.col("group_id").alias(key))
    return df.join(ids, key, "left_semi")


METRICS = "f1_macro double, accuracy double, mse double, rmse double, mae double, r2 double"
REPORT_CARD = (
    f"iteration string, timestamp string, n_features long, "
    f"classification map<string, struct<{METRICS}>>, "
    f"regression map<string, struct<{METRICS}>>, _corrupt_record string"
)


def load_report_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per (run, task, model) from nested JSON files; unreadable files are skipped."""
    cards = (
        spark.read.schema(REPORT_CARD)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("file", F.input_file_name())
        .filter(F.col("_corrupt_record").isNull() & F.col("iteration").isNotNull())
    )
    number = F.regexp_extract("iteration", r"(\d+)", 1).try_cast("int")
    parts = []
    for task in ("classification", "regression"):
        parts.append(
            cards.select(
                number.alias("run"),
                "iteration",
                "n_features",
                F.lit(task).alias("task"),
                F.explode(task).alias("model", "m"),
            ).select("run", "iteration", "n_features", "task", "model", "m.*")
        )
    return parts[0].unionByName(parts[1]).orderBy("run", "task", "model")


def compare_runs(cards: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric change from the previous run of the same task and model.

    The window covers one model's run history, one row per run.
    """
    order = Window.partitionBy("task", "model").orderBy("run")
    return cards.withColumns(
        {f"{m}_delta": F.col(m) - F.lag(m).over(order) for m in metrics}
    )


def versioned_write(df: DataFrame, root: str, stamp: str, score: float) -> str:
    """Archive one copy under time and score, then make it the latest version."""
    archive = f"{root}/archive/run_ts={stamp}/score={score:.5f}"
    df.write.mode("errorifexists").parquet(archive)
    df.sparkSession.read.parquet(archive).write.mode("overwrite").parquet(f"{root}/latest")
    return archive
