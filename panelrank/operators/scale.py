"""Size checks and skew-safe building blocks.

Three rules hold across the library:

* A panel has one row per (id, day), so an id holds at most as many rows as the
  calendar has days. Windows over one id of a panel are bounded by that.
* Any other group (a search page, a variable, the whole table) may be arbitrarily
  large. It is reduced by aggregates with a map-side part, by a top-k window (which
  Spark limits before the shuffle), or it goes through ``running_total``, which cuts
  an ordered group into range slices.
* Nothing is broadcast by hint unless its row count is fixed by an argument.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest planner estimate (close to file size for scans) that one task is trusted to hold.
SMALL_BYTES = 16 * 1024 * 1024

# Rows, and bytes once written, of a lookup table that may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of one group that a single window task may sort.
LARGEST_GROUP = 5_000_000


def fits_one_task(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """True if the optimizer's own size estimate says one task can hold the table.

    Reads plan statistics only; no job runs. Estimates after joins are products and so
    err on the safe side.
    """
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table that one task could hold to all cores, by key if one is named.

    Such a table usually arrives as one file split, which would leave all other cores idle;
    a larger one comes in many splits and is left as it is.
    """
    if not fits_one_task(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="panelrank-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lost executors then cost a read, later uses read only the columns they need, and the
    planner knows the table's true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffled files are deleted when the job that made them ends.

    For a flow of jobs that each write a table or collect sums: none reads another's shuffles, which
    otherwise lie on the executors' disks until the driver happens to collect garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def oversized_groups(
    df: DataFrame, keys: Sequence[str], most: int = LARGEST_GROUP, limit: int = SMALL_BYTES
) -> DataFrame | None:
    """Keys of the groups with more than ``most`` rows, or None if there are none.

    Counts combine map-side and move only keys. There can be no more than rows / ``most``
    such keys, which is what allows them to be broadcast.
    """
    if fits_one_task(df, limit):
        return None
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > most)
        .select(*keys)
    )
    found = cut_lineage(found)
    return None if found.isEmpty() else found


def join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys of groups, where a missing key is a group like any other.

    The left side's keys and columns stay, then come the right side's other columns.
    """
    named = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for key, name in named.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return left.join(right, same, how).drop(*named.values())


def join_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a per-key table that may be tiny or huge.

    Beyond the size where the planner's own estimate settles it, the lookup is written once
    and counted: up to ``BROADCAST_ROWS`` rows go to every executor, so rows with few distinct
    keys are not shuffled onto a few tasks; more rows join by shuffle, where adaptive
    execution splits keys that are too frequent.
    """
    if not fits_one_task(lookup):
        lookup = cut_lineage(lookup)
        if fits_one_task(lookup, BROADCAST_BYTES) and lookup.count() <= BROADCAST_ROWS:
            lookup = F.broadcast(lookup)
    return df.join(lookup, list(keys), how)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    weight: Column,
    out: str,
    limit: int = SMALL_BYTES,
) -> DataFrame:
    """Sum of ``weight`` over the rows of the same group that sort before this row.

    ``group + order`` must identify a row; a missing group is a group like any other. A group
    of any size is spread over range slices: each slice is summed on its own, and slice
    totals (one row per slice and group) carry the offset. The slices are written to the
    shared folder first, so both uses see the same slice borders.
    """
    group = list(group)
    if fits_one_task(df, limit):
        before = (
            Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        )
        return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
    sliced = cut_lineage(
        df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    )
    before = (
        Window.partitionBy("_slice", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy("_slice", *group)
        .agg(F.sum(weight).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    return (
        sliced.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .transform(lambda rows: join_groups(rows, offsets, ["_slice", *group]))
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    limit: int = SMALL_BYTES,
) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group and column.

    Output: ``by..., column, n, q`` with ``q`` an array in the order of ``probs``. Values are
    first counted per distinct value; a table beyond ``limit`` is ranked in range slices
    instead of inside one aggregate buffer per column.
    """
    by = list(by)
    long = (
        df.select(
            *by,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                        for c in cols
                    ]
                )
            ).alias("cell"),
        )
        .select(*by, "cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
    )
    if fits_one_task(df, limit):
        return long.groupBy(*by, "column").agg(
            F.count("value").alias("n"),
            F.percentile("value", F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
        )
    keys = [*by, "column"]
    counted = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_copies"))
    ranked = running_total(counted, keys, ["value"], F.col("_copies"), "_below", limit=0)
    sizes = ranked.groupBy(*keys).agg(F.sum("_copies").alias("n"))
    first = F.col("_below")
    last = F.col("_below") + F.col("_copies") - 1
    wanted = join_groups(ranked, sizes, keys)
    aggs = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        for name, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(
                F.max(F.when(rank.between(first, last), F.col("value"))).alias(f"_{name}{i}")
            )
    picked = wanted.groupBy(*keys, "n").agg(*aggs)
    values = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n") - 1)
        values.append(
            F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position - F.floor(position))
        )
    return picked.select(*keys, "n", F.array(*values).alias("q"))


def quantile_values(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int = SMALL_BYTES
) -> dict[str, tuple[int, list[float]]]:
    """Whole-table quantiles as numbers: one row per named column reaches the driver."""
    return {
        row["column"]: (row["n"], list(row["q"]))
        for row in quantiles(df, cols, probs, limit=limit).collect()
    }


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    out: str,
    descending: bool = False,
    oversized: DataFrame | None = None,
) -> DataFrame:
    """Rank with ties sharing the lowest place; a missing value has no rank.

    Groups share one window. Those named by ``oversized`` (see ``oversized_groups``) are
    ranked over their distinct values in range slices and joined back.
    """
    group = list(group)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    plain = Window.partitionBy(*group).orderBy(order)
    place = F.when(F.col(value).isNotNull(), F.rank().over(plain)).cast("long")
    if oversized is None:
        return df.withColumn(out, place)
    large = F.broadcast(oversized)
    rest = join_groups(df, large, group, "left_anti").withColumn(out, place)
    rows = join_groups(df, large, group, "left_semi")
    counted = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    ranked = running_total(counted, group, [order], F.col("_copies"), "_ahead", limit=0)
    ranked = ranked.select(*group, value, (F.col("_ahead") + 1).cast("long").alias(out))
    return rest.unionByName(join_groups(rows, ranked, [*group, value], "left"))


def with_group_stats(
    df: DataFrame, group: Sequence[str], stats: dict[str, Column]
) -> DataFrame:
    """Attach whole-group aggregates to every row.

    Aggregate-and-join instead of an unframed window: the aggregate combines map-side, and
    adaptive execution may split a group's rows over several join tasks.
    """
    sums = df.groupBy(*group).agg(*[c.alias(name) for name, c in stats.items()])
    return join_groups(df, sums, group, "left")


def top_k_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, out: str = "pos"
) -> DataFrame:
    """The first ``k`` rows of every group with their position.

    Spark keeps at most ``k`` rows per group in each map task before it shuffles, so a
    group of any size stays small.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)
