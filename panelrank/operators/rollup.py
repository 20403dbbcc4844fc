"""Long measurements to a daily panel, calendars, and within-day summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = Mapping[str, tuple[str, str]]


def filter_variables(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.filter(F.col("variable").isin(list(variables)))


def _rule(variable: str, how: str) -> Column:
    here = F.col("variable") == variable
    value = F.when(here, F.col("value"))
    present = F.count_if(here) > 0
    if how == "mean":
        return F.avg(value)
    if how == "sum":
        return F.when(present, F.coalesce(F.sum(value), F.lit(0.0)))
    if how == "count":
        return F.when(present, F.count(value).cast("double"))
    raise ValueError(f"unknown rule {how!r}")


def daily_rollup(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per (id, date), one column per rule ``{name: (variable, mean|sum|count)}``.

    An all-missing group sums to 0, counts 0 and has no mean; an absent group is missing.
    One shuffle with map-side combine, whatever the number of variables.
    """
    used = sorted({variable for variable, _ in rules.values()})
    return (
        filter_variables(df, used)
        .groupBy("id", "date")
        .agg(*[_rule(v, how).alias(name) for name, (v, how) in rules.items()])
    )


def resample(df: DataFrame, step: str, how: str = "mean") -> DataFrame:
    """Tumbling bins per (id, variable): duplicates at one time are averaged first.

    Bins run from the first to the last observation; an empty one has mean missing, sum 0.
    """
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown aggregate {how!r}")
    once = df.groupBy("id", "variable", "time").agg(F.avg("value").alias("value"))
    binned = once.withColumn("slot", F.window("time", step)["start"])
    agg = F.avg("value") if how == "mean" else F.coalesce(F.sum("value"), F.lit(0.0))
    rows = binned.groupBy("id", "variable", "slot").agg(agg.alias("value"))
    order = Window.partitionBy("id", "variable").orderBy("slot")
    width = F.expr(f"INTERVAL {step}")
    upto = F.coalesce(F.lead("slot").over(order) - width, F.col("slot"))
    empty = F.lit(None).cast("double") if how == "mean" else F.lit(0.0)
    return (
        rows.withColumn("_upto", upto)
        .withColumn("_slot", F.explode(F.sequence("slot", "_upto", width)))
        .select(
            "id",
            "variable",
            F.col("_slot").alias("slot"),
            F.when(F.col("_slot") == F.col("slot"), F.col("value")).otherwise(empty).alias("value"),
        )
    )


def calendar_fill(daily: DataFrame, span: str = "id", target: str | None = None) -> DataFrame:
    """Add the missing days of every id as rows of missing values.

    ``span``: ``id`` runs from the id's first to last day, ``target`` from its first to last
    day with a target value, ``global`` over the whole table's range. Each row emits itself
    and the empty days up to the next row, so no calendar is joined and the shuffle by id
    also serves the windows that follow.
    """
    cols = [c for c in daily.columns if c not in ("id", "date")]
    order = Window.partitionBy("id").orderBy("date")
    rows = daily
    if span == "target":
        if target is None:
            raise ValueError("span='target' needs a target column")
        whole = Window.partitionBy("id")
        seen = F.when(F.col(target).isNotNull(), F.col("date"))
        rows = (
            rows.withColumn("_lo", F.min(seen).over(whole))
            .withColumn("_hi", F.max(seen).over(whole))
            .filter(F.col("date").between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi")
        )
    elif span not in ("id", "global"):
        raise ValueError(f"unknown span {span!r}")
    rows = rows.withColumn("_next", F.date_sub(F.lead("date").over(order), 1))
    start, end = F.col("date"), F.coalesce(F.col("_next"), F.col("date"))
    if span == "global":
        rows = rows.withColumn("_first", F.lag("date").over(order).isNull())
        lo = daily.agg(F.min("date")).scalar()
        hi = daily.agg(F.max("date")).scalar()
        start = F.when(F.col("_first"), lo).otherwise(F.col("date"))
        end = F.coalesce(F.col("_next"), hi)
    filled = rows.withColumn("_start", start).withColumn("_end", end)
    return filled.withColumn("_day", F.explode(F.sequence("_start", "_end"))).select(
        "id",
        F.col("_day").alias("date"),
        *[F.when(F.col("_day") == F.col("date"), F.col(c)).alias(c) for c in cols],
    )


def first_last_by_time(df: DataFrame, variable: str) -> DataFrame:
    """First and last value of a variable per (id, date)."""
    rows = df.filter((F.col("variable") == variable) & F.col("value").isNotNull())
    return rows.groupBy("id", "date").agg(
        F.min_by("value", F.struct("time", "value")).alias("first_value"),
        F.max_by("value", F.struct("time", "value")).alias("last_value"),
    )


def time_of_day_means(df: DataFrame, variable: str) -> DataFrame:
    """Morning (hours 8-12) and evening (18-22) mean and evening minus morning."""
    hour = F.hour("time")
    return (
        df.filter(F.col("variable") == variable)
        .groupBy("id", "date")
        .agg(
            F.avg(F.when(hour.between(8, 12), F.col("value"))).alias("morning"),
            F.avg(F.when(hour.between(18, 22), F.col("value"))).alias("evening"),
        )
        .filter(F.col("morning").isNotNull() | F.col("evening").isNotNull())
        .withColumn("day_slope", F.col("evening") - F.col("morning"))
    )


def day_night_split(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Per variable the mean or sum by day (hours 7-21) and by night."""
    hour = F.hour("time")
    day = (hour >= 7) & (hour < 22)
    aggs = []
    for variable, how in rules.items():
        if how not in ("mean", "sum"):
            raise ValueError(f"unknown rule {how!r}")
        agg = F.avg if how == "mean" else F.sum
        here = F.col("variable") == variable
        aggs.append(agg(F.when(here & day, F.col("value"))).alias(f"{variable}_day"))
        aggs.append(agg(F.when(here & ~day, F.col("value"))).alias(f"{variable}_night"))
    return filter_variables(df, list(rules)).groupBy("id", "date").agg(*aggs)


def bed_wake(df: DataFrame) -> DataFrame:
    """Latest evening hour (18-23, then 0-4 as 24-28) and earliest morning hour (5-12) per day."""
    hour = F.hour("time")
    late = F.when(hour >= 18, hour).when(hour < 5, hour + 24)
    return df.groupBy("id", "date").agg(
        F.max(late).cast("double").alias("bed_time"),
        F.min(F.when((hour >= 5) & (hour < 13), hour)).cast("double").alias("wake_time"),
    )


def sleep_duration(panel: DataFrame) -> DataFrame:
    """Hours from the previous row's bed time to this row's wake time, if plausible."""
    order = Window.partitionBy("id").orderBy("date")
    bed = F.lag("bed_time").over(order)
    hours = F.lit(24.0) - bed + F.col("wake_time")
    return panel.withColumn(
        "sleep_hours", F.when((bed >= 15) & (hours > 0) & (hours < 16), hours)
    )


def measures_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("id", "date").agg(F.count(F.lit(1)).alias("measures"))


def days_per_id(df: DataFrame) -> DataFrame:
    return (
        measures_per_day(df)
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.avg("measures").alias("mean_measures"),
            F.max("measures").alias("max_measures"),
        )
    )
