"""Features of rows relative to their group, leakage-safe priors, and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale

ALPHA = 20.0


def relevance_grade(booked: Column, clicked: Column) -> Column:
    """5 for a booking, 1 for a click only, 0 otherwise."""
    return F.when(booked == 1, 5).when(clicked == 1, 1).otherwise(0)


def grade_index(grade: Column) -> Column:
    return F.when(grade == 5, 2).when(grade == 1, 1).otherwise(0)


def zscore_in_group(df: DataFrame, group: Sequence[str], value: Column, out: str) -> DataFrame:
    """Standard score inside the group; a missing or zero spread counts as 1."""
    rows = df.withColumn("_x", value)
    rows = scale.with_group_stats(
        rows, group, {"_mean": F.avg("_x"), "_sd": F.stddev_samp("_x")}
    )
    spread = F.coalesce(F.when(F.col("_sd") > 0, F.col("_sd")), F.lit(1.0))
    return rows.withColumn(out, (F.col("_x") - F.col("_mean")) / spread).drop("_x", "_mean", "_sd")


def delta_to_group_mean(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    rows = scale.with_group_stats(df, group, {f"_mean_{c}": F.avg(c) for c in cols})
    return rows.withColumns({f"{c}_delta": F.col(c) - F.col(f"_mean_{c}") for c in cols}).drop(
        *[f"_mean_{c}" for c in cols]
    )


def within_group_features(
    df: DataFrame,
    group: Sequence[str],
    price: str,
    deltas: Sequence[str],
    oversized: DataFrame | None = None,
) -> DataFrame:
    """Price rank, log-price z-score and deltas to the group mean.

    Ranks sort a group in one task, so the group's statistics are taken where it lies: one exchange,
    and none if the rows arrive by group. If some groups are ``oversized``, statistics are an
    aggregate joined back.
    """
    logged = F.log1p(F.col(price))
    stats = {
        "_mean": F.avg(logged),
        "_sd": F.stddev_samp(logged),
        **{f"_mean_{c}": F.avg(c) for c in deltas},
    }
    if oversized is None:
        whole = Window.partitionBy(*group)
        rows = df.withColumns({name: stat.over(whole) for name, stat in stats.items()})
    else:
        rows = scale.with_group_stats(df, group, stats)
    spread = F.coalesce(F.when(F.col("_sd") > 0, F.col("_sd")), F.lit(1.0))
    rows = rows.withColumns(
        {
            f"{price}_z": (logged - F.col("_mean")) / spread,
            **{f"{c}_delta": F.col(c) - F.col(f"_mean_{c}") for c in deltas},
        }
    ).drop("_mean", "_sd", *[f"_mean_{c}" for c in deltas])
    return scale.rank_in_group(rows, group, price, f"{price}_rank", oversized=oversized)


def overall_rates(train: DataFrame, targets: Mapping[str, float]) -> dict[str, float]:
    """Mean of each target over the training rows, divided by the target's divisor."""
    row = train.agg(*[F.avg(t).alias(t) for t in targets]).first()
    return {t: (row[t] or 0.0) / divisor for t, divisor in targets.items()}


def _rates(train: DataFrame, targets: Mapping[str, float]) -> dict[str, Column]:
    """The same as one subquery: a scan of the targets without a shuffle."""
    rates = train.agg(
        F.struct(*[(F.avg(t) / F.lit(float(d))).alias(t) for t, d in targets.items()]).alias("r")
    ).scalar()
    return {t: rates[t] for t in targets}


def _sums(targets: Mapping[str, float]) -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(f"_sum_{t}") for t in targets]]


def smoothed_priors(
    train: DataFrame,
    keys: Sequence[str],
    targets: Mapping[str, float],
    alpha: float = ALPHA,
    rates: Mapping[str, float] | None = None,
) -> DataFrame:
    """Per key: log1p of the row count and (sum + alpha * rate) / (n + alpha) per target.

    ``targets`` maps a column to the divisor of its overall rate: a 0..5 grade is given
    divisor 5 although its sum is not rescaled.
    """
    sums = train.groupBy(*keys).agg(*_sums(targets))
    rate = rates or _rates(train, targets)
    return sums.select(
        *keys,
        F.log1p("_n").alias("impressions_log1p"),
        *[
            ((F.col(f"_sum_{t}") + F.lit(alpha) * rate[t]) / (F.col("_n") + alpha)).alias(f"{t}_rate")
            for t in targets
        ],
    )


def oof_priors(
    df: DataFrame,
    keys: Sequence[str],
    fold: str,
    targets: Mapping[str, float],
    alpha: float = ALPHA,
    rates: Mapping[str, float] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Attach smoothed priors that never see the row's own fold.

    ``fold`` is the training fold of a row, missing for rows outside the training part; those
    see all folds. Sums per (key, fold) are taken once, and a fold's prior is the key's total
    minus the fold's own sum. A key seen nowhere else gets the overall rate. ``source`` may
    name a narrower table of the training rows to take the sums from.
    """
    rate = rates or _rates(df.filter(F.col(fold).isNotNull()) if source is None else source, targets)
    joined = oof_sums(df, keys, fold, targets, source)
    made = joined.withColumns(oof_features(targets, rate, alpha))
    return made.drop("_n", *[f"_sum_{t}" for t in targets])


def oof_sums(
    df: DataFrame,
    keys: Sequence[str],
    fold: str,
    targets: Mapping[str, float],
    source: DataFrame | None = None,
    prefix: str = "",
) -> DataFrame:
    """Attach what ``oof_priors`` is made of: row count and sums of the other folds.

    Whole numbers, so rows that still have to move stay small.
    """
    keys = list(keys)
    measures = ["_n", *[f"_sum_{t}" for t in targets]]
    train = df.filter(F.col(fold).isNotNull()) if source is None else source
    per_fold = train.groupBy(*keys, fold).agg(*_sums(targets))
    # At most one row per fold and key.
    whole = Window.partitionBy(*keys)
    totals = per_fold.withColumns({f"_all{m}": F.sum(m).over(whole) for m in measures})
    totals = totals.withColumn("_first", F.row_number().over(whole.orderBy(fold)) == 1)
    # Each fold's row gives the prior of that fold; the first also gives the full prior (-1).
    fold_type = df.schema[fold].dataType
    none = F.lit(-1).cast(fold_type)
    folds = F.when(F.col("_first"), F.array(F.col(fold), none)).otherwise(F.array(F.col(fold)))
    seen = totals.withColumn("_fold", F.explode(folds)).select(
        *keys,
        "_fold",
        *[
            (F.col(f"_all{m}") - F.when(F.col("_fold") == F.col(fold), F.col(m)).otherwise(0)).alias(f"{prefix}{m}")
            for m in measures
        ],
    )
    # A key with no rows outside a fold needs no row: a missing sum is zero. Pairs of keys mostly occur once.
    seen = seen.filter(F.col(f"{prefix}_n") > 0)
    rows = df.withColumn("_fold", F.coalesce(F.col(fold), none))
    return scale.join_lookup(rows, seen, [*keys, "_fold"]).drop("_fold")


def oof_features(
    targets: Mapping[str, float],
    rate: Mapping[str, float] | Mapping[str, Column],
    alpha: float = ALPHA,
    prefix: str = "",
    out: str = "",
) -> dict[str, Column]:
    """The priors from the sums that ``oof_sums`` attached."""
    n = F.coalesce(F.col(f"{prefix}_n"), F.lit(0))
    features = {f"{out}impressions_log1p": F.log1p(n)}
    for t in targets:
        others = F.coalesce(F.col(f"{prefix}_sum_{t}"), F.lit(0))
        features[f"{out}{t}_rate"] = (others + F.lit(alpha) * rate[t]) / (n + alpha)
    return features


def apply_priors(
    df: DataFrame, priors: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column]
) -> DataFrame:
    """Left join of priors with defaults for unseen keys."""
    joined = scale.join_lookup(df, priors, keys)
    return joined.withColumns(
        {c: F.coalesce(F.col(c), default) for c, default in defaults.items()}
    )


def popularity_tertile(
    train: DataFrame, item: str, probs: tuple[float, float] = (1 / 3, 2 / 3)
) -> DataFrame:
    """Item -> low / medium / high by its number of training rows (cuts inclusive)."""
    counts = train.groupBy(item).agg(F.count(F.lit(1)).alias("impressions"))
    ((_, (low, high)),) = scale.quantile_values(counts, ["impressions"], list(probs)).values()
    n = F.col("impressions")
    return counts.withColumn(
        "popularity", F.when(n <= low, "low").when(n <= high, "medium").otherwise("high")
    )


def label_popularity(df: DataFrame, tertiles: DataFrame, item: str) -> DataFrame:
    """Unseen items count as low."""
    joined = scale.join_lookup(df, tertiles.select(item, "popularity"), [item])
    return joined.withColumn("popularity", F.coalesce("popularity", F.lit("low")))


def top_keys(train: DataFrame, key: str, k: int = 10) -> list:
    """The ``k`` most frequent key values (ties by value)."""
    counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[key] for r in counts.orderBy(F.desc("n"), key).limit(k).collect()]


def top_k_or_tail(df: DataFrame, train: DataFrame, key: str, out: str, k: int = 10) -> DataFrame:
    """The key itself if it is among the ``k`` most frequent training keys, else -1."""
    kept = top_keys(train, key, k)
    return df.withColumn(out, F.when(F.col(key).isin(kept), F.col(key)).otherwise(F.lit(-1)))


def bin_right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] that holds ``x``; outside is missing."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((x > lo) & (x <= hi), label).otherwise(out)
    return out


def cut_class(x: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts at or below ``x``."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (x >= F.lit(float(cut))).cast("int")
    return F.when(x.isNotNull(), out)


# Class cuts as training percentiles.
TERCILES = (33.33, 66.67)
QUINTILES = (20.0, 40.0, 60.0, 80.0)
MEDIAN = (50.0,)


def class_cuts(train: DataFrame, target: str, percents: Sequence[float] = TERCILES) -> list[float]:
    """Cut values from the training rows only."""
    ((_, cuts),) = scale.quantile_values(train, [target], [p / 100 for p in percents]).values()
    return cuts


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical index of a class label, for any number of labels; a missing one has none."""
    names = df.select(col).filter(F.col(col).isNotNull()).distinct()
    one = F.lit(1).cast("long")
    placed = scale.running_total(names, [], [col], one, out, limit=0)
    return scale.join_lookup(df, placed.withColumn(out, F.col(out).cast("int")), [col])
