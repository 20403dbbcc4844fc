"""Reports on prediction tables and grouped ranking metrics.

A class count table has one row per (true, predicted) pair, so everything after the first
aggregate is tiny whatever the input size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.functions.stats import correlation
from panelrank.operators import scale
from panelrank.operators.groups import cut_class

# --- classification and regression -------------------------------------------------------


def confusion_counts(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
        .agg(n.alias("n"))
        .filter(F.col("n") > 0)
    )


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every class that is true or predicted somewhere."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    n = F.col("n").cast("long")
    sides = F.array(
        F.struct(
            F.col("truth").alias("label"), n.alias("a"), zero.alias("p"), hit.cast("long").alias("h")
        ),
        F.struct(F.col("pred").alias("label"), zero.alias("a"), n.alias("p"), zero.alias("h")),
    )
    long = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    sums = long.groupBy(*by, "label").agg(
        F.sum("a").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )
    zeroed = lambda e: F.coalesce(e, F.lit(0.0))
    return sums.withColumns(
        {
            "precision": zeroed(F.try_divide("hits", "predicted")),
            "recall": zeroed(F.try_divide("hits", "support")),
            "f1": zeroed(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("support") + F.col("predicted"))),
        }
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy and macro F1 from class counts, per ``by``."""
    return class_scores(counts, by).groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
    )


def regression_report(
    df: DataFrame, truth: Column, pred: Column, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """n, MSE, RMSE, MAE and R2 in one aggregate."""
    w = F.lit(1) if weight is None else weight
    rows = df.select(
        *by, truth.cast("double").alias("_y"), pred.cast("double").alias("_p"), w.alias("_w")
    ).filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    error = F.col("_y") - F.col("_p")
    y, w = F.col("_y"), F.col("_w")
    n = F.sum(w)
    if weight is None:
        total = F.var_pop(y) * n
    else:
        total = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    sums = rows.groupBy(*by).agg(
        n.alias("n"),
        F.sum(w * error * error).alias("_sse"),
        F.sum(w * F.abs(error)).alias("_sae"),
        total.alias("_total"),
        F.sum(w * y * y).alias("_syy"),
    )
    n, total = F.col("n"), F.col("_total")
    # Weighted, the total is a difference of large sums: below this share it is only rounding.
    least = 0.0 if weight is None else 1e-12
    return sums.select(
        *by,
        "n",
        (F.col("_sse") / n).alias("mse"),
        F.sqrt(F.col("_sse") / n).alias("rmse"),
        (F.col("_sae") / n).alias("mae"),
        F.when(total > least * F.col("_syy"), F.lit(1.0) - F.col("_sse") / total).alias("r2"),
    )


def baselines(
    train: DataFrame, test: DataFrame, target: str, cuts: Sequence[float]
) -> DataFrame:
    """Majority class and training mean as predictors on the test rows.

    One aggregate over the training rows, one row per class (one more than ``cuts``), and two
    over the test rows, whose single results are joined.
    """
    label = cut_class(F.col(target), cuts)
    classes = (
        train.filter(F.col(target).isNotNull())
        .groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("total"))
        .collect()
    )
    majority = min(classes, key=lambda r: (-r["n"], r["label"]), default={"label": None})["label"]
    rows_seen = sum(r["n"] for r in classes)
    mean = sum(r["total"] for r in classes) / rows_seen if rows_seen else None
    rows = test.filter(F.col(target).isNotNull()).select(
        F.col(target).alias("y"),
        label.alias("truth"),
        F.lit(majority).cast(test.select(label.alias("l")).schema["l"].dataType).alias("pred"),
        F.lit(mean).cast("double").alias("mean"),
    )
    by_class = classification_report(confusion_counts(rows, "truth", "pred"))
    by_value = regression_report(rows, F.col("y"), F.col("mean")).drop("n")
    one = F.lit(1).alias("_one")
    return by_class.select("*", one).join(by_value.select("*", one), "_one").drop("_one")


def per_group_report(
    df: DataFrame, group: str, truth: str, pred: str, truth_class: str, pred_class: str
) -> DataFrame:
    """Macro F1, R2, MAE, mean and population spread per group."""
    classes = classification_report(
        confusion_counts(df, truth_class, pred_class, by=[group]), by=[group]
    ).drop("n")
    values = regression_report(df, F.col(truth), F.col(pred), by=[group])
    spread = df.groupBy(group).agg(
        F.avg(truth).alias("mean"), F.stddev_pop(truth).alias("std")
    )
    return values.join(classes, group).join(spread, group)


def residual_stats(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean, spread, shape and tail shares of truth minus prediction."""
    rows = df.select((F.col(truth) - F.col(pred)).alias("e"))
    e = F.col("e")
    middle = scale.quantiles(rows, ["e"], [0.5]).select(F.col("q")[0].alias("m"))
    return rows.agg(
        F.count(e).alias("n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("skew"),
        F.kurtosis(e).alias("kurtosis"),
        F.max(F.abs(e)).alias("max_abs"),
        F.avg((F.abs(e) <= 0.5).cast("int")).alias("within_half"),
        F.avg((F.abs(e) <= 1.0).cast("int")).alias("within_one"),
        F.count_if(F.abs(e) > 1.0).alias("beyond_one"),
    ).withColumn("median", middle.scalar())


def prediction_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(
        F.avg(gap).alias("mean_diff"),
        F.max(gap).alias("max_diff"),
        correlation(F.col(a), F.col(b)).alias("corr"),
    )


def hardest_share(
    df: DataFrame,
    truth: str,
    pred: str,
    other: str,
    key: Sequence[str],
    share: float = 0.1,
    limit: int = scale.SMALL_BYTES,
) -> DataFrame:
    """Squared error of two predictors on the rows hardest for the first, and on the rest.

    Rows without a truth or a first prediction take no part. Exactly floor(n * share) of the
    others (at least one) are hard; ties go by key. Errors are counted
    per distinct size, so only the rows that share the cut size are ordered.
    """
    rows = df.withColumns(
        {
            "_e": F.abs(F.col(truth) - F.col(pred)),
            "_a": F.pow(F.col(truth) - F.col(pred), 2),
            "_b": F.pow(F.col(truth) - F.col(other), 2),
        }
    ).filter(F.col("_e").isNotNull())
    sizes = rows.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    ranked = scale.running_total(sizes, [], [F.desc("_e")], F.col("_n"), "_ahead", limit=limit)
    total = rows.count()
    take = max(1, int(total * share))
    edge = (
        ranked.filter((F.col("_ahead") < take) & (F.col("_ahead") + F.col("_n") >= take)).first()
    )
    if edge is None:
        edge = {"_e": None, "_ahead": 0}
    at_edge = F.col("_e") == F.lit(edge["_e"])
    tied = rows.filter(at_edge).select("_a", "_b", *key)
    tied = scale.running_total(tied, [], list(key), F.lit(1), "_place", limit=limit)
    flagged = (
        rows.filter(~at_edge)
        .select((F.col("_e") > F.lit(edge["_e"])).alias("hard"), "_a", "_b")
        .unionByName(
            tied.select((F.col("_place") < take - edge["_ahead"]).alias("hard"), "_a", "_b")
        )
    )
    return flagged.groupBy("hard").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mse_first"), F.avg("_b").alias("mse_second")
    )


def threshold_sweep(
    df: DataFrame,
    train: DataFrame,
    truth: str,
    pred: str,
    low: Sequence[float] = (25, 30, 33, 35, 40),
    high: Sequence[float] = (60, 65, 67, 70, 75),
) -> DataFrame:
    """Macro F1 of three classes for every pair of training percentiles.

    All cuts together split each axis into a handful of cells; one aggregate counts the
    cells and every pair is evaluated on those counts.
    """
    percents = [*low, *high]
    ((_, cuts),) = scale.quantile_values(train, [truth], [p / 100 for p in percents]).values()
    cells = confusion_counts(
        df.select(
            cut_class(F.col(truth), sorted(cuts)).alias("t"),
            cut_class(F.col(pred), sorted(cuts)).alias("p"),
        ),
        "t",
        "p",
    ).collect()
    place = {p: sorted(cuts).index(c) + 1 for p, c in zip(percents, cuts, strict=True)}
    value = dict(zip(percents, cuts, strict=True))
    rows = []
    for a in low:
        for b in high:
            counts: dict[tuple[int, int], int] = {}
            for r in cells:
                pair = tuple((v >= place[a]) + (v >= place[b]) for v in (r["truth"], r["pred"]))
                counts[pair] = counts.get(pair, 0) + r["n"]
            rows += [
                (float(a), float(b), value[a], value[b], t, p, n)
                for (t, p), n in counts.items()
            ]
    table = df.sparkSession.createDataFrame(
        rows, "low double, high double, cut_low double, cut_high double, truth int, pred int, n long"
    )
    by = ["low", "high", "cut_low", "cut_high"]
    return classification_report(table, by).drop("n")


def summary_mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
    )


def row_mean(cols: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return total / len(cols)


def seed_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and sample spread over runs."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in cols],
    )


# --- ranking ------------------------------------------------------------------------------

GRADES = (5, 1)


def _discount(position: int) -> float:
    return 1.0 / math.log2(position + 1)


def _ideal(k: int, grades: Sequence[int]) -> Column:
    """Best possible gain from the number of rows per grade (``_g{grade}`` columns)."""
    total = F.lit(0.0)
    for position in range(1, k + 1):
        upto = F.lit(0)
        gain = F.lit(None).cast("double")
        for grade in grades:
            upto = upto + F.col(f"_g{grade}")
            gain = F.coalesce(
                gain, F.when(upto >= position, F.lit(grade * _discount(position)))
            )
        total = total + F.coalesce(gain, F.lit(0.0))
    return total


def _gain(rel: str, k: int, pos: str = "pos") -> Column:
    gain = F.lit(0.0)
    for position in range(1, k + 1):
        gain = F.when(F.col(pos) == position, F.col(rel) * _discount(position)).otherwise(gain)
    return gain


def _grade_counts(rel: str, grades: Sequence[int]) -> list[Column]:
    return [F.count_if(F.col(rel) == g).alias(f"_g{g}") for g in grades]


def _normalised(k: int, grades: Sequence[int], dcg: str = "_dcg") -> Column:
    return F.coalesce(F.try_divide(F.col(dcg), _ideal(k, grades)), F.lit(0.0))


def ndcg_per_group(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    score: str,
    tie: Sequence[str],
    k: int = 5,
    grades: Sequence[int] = GRADES,
) -> DataFrame:
    """NDCG@k per group with linear gain; a group without positives scores 0.

    Grades are a fixed short list, so the ideal order follows from counts per grade and only
    the top ``k`` rows by score are ever sorted.
    """
    group = list(group)
    top = scale.top_k_in_group(
        df.select(*group, rel, score, *tie), group, [F.desc(score), *tie], k
    )
    reached = top.groupBy(*group).agg(F.sum(_gain(rel, k)).alias("_dcg"))
    counts = df.groupBy(*group).agg(*_grade_counts(rel, grades))
    return counts.join(reached, group).select(*group, _normalised(k, grades).alias("ndcg"))


def ndcg(df: DataFrame, group: Sequence[str], rel: str, score: str, tie: Sequence[str], k: int = 5) -> DataFrame:
    return ndcg_per_group(df, group, rel, score, tie, k).agg(
        F.count(F.lit(1)).alias("groups"), F.avg("ndcg").alias("ndcg")
    )


def ndcg_by(scores: DataFrame, labels: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Mean NDCG per label of a group."""
    return (
        scores.join(labels, list(group))
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("groups"), F.avg("ndcg").alias("ndcg"))
    )


def group_first(df: DataFrame, group: Sequence[str], col: str, tie: Sequence[str]) -> DataFrame:
    """The column's value on each group's first row."""
    return df.groupBy(*group).agg(F.min_by(col, F.struct(*tie)).alias(col))


def segment_cells(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    score: str,
    segment: str,
    tie: Sequence[str],
    k: int = 5,
    grades: Sequence[int] = GRADES,
) -> DataFrame:
    """Per (group, segment): positives, share of the top slots, and the group's NDCG.

    The top ``k`` is limited before the shuffle and joined to counts, so a group may have any
    size. A group has at most one cell per segment, and segments are a handful of labels.
    """
    group = list(group)
    share = F.col("_shown") / F.lit(float(k))
    counts = [
        F.count_if(F.col(rel) > 0).alias("positives"),
        *_grade_counts(rel, grades),
    ]
    shown = [
        F.count_if(F.col("pos") <= k).alias("_shown"),
        F.sum(F.when(F.col("pos") <= k, _gain(rel, k)).otherwise(0.0)).alias("_dcg"),
    ]
    order = [F.desc(score), *tie]
    rows = df.select(*group, segment, rel, score, *tie)
    top = scale.top_k_in_group(rows, group, order, k)
    cells = scale.join_groups(
        df.groupBy(*group, segment).agg(*counts),
        top.groupBy(*group, segment).agg(*shown),
        [*group, segment],
        "left",
    ).fillna(0, ["_shown", "_dcg"])
    whole = Window.partitionBy(*group)
    sums = {c: F.sum(c).over(whole) for c in ("_dcg", *[f"_g{g}" for g in grades])}
    return (
        cells.withColumn("share", share)
        .withColumns({**sums, "_cell": F.row_number().over(whole.orderBy(segment))})
        .withColumns({"ndcg": _normalised(k, grades), "first_cell": F.col("_cell") == 1})
        .select(*group, segment, "positives", "share", "ndcg", "first_cell")
    )


def segment_metrics(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    score: str,
    segment: str,
    tie: Sequence[str],
    k: int = 5,
    least_groups: int = 500,
    least_positives: int = 100,
) -> DataFrame:
    """NDCG and exposure per segment over the groups that hold a positive of the segment."""
    cells = segment_cells(df, group, rel, score, segment, tie, k)
    return (
        cells.filter(F.col("positives") > 0)
        .groupBy(segment)
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("positives").alias("positives"),
            F.avg("ndcg").alias("ndcg"),
            F.avg("share").alias("exposure"),
        )
        .withColumn(
            "supported",
            (F.col("groups") >= least_groups) & (F.col("positives") >= least_positives),
        )
    )


# Segments whose boosts may become literals of a plan.
MOST_SEGMENTS = 1000


def exposure_boosts(metrics: DataFrame, segment: str) -> dict:
    """Segment -> -ln(exposure), floored at 1e-6. Segments must be a short list of labels."""
    rows = metrics.select(segment, "exposure").limit(MOST_SEGMENTS + 1).collect()
    if len(rows) > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments; label a tail first")
    return {r[segment]: -math.log(max(r["exposure"], 1e-6)) for r in rows}


def boost_column(boosts: Mapping, segment: str) -> Column:
    pairs = [F.lit(v) for key, boost in boosts.items() for v in (key, float(boost))]
    return F.coalesce(F.create_map(*pairs)[F.col(segment)], F.lit(0.0))


def rerank(df: DataFrame, score: str, segment: str, boosts: Mapping, strength: float) -> DataFrame:
    return df.withColumn(score, F.col(score) + strength * boost_column(boosts, segment))


LAMBDAS = (0.0, 0.01, 0.02, 0.05, 0.10, 0.20)


def lambda_sweep(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    score: str,
    segment: str,
    boosts: Mapping,
    tie: Sequence[str],
    lambdas: Sequence[float] = LAMBDAS,
    tolerance: float = 0.005,
    k: int = 5,
) -> DataFrame:
    """NDCG and exposure per boost strength, with the strongest admissible one marked.

    Admissible: NDCG falls by at most ``tolerance`` and the exposure of low and medium rises.
    """
    rows = df.select(*group, segment, rel, score, *tie)
    spread = rows.withColumn(
        "lambda", F.explode(F.array(*[F.lit(float(v)) for v in lambdas]))
    ).withColumn("_s", F.col(score) + F.col("lambda") * boost_column(boosts, segment))
    cells = segment_cells(spread, ["lambda", *group], rel, "_s", segment, tie, k)
    rows = cells.groupBy("lambda").agg(
        F.avg(F.when(F.col("first_cell"), F.col("ndcg"))).alias("ndcg"),
        *[
            F.coalesce(
                F.avg(
                    F.when((F.col(segment) == name) & (F.col("positives") > 0), F.col("share"))
                ),
                F.lit(0.0),
            ).alias(f"exposure_{name}")
            for name in ("low", "medium", "high")
        ],
    )
    # One row per strength from here on.
    table = [tuple(r) for r in rows.collect()]
    base = next((r for r in table if r[0] == 0.0), None)
    fit = [
        r[0]
        for r in table
        if base is not None
        and r[1] >= base[1] - tolerance
        and r[2] > base[2]
        and r[3] > base[3]
    ]
    best = max(fit, default=0.0)
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in table],
        "lambda double, ndcg double, exposure_low double, exposure_medium double, "
        "exposure_high double, chosen boolean",
    )


def blend(a: Sequence[str], b: str, weight: Column) -> Column:
    """(1 - w) * mean of the first scores + w * the second."""
    return (F.lit(1.0) - weight) * row_mean(a) + weight * F.col(b)


def blend_sweep(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    a: Sequence[str],
    b: str,
    tie: Sequence[str],
    weights: Sequence[float],
    k: int = 5,
    largest: int = scale.LARGEST_GROUP,
) -> DataFrame:
    """Mean NDCG per blend weight; the ideal order is counted once for all weights.

    Rows move once, by group, and are put in order once per weight where they are. Groups with more
    than ``largest`` rows keep the top rows of every weight in each task before they move instead.
    """
    group = list(group)
    rows = df.select(*group, rel, *a, b, *tie)
    large = scale.oversized_groups(df.select(*group), group, largest)
    if large is None:
        parts = [_blends_in_place(rows, group, rel, a, b, tie, weights, k)]
    else:
        large = F.broadcast(large)
        rest = scale.join_groups(rows, large, group, "left_anti")
        rows = scale.join_groups(rows, large, group, "left_semi")
        parts = [
            _blends_in_place(rest, group, rel, a, b, tie, weights, k),
            _blends_by_top_rows(rows, group, rel, a, b, tie, weights, k),
        ]
    return reduce(DataFrame.unionByName, parts).groupBy("weight").agg(F.avg("ndcg").alias("ndcg"))


def _blends_in_place(rows, group, rel, a, b, tie, weights, k) -> DataFrame:
    """(weight, ndcg) per weight and group, one window per weight over one exchange."""
    for n, w in enumerate(weights):
        order = Window.partitionBy(*group).orderBy(F.desc("_s"), *tie)
        rows = rows.withColumn("_s", blend(a, b, F.lit(float(w)))).withColumn(f"_pos{n}", F.row_number().over(order))
    sums = [F.sum(_gain(rel, k, f"_pos{n}")).alias(f"_dcg{n}") for n in range(len(weights))]
    scored = rows.groupBy(*group).agg(*sums, *_grade_counts(rel, GRADES))
    cells = [
        F.struct(F.lit(float(w)).alias("weight"), _normalised(k, GRADES, f"_dcg{n}").alias("ndcg"))
        for n, w in enumerate(weights)
    ]
    return scored.select(F.inline(F.array(*cells)))


def _blends_by_top_rows(rows, group, rel, a, b, tie, weights, k) -> DataFrame:
    """The same, for groups of any size."""
    spread = rows.withColumn(
        "weight", F.explode(F.array(*[F.lit(float(w)) for w in weights]))
    )
    spread = spread.select(
        "weight", *group, rel, *tie, blend(a, b, F.col("weight")).alias("_s")
    )
    keys, order = ["weight", *group], [F.desc("_s"), *tie]
    gain = F.sum(_gain(rel, k)).alias("_dcg")
    counts = rows.groupBy(*group).agg(*_grade_counts(rel, GRADES))
    top = scale.top_k_in_group(spread, keys, order, k)
    scored = scale.join_groups(top.groupBy(*keys).agg(gain), counts, group)
    return scored.select("weight", _normalised(k, GRADES).alias("ndcg"))


def worst_groups(
    df: DataFrame,
    group: Sequence[str],
    rel: str,
    score: str,
    tie: Sequence[str],
    show: int = 3,
    rows: int = 8,
    k: int = 5,
) -> DataFrame:
    """First rows of the first groups that score 0 although they hold positives."""
    positives = df.groupBy(*group).agg(F.max(rel).alias("_best"))
    bad = (
        ndcg_per_group(df, group, rel, score, tie, k)
        .join(positives, list(group))
        .filter((F.col("ndcg") == 0) & (F.col("_best") > 0))
        .select(*group)
        .orderBy(*group)
        .limit(show)
    )
    return scale.top_k_in_group(
        df.join(F.broadcast(bad), list(group), "left_semi"), group, [F.desc(score), *tie], rows
    )


def rank_submission(
    df: DataFrame, group: str, item: str, score: str, tie: Sequence[str]
) -> DataFrame:
    """Items of every group by falling score, with their position in the group.

    Groups lie in ranges and are ranked there, so the order of the result costs no second move; if
    one is too large for one task, all are ranked in range slices. The rows come out in order.
    """
    order = [F.desc(score), *tie]
    rows = df.select(group, item, score, *[c for c in tie if c != item])
    if scale.oversized_groups(df.select(group), [group]) is None:
        # Written first: borders of ranges are drawn from a pass of its own.
        whole = rows if scale.fits_one_task(rows) else scale.cut_lineage(rows)
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        ranged = whole.repartitionByRange(F.asc(group)).withColumn("position", place.cast("long"))
        return ranged.orderBy(group, "position").select(group, item, "position")
    placed = scale.running_total(rows, [group], order, F.lit(1), "_ahead")
    return placed.orderBy(group, "_ahead").select(
        group, item, (F.col("_ahead") + 1).cast("long").alias("position")
    )


def check_submission(submission: DataFrame, source: DataFrame, group: str, item: str) -> DataFrame:
    """Row and group counts of submission and source, and duplicated (group, item) pairs."""
    copies = submission.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    got = copies.agg(
        F.sum("n").alias("rows"),
        F.count_distinct(group).alias("groups"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )
    return got.withColumns(
        {
            "expected_rows": source.agg(F.count(F.lit(1))).scalar(),
            "expected_groups": source.agg(F.count_distinct(group)).scalar(),
        }
    )


def position_rates(df: DataFrame, position: str, flag: str, booked: Column) -> DataFrame:
    """Booking rate by position, side by side for flagged and unflagged pages."""
    return df.groupBy(position).agg(
        F.avg(F.when(F.col(flag) == 1, booked)).alias("rate_flagged"),
        F.avg(F.when(F.col(flag) == 0, booked)).alias("rate_plain"),
    )
