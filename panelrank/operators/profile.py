"""Descriptive statistics, correlation and data checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.functions.stats import correlation, sample_kurtosis, sample_skew
from panelrank.operators import scale


def unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., column, value)."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return df.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def variable_stats(df: DataFrame) -> DataFrame:
    """Per variable: count, missing, mean, spread, median, ends."""
    x = F.col("value")
    moments = df.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x.isNull()).alias("missing"),
        (F.avg(x.isNull().cast("int")) * 100).alias("missing_pct"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    middle = scale.quantiles(df, ["value"], [0.5], by=["variable"])
    middle = middle.select("variable", F.col("q")[0].alias("median"))
    return scale.join_groups(moments, middle, ["variable"], "left")


def column_profile(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Per column: count, mean, spread, ends, share missing and zero, distinct values."""
    x = F.col("value")
    distinct = F.approx_count_distinct(x) if approximate else F.count_distinct(x)
    return (
        unpivot(df, cols)
        .groupBy("column")
        .agg(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            (F.avg(x.isNull().cast("int")) * 100).alias("missing_pct"),
            (F.avg(F.coalesce((x == 0).cast("int"), F.lit(0))) * 100).alias("zero_pct"),
            distinct.alias("n_unique"),
        )
    )


def column_classes(profile: DataFrame) -> DataFrame:
    """Columns by number of distinct values: binary, ternary, discrete (4-40), continuous."""
    n = F.col("n_unique")
    return profile.select(
        "column",
        "n_unique",
        F.when(n <= 1, "constant")
        .when(n == 2, "binary")
        .when(n == 3, "ternary")
        .when(n <= 40, "discrete")
        .otherwise("continuous")
        .alias("kind"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and percentage per value, missing included."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def value_counts_wide(df: DataFrame, cols: Sequence[str], values: Sequence) -> DataFrame:
    """One row per column, one count per listed value."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in cols
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    return long.groupBy("column").pivot("value", [str(v) for v in values]).agg(F.count(F.lit(1)))


def cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column."""
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in cols
                ]
            )
        ).alias("cell")
    )
    return long.groupBy("cell.column").agg(F.count_distinct("cell.value").alias("n_unique"))


def share_of_rows_in_other(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of the first table's rows whose key occurs in the second."""
    keys = b.select(key).distinct().withColumn("_hit", F.lit(1))
    return (
        a.select(key)
        .join(keys, key, "left")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("_hit").isNotNull().cast("int")).alias("share"),
        )
    )


def missing_matrix(panel: DataFrame, cols: Sequence[str], by: Sequence[str] = ("id",)) -> DataFrame:
    """Percentage missing per group and column; with no group, per column."""
    return panel.groupBy(*by).agg(
        *[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in cols]
    )


def group_sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))


def group_size_stats(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Number of groups and their size distribution, from counts per distinct size.

    n rows have at most sqrt(2 n) distinct group sizes, so the exact percentiles stay small.
    """
    sizes = group_sizes(df, group).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    points = F.percentile(
        "size", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n")
    )
    return sizes.agg(
        F.sum("n").alias("groups"),
        F.min("size").alias("min"),
        points.alias("_q"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("size").alias("max"),
    ).select(
        "groups",
        "min",
        F.col("_q")[0].alias("median"),
        "mean",
        F.col("_q")[1].alias("p95"),
        F.col("_q")[2].alias("p99"),
        "max",
    )


def group_size_ecdf(df: DataFrame, group: Sequence[str], limit: int = scale.SMALL_BYTES) -> DataFrame:
    """Share of groups with at most each size."""
    sizes = group_sizes(df, group).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    below = scale.running_total(sizes, [], ["size"], F.col("n"), "_below", limit=limit)
    return below.select("size", "n", ((F.col("_below") + F.col("n")) / total).alias("share"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bin counts (bin 1..bins, last bin closed), empty bins included."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, n long")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(col) - lo) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * width).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def mean_std_by(df: DataFrame, key: Column, name: str, value: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


class Products:
    """Sums over the rows where both columns i and j are present, each matrix [i, j].

    ``n`` rows, ``s`` of x_i, ``q`` of x_i squared, ``p`` of x_i x_j; values less ``middle``.
    """

    def __init__(self, k: int, middle: np.ndarray):
        self.middle = middle
        self.n, self.s, self.q, self.p = (np.zeros((k, k)) for _ in range(4))

    def correlations(self) -> np.ndarray:
        """Pearson r of every pair over its complete rows; not a number if a side is constant."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = self.s / self.n
            spread = np.sqrt(np.maximum(self.q / self.n - mean**2, 0.0))
            # What rounding leaves of a constant column, relative to its squares.
            flat = spread <= 1e-7 * np.sqrt(np.maximum(self.q / self.n, 1e-300))
            r = (self.p / self.n - mean * mean.T) / (spread * spread.T)
        return np.where(flat | flat.T | (self.n < 1), np.nan, np.clip(r, -1.0, 1.0))


def products(
    df: DataFrame, cols: Sequence[str], centred: bool = True, middle: np.ndarray | None = None
) -> Products:
    """Products of all column pairs with holes, in one pass (two with the means, unless ``middle`` has them).

    Every task multiplies values, squares and presence marks of its batches as matrices and sends
    one row per pair; equal pairs combine before and after the shuffle, so the driver gets
    (columns x columns) numbers.
    """
    k = len(cols)
    names = [f"c{i}" for i in range(k)]
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)])
    if middle is None and not centred:
        middle = np.zeros(k)
    if middle is None:
        middle = np.array([x or 0.0 for x in rows.agg(*[F.avg(n).alias(n) for n in names]).first()])
    upper = np.triu_indices(k)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(float) - middle
            there = ~np.isnan(x)
            mark, x = there.astype(float), np.where(there, x, 0.0)
            n += mark.T @ mark
            s += x.T @ mark
            q += (x * x).T @ mark
            p += x.T @ x
        i, j = upper
        yield pd.DataFrame(
            {"i": i, "j": j, "n": n[i, j], "a": s[i, j], "b": s[j, i], "c": q[i, j], "d": q[j, i], "p": p[i, j]}
        )

    cells = rows.mapInPandas(
        multiply, "i int, j int, n double, a double, b double, c double, d double, p double"
    )
    out = Products(k, middle)
    for r in cells.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in "nabcdp"]).collect():
        i, j = r["i"], r["j"]
        out.n[i, j] = out.n[j, i] = r["n"]
        out.s[i, j], out.s[j, i] = r["a"], r["b"]
        out.q[i, j], out.q[j, i] = r["c"], r["d"]
        out.p[i, j] = out.p[j, i] = r["p"]
    return out


def _pair_rows(df: DataFrame, cols: Sequence[str], r: np.ndarray, name: str) -> DataFrame:
    pairs = combinations(range(len(cols)), 2)
    rows = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, f"a string, b string, {name} double")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair over complete pairs; missing if a side is constant."""
    return _pair_rows(df, cols, products(df, cols).correlations(), "r")


def correlation_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    y = F.col(target).cast("double")
    row = df.agg(*[correlation(F.col(c).cast("double"), y).alias(c) for c in cols])
    return unpivot(row, cols).select("column", F.col("value").alias("r"))


def top_correlated_pairs(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    return correlation_pairs(df, cols).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def _ranked(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Ranks of each column (see ``average_ranks``) and the mean rank of each column."""
    names = [f"c{i}" for i in range(len(cols))]
    rows = scale.cut_lineage(df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]))
    present = unpivot(rows, names).filter(F.col("value").isNotNull())
    counted = present.groupBy("column", "value").agg(F.count(F.lit(1)).alias("copies"))
    below = scale.running_total(counted, ["column"], ["value"], F.col("copies"), "below", limit=0)
    rank = (F.col("below") + (F.col("copies") + 1) / 2).alias("rank")
    ranks = scale.cut_lineage(below.select("column", "value", rank, "copies"))
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.sum("copies").alias("n")).collect()}
    for n in names:
        lookup = ranks.filter(F.col("column") == n).select(F.col("value").alias(n), F.col("rank").alias(f"r_{n}"))
        rows = scale.join_lookup(rows, lookup, [n]).drop(n)
    middle = np.array([(sizes[n] + 1) / 2 if n in sizes else 0.0 for n in names])
    return rows.select(*[F.col(f"r_{n}").alias(c) for c, n in zip(cols, names)]), middle


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column replaced by its ranks among its present values; ties share their mean rank.

    All columns are ranked together from one long table of distinct values with their counts, in
    range slices, so no column is sorted in one task; a missing value stays missing. Rows stay whole
    and take the ranks of one column after the other, so none has to be put together again.
    """
    return _ranked(df, cols)[0]


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rank correlation of column pairs, over the rows where both are present."""
    ranked, middle = _ranked(df, cols)
    return _pair_rows(df, cols, products(ranked, cols, middle=middle).correlations(), "rho")


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        correlation(a, b).alias("r"),
        F.regr_r2(b, a).alias("r2"),
    )


def shape_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    x = F.col("value")
    return (
        unpivot(df, cols)
        .groupBy("column")
        .agg(sample_skew(x).alias("skew"), sample_kurtosis(x).alias("kurtosis"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def same_timestamps_check(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per id: do all listed variables occur at exactly the same times?"""
    has = [F.max((F.col("variable") == v).cast("int")) for v in variables]
    total = has[0]
    for h in has[1:]:
        total = total + h
    per_time = (
        df.filter(F.col("variable").isin(list(variables)))
        .groupBy("id", "time")
        .agg(total.alias("_k"))
    )
    return per_time.groupBy("id").agg(
        F.count(F.lit(1)).alias("times"),
        (F.min("_k") == len(variables)).alias("all_equal"),
    )


def _seen_slots(df: DataFrame, variable: str, unit: str) -> tuple[DataFrame, int]:
    seconds = {"DAY": 86400, "HOUR": 3600}[unit]
    slot = F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / seconds)
    seen = df.filter(F.col("variable") == variable).select("id", slot.alias("_slot")).distinct()
    return seen, seconds


def missing_slots(df: DataFrame, variable: str, unit: str = "DAY") -> DataFrame:
    """Per id: slots between first and last observation, slots seen, slots missing."""
    seen, _ = _seen_slots(df, variable, unit)
    return (
        seen.groupBy("id")
        .agg(
            (F.max("_slot") - F.min("_slot") + 1).alias("expected"),
            F.count(F.lit(1)).alias("observed"),
        )
        .withColumn("missing", F.col("expected") - F.col("observed"))
    )


def missing_slot_list(df: DataFrame, variable: str, unit: str = "DAY") -> DataFrame:
    """The missing slots themselves: (id, slot), the start of each as a timestamp.

    A slot that is followed by a gap emits the gap, so nothing is joined with a calendar.
    """
    seen, seconds = _seen_slots(df, variable, unit)
    following = F.lead("_slot").over(Window.partitionBy("id").orderBy("_slot"))
    gaps = seen.withColumn("_next", following).filter(F.col("_next") - F.col("_slot") > 1)
    slots = gaps.select("id", F.explode(F.sequence(F.col("_slot") + 1, F.col("_next") - 1)).alias("s"))
    return slots.select("id", F.timestamp_seconds(F.col("s") * seconds).cast("timestamp_ntz").alias("slot"))


def conversion_rates(df: DataFrame, clicked: Column, booked: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(clicked).alias("click_rate"),
        F.avg(booked).alias("book_rate"),
        F.try_divide(F.sum(booked), F.sum(clicked)).alias("book_given_click"),
    )


def per_key_top_corr(
    panel: DataFrame, cols: Sequence[str], target: str, k: int = 15
) -> DataFrame:
    """Per id the ``k`` columns most correlated with the target."""
    y = F.col(target).cast("double")
    per_id = panel.groupBy("id").agg(
        *[correlation(F.col(c).cast("double"), y).alias(c) for c in cols]
    )
    long = unpivot(per_id, cols, ["id"]).filter(F.col("value").isNotNull())
    order = Window.partitionBy("id").orderBy(F.desc(F.abs(F.round("value", 9))), "column")
    return (
        long.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .select("id", "place", "column", F.col("value").alias("r"))
    )


def feature_union(top: DataFrame) -> DataFrame:
    return top.select("column").distinct()


def lag1_autocorr_per_id(panel: DataFrame, col: str, least: int = 10) -> DataFrame:
    """Correlation of neighbouring present values, for ids with more than ``least``."""
    order = Window.partitionBy("id").orderBy("date")
    rows = panel.filter(F.col(col).isNotNull()).withColumn("_prev", F.lag(col).over(order))
    return (
        rows.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), correlation(F.col(col), F.col("_prev")).alias("r"))
        .filter(F.col("n") > least)
    )


def acf_per_id(panel: DataFrame, col: str, lags: int = 14) -> DataFrame:
    """Autocorrelation of each id's present values (id, lag, r)."""
    order = Window.partitionBy("id").orderBy("date")
    whole = Window.partitionBy("id")
    rows = panel.filter(F.col(col).isNotNull())
    rows = rows.withColumn("_x", F.col(col) - F.avg(col).over(whole))
    rows = rows.withColumns({f"_l{k}": F.lag("_x", k).over(order) for k in range(1, lags + 1)})
    x = F.col("_x")
    sums = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x * x).alias("_c0"),
        *[F.sum(x * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), F.try_divide(f"_c{k}", F.when(F.col("_c0") > 1e-12, F.col("_c0"))).alias("r"))
            for k in range(1, lags + 1)
        ]
    )
    return sums.select("id", "n", F.explode(cells).alias("p")).select("id", "n", "p.*")


# Rows per block of the pooled series; each block repeats the last lags of the one before.
ACF_BLOCK = 4096


def acf_pooled(
    panel: DataFrame, col: str, lags: int = 14, limit: int = scale.SMALL_BYTES
) -> DataFrame:
    """Autocorrelation of all ids' de-meaned values in one series ordered by (id, date).

    Lags cross from one id to the next. Rows get their place in the series, then fall into
    blocks that overlap by ``lags`` rows, so no window spans the whole series.
    """
    whole = Window.partitionBy("id")
    rows = panel.filter(F.col(col).isNotNull()).select(
        "id", "date", (F.col(col) - F.avg(col).over(whole)).alias("_x")
    )
    placed = scale.running_total(rows, [], ["id", "date"], F.lit(1), "_place", limit=limit)
    place = F.col("_place")
    block = F.floor(place / ACF_BLOCK)
    blocks = F.when(
        place % ACF_BLOCK >= ACF_BLOCK - lags, F.array(block, block + 1)
    ).otherwise(F.array(block))
    spread = placed.withColumn("_own", block).withColumn("_block", F.explode(blocks))
    order = Window.partitionBy("_block").orderBy("_place")
    lagged = spread.withColumns(
        {f"_l{k}": F.lag("_x", k).over(order) for k in range(1, lags + 1)}
    ).filter(F.col("_own") == F.col("_block"))
    x = F.col("_x")
    sums = lagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x * x).alias("_c0"),
        *[F.sum(x * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.col("_c0")).alias("r"))
            for k in range(1, lags + 1)
        ]
    )
    return sums.select(
        "n", (F.lit(1.96) / F.sqrt("n")).alias("band"), F.explode(cells).alias("p")
    ).select("p.*", "n", "band")


def pacf_per_id(panel: DataFrame, col: str, lags: int = 7) -> DataFrame:
    """Partial autocorrelation per id by the Durbin-Levinson recursion on its acf."""
    acf = acf_per_id(panel, col, lags)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        r = np.concatenate([[1.0], rows["r"].to_numpy(float)])
        m = len(r) - 1
        out = np.full(m, np.nan)
        phi = np.zeros((m + 1, m + 1))
        if np.isfinite(r).all():
            for k in range(1, m + 1):
                gone = 1.0 - phi[k - 1, 1:k] @ r[1:k]
                if abs(gone) < 1e-12:
                    break
                phi[k, k] = (r[k] - phi[k - 1, 1:k] @ r[k - 1 : 0 : -1]) / gone
                for j in range(1, k):
                    phi[k, j] = phi[k - 1, j] - phi[k, k] * phi[k - 1, k - j]
                out[k - 1] = phi[k, k]
        return pd.DataFrame({"id": rows["id"], "lag": rows["lag"], "pacf": out})

    id_type = panel.schema["id"].dataType.simpleString()
    solved = acf.groupBy("id").applyInPandas(solve, f"id {id_type}, lag int, pacf double")
    return solved.withColumn("pacf", F.nanvl("pacf", F.lit(None).cast("double")))


def ljung_box(acf: DataFrame) -> DataFrame:
    """Portmanteau statistic and p-value per lag from an acf table (lag, r, n)."""
    from panelrank.functions.stats import chi2_tail

    # One row per lag.
    upto = Window.partitionBy("n").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))).over(upto)
    return acf.select(
        "lag", (F.col("n") * (F.col("n") + 2) * share).alias("q")
    ).withColumn("p_value", chi2_tail("q", F.col("lag").cast("double")))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Uncentred variance inflation from the columns' Gram matrix over complete rows."""
    gram = products(df.select(*cols).na.drop(), cols, centred=False).p
    scales = np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(gram / np.outer(scales, scales))
    table = [(c, float(inverse[i, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(table, "column string, vif double")


def boxplot_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    q = F.col("q")
    return scale.quantiles(df, [col], [0.0, 0.25, 0.5, 0.75, 1.0], by=by).select(
        *by,
        "n",
        q[0].alias("min"),
        q[1].alias("q1"),
        q[2].alias("median"),
        q[3].alias("q3"),
        q[4].alias("max"),
    )
