"""Leakage-safe splits. Random choices order or bucket a hash of the id, so they repeat."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrank.operators import scale


def hash_key(*cols: str, seed: int = 42) -> Column:
    """Hash of the columns and the seed; a missing value is a value of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def hash_code(*cols: str, seed: int = 42) -> Column:
    """First 32 bits of the md5 of key and seed as 8 hex digits, which sort like the number."""
    return F.substring(hash_key(*cols, seed=seed), 1, 8)


def hex_cut(share: float) -> str:
    """Smallest code at or above a share of the code range."""
    return f"{min(math.ceil(share * 2**32), 2**32 - 1):08x}"


def hash_bucket(n: int, *cols: str, seed: int = 42) -> Column:
    """Bucket 0..n-1: equal ranges of the hash code, told apart by string comparison."""
    if n > MOST_RANGES:
        return F.floor(uniform(*cols, seed=seed) * n).cast("int")

    def bucket(code: Column) -> Column:
        out = F.lit(0)
        for i in range(1, n):
            out = out + (code >= hex_cut(i / n)).cast("int")
        return out

    return evaluated_once(hash_code(*cols, seed=seed), bucket)


# Beyond this many ranges arithmetic on the number is cheaper than comparisons.
MOST_RANGES = 16


def uniform(*cols: str, seed: int = 42) -> Column:
    """Number in [0, 1) from the key's hash."""
    return F.conv(hash_code(*cols, seed=seed), 16, 10).cast("double") / 2**32


def evaluated_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a costly ``value`` computed once however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _dates(df: DataFrame) -> list:
    """The distinct days of a table: as many as the calendar has."""
    return [r["date"] for r in df.select("date").distinct().orderBy("date").collect()]


def split_by_date(df: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Rows from the cutoff day on are test; the cutoff is a position in the sorted days."""
    days = _dates(df)
    cutoff = days[int(len(days) * (1 - test_fraction))]
    return df.withColumn("part", F.when(F.col("date") < F.lit(cutoff), "train").otherwise("test"))


def split_leave_groups_out(df: DataFrame, group: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` whole groups, the first in hash order, become test."""
    ids = df.select(group).distinct()
    held = [r[group] for r in ids.orderBy(hash_key(group, seed=seed), group).limit(n).collect()]
    return df.withColumn("part", F.when(F.col(group).isin(held), "test").otherwise("train"))


def split_per_id(panel: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """The last share of each id's rows is test."""
    order = Window.partitionBy("id").orderBy("date")
    whole = Window.partitionBy("id")
    train_rows = F.floor(F.count(F.lit(1)).over(whole) * F.lit(1 - test_fraction))
    return panel.withColumn(
        "part", F.when(F.row_number().over(order) <= train_rows, "train").otherwise("test")
    )


def split_groups(
    df: DataFrame, group: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42
) -> DataFrame:
    """Whole groups to train / val / holdout by hash threshold: no shuffle, any number of groups."""
    train, val = shares
    code = hash_code(group, seed=seed)
    return df.withColumn(
        "part",
        F.when(code < hex_cut(train), "train")
        .when(code < hex_cut(train + val), "val")
        .otherwise("holdout"),
    )


def check_split(parts: DataFrame, group: str) -> DataFrame:
    """Groups, groups in more than one part, and rows without a part."""
    per_group = parts.groupBy(group).agg(
        F.min("part").alias("_a"), F.max("part").alias("_b"), F.count_if(F.col("part").isNull()).alias("_none")
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("_a") != F.col("_b")).alias("torn_groups"),
        F.sum("_none").alias("unassigned_rows"),
    )


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", hash_bucket(k, group, seed=seed))


def _dealt(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """Folds for groups by size: (rows, [end of fold 0, end of fold 1, ...]) per size.

    Sizes are (rows, groups). The largest group goes first, each to the fold with the fewest rows so
    far (the first of several). All groups of one size are dealt at once: they fill the folds like
    water, so how many each takes follows from the level that they reach together.
    """
    load, out = [0] * k, []
    for rows, groups in sorted(sizes, reverse=True):

        def taken(level: int) -> list[int]:
            """Groups that each fold takes while it holds fewer rows than ``level``."""
            return [max(0, -(-(level - x) // rows)) for x in load]

        low, high = min(load), min(load) + rows * groups + 1
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(taken(middle)) <= groups else (low, middle)
        counts = taken(low)
        rest = groups - sum(counts)
        for f in range(k):
            if rest and load[f] + counts[f] * rows == low:
                counts[f], rest = counts[f] + 1, rest - 1
        load = [x + c * rows for x, c in zip(load, counts)]
        out.append((rows, list(accumulate(counts))))
    return out


def balanced_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of whole groups with row counts as even as they get: column ``fold``.

    The largest group goes first into the lightest fold. The driver sees how many groups there are
    of each size, never a group; groups of one size are told apart by their place in hash order, and
    fold 0 takes the first of them, fold 1 the next ones.
    """
    sizes = scale.cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    counted = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("m")).collect()
    plan = _dealt([(r["_n"], r["m"]) for r in counted], k)
    dealt = df.sparkSession.createDataFrame(plan, "_n long, _ends array<long>")
    order = [hash_code(group, seed=seed), group]
    placed = scale.running_total(sizes, ["_n"], order, F.lit(1).cast("long"), "_place", limit=0)
    fold = F.size(F.filter("_ends", lambda end: F.col("_place") >= end)).cast("int")
    folds = scale.join_lookup(placed, dealt, ["_n"], "inner").select(group, fold.alias("fold"))
    return scale.join_groups(df, folds, [group], "left")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every group is its own test fold."""
    return df.withColumn("fold", F.col(group))


def _counted_windows(
    df: DataFrame, share: float, length: int, step: int, last: int, least_train: int, least_test: int
) -> DataFrame:
    """Windows (split, test_start, test_end) with their row counts, from one count per day.

    Windows start at ``share`` of the days and every ``step`` days after; those with too few
    rows are left out. Only the calendar reaches the driver: one number per day.
    """
    per_day = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy("date").collect()
    days = [r["date"] for r in per_day]
    upto = [0, *accumulate(r["n"] for r in per_day)]
    found = []
    for n, i in enumerate(range(int(len(days) * share), len(days) - last, step)):
        j = min(i + length, len(days) - 1)
        n_train, n_test = upto[i], upto[j + 1] - upto[i]
        if n_train >= least_train and n_test >= least_test:
            found.append((n, days[i], days[j], n_train, n_test))
    return df.sparkSession.createDataFrame(
        found, "split int, test_start date, test_end date, n_train long, n_test long"
    )


def sliding_splits(df: DataFrame, window_days: int = 14, step_days: int = 7) -> DataFrame:
    """Test windows sliding from 60 % of the days on; training is everything earlier."""
    return _counted_windows(df, 0.6, window_days, step_days, window_days, 100, 10)


def walk_forward(df: DataFrame, step_days: int = 7) -> DataFrame:
    """Expanding training window, tested on the following days."""
    return _counted_windows(df, 0.6, step_days, step_days, 1, 100, 5)


def take_window(df: DataFrame, test_start, test_end) -> DataFrame:
    """Rows of one window with their part; days after the window drop out."""
    return df.filter(F.col("date") <= F.lit(test_end)).withColumn(
        "part", F.when(F.col("date") < F.lit(test_start), "train").otherwise("test")
    )


def stratified_holdout(df: DataFrame, group: str, target: str, most: int = 5) -> DataFrame:
    """Groups sorted by mean target; every fifth from the third on, at most ``most``, is test."""
    need = 5 * most - 2
    means = df.groupBy(group).agg(F.avg(target).alias("_mean"))
    first = [
        r[group]
        for r in means.filter(F.col("_mean").isNotNull()).orderBy("_mean", group).limit(need).collect()
    ]
    held = first[2::5]
    return df.withColumn("part", F.when(F.col(group).isin(held), "test").otherwise("train"))


def time_series_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Block 0..k by day order: fold f trains on blocks below f and tests on block f."""
    days = _dates(df)
    size = len(days) // (k + 1)
    first = len(days) - k * size
    cuts = [days[first + i * size] for i in range(k)]
    block = F.lit(0)
    for cut in cuts:
        block = block + (F.col("date") >= F.lit(cut)).cast("int")
    return df.withColumn("block", block)


# A prime: pairs (a, b) below it give hashes a * x + b that are pairwise independent.
PRIME = 2**31 - 1


def replicate_keys(replicates: int, seed: int = 42) -> list[tuple[int, int]]:
    """The pair (a, b) of every replicate."""

    def draw(name: str, r: int) -> int:
        return int(hashlib.md5(f"{name}-{r}-{seed}".encode()).hexdigest()[:8], 16)

    return [(1 + draw("a", r) % (PRIME - 1), draw("b", r) % PRIME) for r in range(replicates)]


def poisson_cuts() -> np.ndarray:
    """Where the weight goes up by one: the Poisson(1) distribution, in units of the prime."""
    cuts, below, term, k = [], 0.0, math.exp(-1), 0
    while (below := below + term) * PRIME < PRIME - 1 and term > 1e-18:
        cuts.append(below * PRIME)
        k += 1
        term /= k
    return np.array(cuts)


def row_numbers(key: Sequence[str], seed: int = 42):
    """A number below the prime for every row, from the hash of its key."""
    code = hash_code(*key, seed=seed)
    return F.pmod(F.conv(code, 16, 10).cast("long"), F.lit(PRIME).cast("long"))


def drawn_weights(numbers: np.ndarray, keys: Sequence[tuple[int, int]]) -> np.ndarray:
    """Poisson(1) weight of every row in every replicate."""
    a, b = np.array(keys, np.int64).T
    drawn = (numbers.astype(np.int64)[:, None] * a[None, :] + b[None, :]) % PRIME
    return np.searchsorted(poisson_cuts(), drawn, side="right")


def bootstrap_weights(
    df: DataFrame, key: Sequence[str], replicates: int, seed: int = 42
) -> DataFrame:
    """One row per (row, replicate) with its resampling weight; weight 0 is out of bag.

    Weights are Poisson(1) draws by hash, so no row needs to know the table's size and a lost task
    redraws the same weights. Where sums per replicate are wanted, ``drawn_weights`` gives the same
    weights to a batch of rows without repeating them.
    """
    pairs = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in replicate_keys(replicates, seed)]
    )
    spread = df.select("*", F.posexplode(pairs).alias("replicate", "_pair"))
    drawn = (row_numbers(key, seed) * F.col("_pair.a") + F.col("_pair.b")) % PRIME

    def weight(value: Column) -> Column:
        out = F.lit(0)
        for cut in poisson_cuts():
            out = out + (value >= float(cut)).cast("int")
        return out

    return spread.withColumn("weight", evaluated_once(drawn, weight)).drop("_pair")


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the first in hash order."""
    return (
        df.withColumn("_h", hash_key(*key, seed=seed)).orderBy("_h", *key).limit(n).drop("_h")
    )


def tail_validation(
    df: DataFrame, order: Sequence[str], fraction: float = 0.2, limit: int = scale.SMALL_BYTES
) -> DataFrame:
    """The last share of the rows in the given unique order becomes validation."""
    rows = scale.running_total(df, [], list(order), F.lit(1), "_before", limit=limit)
    total = df.agg(F.count(F.lit(1))).scalar()
    train = F.floor(total * F.lit(1 - fraction))
    return rows.withColumn(
        "part", F.when(F.col("_before") < train, "train").otherwise("validation")
    ).drop("_before")
