"""Row-window features of a panel: frames look only at rows before the current one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelrank.functions.stats import correlation, sample_kurtosis, sample_skew

ROW = "_row"


def by_id() -> WindowSpec:
    return Window.partitionBy("id").orderBy("date")


def whole_id() -> WindowSpec:
    return Window.partitionBy("id")


def before(rows: int) -> WindowSpec:
    return by_id().rowsBetween(-rows, -1)


def _trend(x: Column, frame: WindowSpec) -> Column:
    return F.coalesce(F.regr_slope(x, F.col(ROW)).over(frame), F.lit(0.0))


AGGREGATES: dict[str, Callable[[Column, WindowSpec], Column]] = {
    "mean": lambda x, w: F.avg(x).over(w),
    "median": lambda x, w: F.percentile(x, 0.5).over(w),
    "std": lambda x, w: F.stddev_samp(x).over(w),
    "min": lambda x, w: F.min(x).over(w),
    "max": lambda x, w: F.max(x).over(w),
    "trend": _trend,
    "skew": lambda x, w: F.coalesce(sample_skew(x, w), F.lit(0.0)),
    "kurtosis": lambda x, w: F.coalesce(sample_kurtosis(x, w), F.lit(0.0)),
}


def with_row(panel: DataFrame) -> DataFrame:
    return panel.withColumn(ROW, F.row_number().over(by_id()))


def rolling_features(
    panel: DataFrame,
    cols: Sequence[str],
    windows: Sequence[int] = (7,),
    aggs: Sequence[str] = ("mean", "std", "min", "max", "trend"),
    keep: Mapping[str, Column] | None = None,
    extra: Mapping[str, Callable[[Column, WindowSpec], Column]] | None = None,
) -> DataFrame:
    """Aggregates over the preceding rows, for rows with at least max(windows) predecessors.

    Names are ``{col}_{agg}``, with ``_w{n}`` appended if several windows are asked for.
    ``keep`` adds expressions evaluated on the whole id (targets, lags); ``extra`` adds
    aggregates. One exchange and one sort serve every window.
    """
    known = {**AGGREGATES, **(extra or {})}
    out = []
    for size in windows:
        suffix = f"_w{size}" if len(windows) > 1 else ""
        for c in cols:
            out += [known[a](F.col(c), before(size)).alias(f"{c}_{a}{suffix}") for a in aggs]
    kept = [expr.alias(name) for name, expr in (keep or {}).items()]
    return (
        with_row(panel)
        .select("id", "date", ROW, *kept, *out)
        .filter(F.col(ROW) > max(windows))
        .drop(ROW)
    )


def closed_trend(panel: DataFrame, cols: Sequence[str], size: int = 7) -> DataFrame:
    """Slope over the values of the previous ``size`` rows with the missing ones closed up.

    A value's place is the number of values of its id so far, so neighbours in the frame are one
    apart however many missing rows lie between. Fewer than two values have no slope. Rows with
    fewer than ``size`` predecessors drop out, as in ``rolling_features``.
    """
    so_far = by_id().rowsBetween(Window.unboundedPreceding, 0)
    places = {f"_{c}_place": F.count(c).over(so_far) for c in cols}
    slopes = [
        F.regr_slope(F.col(c), F.when(F.col(c).isNotNull(), F.col(f"_{c}_place"))).over(before(size)).alias(f"{c}_trend")
        for c in cols
    ]
    rows = with_row(panel.withColumns(places)).select("id", "date", ROW, *slopes)
    return rows.filter(F.col(ROW) > size).drop(ROW)


def lag_columns(col: str, n: int) -> dict[str, Column]:
    return {f"{col}_lag{i}": F.lag(col, i).over(by_id()) for i in range(1, n + 1)}


def lags(panel: DataFrame, col: str, n: int) -> DataFrame:
    return panel.withColumns(lag_columns(col, n))


def lead_change(panel: DataFrame, col: str) -> DataFrame:
    """Next row's value and its change from this row."""
    following = F.lead(col).over(by_id())
    return panel.withColumns(
        {f"{col}_next": following, f"{col}_next_change": following - F.col(col)}
    )


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _doublings(decay: float) -> list[float]:
    """decay ** 1, 2, 4, ... as long as they are above zero in double precision."""
    out = [decay]
    while out[-1] * out[-1] > 0.0:
        out.append(out[-1] * out[-1])
    return out


def ema(panel: DataFrame, cols: Sequence[str], spans: Sequence[int] = (3, 7)) -> DataFrame:
    """Exponential mean of all earlier rows, weights by row distance, missing rows skipped.

    Two decayed sums per column, of values and of weights, over the whole history: a scan that
    doubles its reach. After step k a row holds the sums of the last 2^k rows; the next step adds
    those of the row 2^k back, decayed by as many rows. It ends where the decay is zero in double
    precision, so nothing is cut off: an early value counts however large it is. All steps share
    one exchange and one sort, and no row carries more than its sums. On a missing row the mean is
    that of the last row with a value, since both sums shrink alike.
    """
    sums = {
        f"_{c}_{span}_{side}": (_decay(span), start)
        for c in cols
        for span in spans
        for side, start in (
            ("s", F.coalesce(F.col(c).cast("double"), F.lit(0.0))),
            ("w", F.col(c).isNotNull().cast("double")),
        )
    }
    rows = panel.withColumns({name: start for name, (_, start) in sums.items()})
    steps = {name: _doublings(decay) for name, (decay, _) in sums.items()}
    for k in range(max(map(len, steps.values()), default=0)):
        rows = rows.withColumns(
            {
                name: F.col(name) + F.lit(factors[k]) * F.lag(name, 2**k, 0.0).over(by_id())
                for name, factors in steps.items()
                if k < len(factors)
            }
        )
    earlier = by_id().rowsBetween(Window.unboundedPreceding, -1)
    means = {}
    for c in cols:
        for span in spans:
            mean = F.when(F.col(c).isNotNull(), F.col(f"_{c}_{span}_s") / F.col(f"_{c}_{span}_w"))
            means[f"{c}_ema{span}"] = F.last(mean, ignorenulls=True).over(earlier)
    return rows.withColumns(means).drop(*sums)


def _weighted(col: str, rows: int, span: int) -> tuple[list[Column], list[float]]:
    decay = _decay(span)
    return (
        [F.lag(col, i).over(by_id()) for i in range(1, rows + 1)],
        [decay ** (i - 1) for i in range(1, rows + 1)],
    )


def _weight_sum(values: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        total = total + F.when(v.isNull(), 0.0).otherwise(F.lit(w))
    return total


def _dot(values: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        total = total + F.coalesce(v, F.lit(0.0)) * w
    return total


def ema_weighted_columns(cols: Sequence[str], rows: int = 7) -> dict[str, Column]:
    new = {}
    for c in cols:
        values, weights = _weighted(c, rows, rows)
        new[f"{c}_ewmean"] = F.try_divide(_dot(values, weights), _weight_sum(values, weights))
    return new


def ema_weighted_mean(panel: DataFrame, cols: Sequence[str], rows: int = 7) -> DataFrame:
    """Exponentially weighted mean (span = rows) of the preceding ``rows`` rows."""
    return panel.withColumns(ema_weighted_columns(cols, rows))


def ewm_std(panel: DataFrame, cols: Sequence[str], span: int = 7, rows: int = 7) -> DataFrame:
    """Debiased exponentially weighted standard deviation of the preceding rows."""
    lagged, new = {}, {}
    for c in cols:
        names = [f"_{c}_{i}" for i in range(1, rows + 1)]
        lagged |= {n: F.lag(c, i).over(by_id()) for i, n in enumerate(names, 1)}
        values = [F.col(n) for n in names]
        weights = [_decay(span) ** i for i in range(rows)]
        total = _weight_sum(values, weights)
        squares = _weight_sum(values, [w * w for w in weights])
        mean = F.try_divide(_dot(values, weights), total)
        spread = _dot([(v - mean) * (v - mean) for v in values], weights)
        free = total * total - squares
        new[f"{c}_ewstd"] = F.when(
            free > 1e-12, F.sqrt(F.try_divide(spread, total) * F.try_divide(total * total, free))
        )
    return panel.withColumns(lagged).withColumns(new).drop(*lagged)


def volatility_columns(col: str, rows: int = 7) -> dict[str, Column]:
    frame = before(rows)
    x = F.col(col)
    mean = F.avg(x).over(frame)
    return {
        f"{col}_range": F.max(x).over(frame) - F.min(x).over(frame),
        f"{col}_cv": F.when(mean > 0, F.try_divide(F.stddev_samp(x).over(frame), mean)).otherwise(
            0.0
        ),
        f"{col}_direction": F.signum(F.lag(col, 1).over(by_id()) - F.lag(col, 2).over(by_id())),
    }


def volatility(panel: DataFrame, col: str, rows: int = 7) -> DataFrame:
    """Range, relative spread and direction of the last change."""
    return panel.withColumns(volatility_columns(col, rows))


def momentum(panel: DataFrame, col: str, rows: int = 7, exact: bool = True) -> DataFrame:
    """Up and down days in a row, counted back from yesterday, and a reversal signal.

    With ``exact`` the first opposite day is still counted before the count stops; without
    it only the current run counts. Missing or equal neighbours stop the count.
    """
    steps = F.array(
        *[
            F.coalesce(
                F.signum(F.lag(col, i).over(by_id()) - F.lag(col, i + 1).over(by_id())), F.lit(0.0)
            )
            for i in range(1, rows + 1)
        ]
    )

    def walk(acc: Column, step: Column) -> Column:
        rising, falling = step > 0, step < 0
        opposite = (rising & (acc["down"] > 0)) | (falling & (acc["up"] > 0))
        counts = ~acc["stopped"] & (F.lit(True) if exact else ~opposite)
        return F.struct(
            (acc["up"] + (counts & rising).cast("int")).alias("up"),
            (acc["down"] + (counts & falling).cast("int")).alias("down"),
            (acc["stopped"] | (step == 0) | opposite).alias("stopped"),
        )

    start = F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(False).alias("stopped"))
    run = F.aggregate(F.col("_steps"), start, walk)
    up, down = F.col("_moves")["up"], F.col("_moves")["down"]
    return (
        panel.withColumn("_steps", steps)
        .withColumn("_moves", run)
        .withColumns(
            {
                "up_days": up,
                "down_days": down,
                "reversal": F.when(up >= 2, -1).when(down >= 2, 1).otherwise(0),
            }
        )
        .drop("_steps", "_moves")
    )


def run_lengths(panel: DataFrame, col: str) -> DataFrame:
    """Uncapped run of rises or falls that ends on the previous row."""
    move = F.coalesce(F.signum(F.col(col) - F.lag(col).over(by_id())), F.lit(0.0))
    change = F.when(F.col("_move") == F.lag("_move").over(by_id()), 0).otherwise(1)
    so_far = by_id().rowsBetween(Window.unboundedPreceding, 0)
    in_run = Window.partitionBy("id", "_run").orderBy("date")
    return (
        panel.withColumn("_move", move)
        .withColumn("_new", change)
        .withColumn("_run", F.sum("_new").over(so_far))
        .withColumn("_length", F.row_number().over(in_run))
        .withColumns(
            {
                "up_run": F.coalesce(
                    F.lag(F.when(F.col("_move") > 0, F.col("_length")).otherwise(0)).over(by_id()),
                    F.lit(0),
                ),
                "down_run": F.coalesce(
                    F.lag(F.when(F.col("_move") < 0, F.col("_length")).otherwise(0)).over(by_id()),
                    F.lit(0),
                ),
            }
        )
        .drop("_move", "_new", "_run", "_length")
    )


def mean_reversion(panel: DataFrame, col: str, rows: int = 7) -> DataFrame:
    return panel.withColumn(
        f"{col}_reversion", F.lag(col).over(by_id()) - F.avg(col).over(before(rows))
    )


def day_change_columns(cols: Sequence[str]) -> dict[str, Column]:
    return {
        f"{c}_change": F.coalesce(
            F.lag(c, 1).over(by_id()) - F.lag(c, 2).over(by_id()), F.lit(0.0)
        )
        for c in cols
    }


def day_change(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Yesterday minus the day before, 0 if either is missing."""
    return panel.withColumns(day_change_columns(cols))


def rolling_autocorr(panel: DataFrame, col: str, rows: int = 7, orders: Sequence[int] = (1, 2)) -> DataFrame:
    """Correlation of a complete frame with itself shifted; 0 if a value is missing or constant."""
    x = F.col(col)
    shifted = panel.withColumns({f"_s{k}": F.lag(col, k).over(by_id()) for k in orders})
    frame = before(rows)
    usable = (F.count(x).over(frame) == rows) & (F.stddev_pop(x).over(frame) > 1e-12)
    new = {}
    for k in orders:
        pair = by_id().rowsBetween(-(rows - k), -1)
        shift = F.col(f"_s{k}")
        spread = (F.stddev_pop(x).over(pair) > 1e-12) & (F.stddev_pop(shift).over(pair) > 1e-12)
        value = F.when(usable & spread & F.lit(rows >= 3 + k), correlation(x, shift, pair))
        new[f"{col}_autocorr{k}"] = F.coalesce(value, F.lit(0.0))
    return shifted.withColumns(new).drop(*[f"_s{k}" for k in orders])


def rmssd(panel: DataFrame, col: str, rows: int = 7) -> DataFrame:
    """Root mean square of successive differences of the present values; 0 below three."""
    held = F.collect_list(F.col(col).cast("double")).over(before(rows))
    n = F.size("_held")
    steps = F.zip_with(
        F.slice("_held", F.lit(2), F.greatest(n - 1, F.lit(0))),
        F.slice("_held", F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda a, b: (a - b) * (a - b),
    )
    total = F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)
    return (
        panel.withColumn("_held", held)
        .withColumn(
            f"{col}_rmssd", F.when(n >= 3, F.sqrt(total / (n - 1))).otherwise(F.lit(0.0))
        )
        .drop("_held")
    )


def short_std_columns(cols: Sequence[str], rows: int = 3) -> dict[str, Column]:
    return {f"{c}_std{rows}": F.stddev_samp(c).over(before(rows)) for c in cols}


def short_std(panel: DataFrame, cols: Sequence[str], rows: int = 3) -> DataFrame:
    return panel.withColumns(short_std_columns(cols, rows))


def adaptive_direction(panel: DataFrame, col: str) -> DataFrame:
    """Sign of the last change if it beats half the id's recent spread (0.3 without one)."""
    rows = ewm_std(panel, [col])
    spread = F.col(f"{col}_ewstd")
    limit = F.when(spread > 1e-9, spread * 0.5).otherwise(F.lit(0.3))
    change = F.col("_change")
    return (
        rows.withColumn("_change", F.lag(col, 1).over(by_id()) - F.lag(col, 2).over(by_id()))
        .withColumn(
            f"{col}_adaptive",
            F.when(change > limit, 1).when(change < -limit, -1).otherwise(0),
        )
        .drop("_change", f"{col}_ewstd")
    )


def study_day_columns() -> dict[str, Column]:
    return {"study_day": F.datediff("date", F.min("date").over(whole_id()))}


def study_day(panel: DataFrame) -> DataFrame:
    return panel.withColumns(study_day_columns())


def same_day_columns(cols: Sequence[str]) -> dict[str, Column]:
    has_next = F.lead("date").over(by_id()).isNotNull()
    return {f"{c}_same_day": F.when(has_next, F.col(c)) for c in cols}


def same_day(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Copies of non-target columns of the target row; missing on an id's last row."""
    return panel.withColumns(same_day_columns(cols))


def missing_share_columns(cols: Sequence[str], rows: int = 7) -> dict[str, Column]:
    gone = F.lit(0.0)
    for c in cols:
        gone = gone + F.col(c).isNull().cast("double")
    return {f"missing_share_{rows}": F.avg(gone / len(cols)).over(before(rows))}


def missing_share(panel: DataFrame, cols: Sequence[str], rows: int = 7) -> DataFrame:
    """Share of missing cells in the preceding rows."""
    return panel.withColumns(missing_share_columns(cols, rows))


def zscore_per_id(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    new = {}
    for c in cols:
        mean, sd = F.avg(c).over(whole_id()), F.stddev_samp(c).over(whole_id())
        new[c] = F.when(sd > 0, (F.col(c) - mean) / sd).otherwise(F.lit(0.0))
    return panel.withColumns(new)


def minmax_per_id(panel: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Training rows scale by their id's own training range, all others by the table's.

    A constant range counts as width 1.
    """
    inside = {c: F.when(F.col("_train"), F.col(c)) for c in cols}
    rows = panel.withColumn("_train", F.coalesce(train, F.lit(False)))
    ends = rows.agg(
        *[F.min(x).alias(f"{c}_lo") for c, x in inside.items()],
        *[F.max(x).alias(f"{c}_hi") for c, x in inside.items()],
    ).first()

    def scaled(x: Column, lo: Column, hi: Column) -> Column:
        return (x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))

    new = {}
    for c, x in inside.items():
        lo, hi = F.min(x).over(whole_id()), F.max(x).over(whole_id())
        table = scaled(
            F.col(c), F.lit(ends[f"{c}_lo"]).cast("double"), F.lit(ends[f"{c}_hi"]).cast("double")
        )
        new[c] = F.when(F.col("_train"), scaled(F.col(c), lo, hi)).otherwise(table)
    return rows.withColumns(new).drop("_train")


def sequences(panel: DataFrame, cols: Sequence[str], target: str, length: int = 7) -> DataFrame:
    """The preceding ``length`` full rows as a matrix, for rows with a target."""
    row = F.array(*[F.col(c).cast("float") for c in cols])
    return (
        panel.withColumn("sequence", F.collect_list(row).over(before(length)))
        .filter((F.size("sequence") == length) & F.col(target).isNotNull())
        .select("id", "date", "sequence", F.col(target).alias("target"))
    )


def explode_windows(panel: DataFrame, cols: Sequence[str], rows: int = 7) -> DataFrame:
    """Every full window's rows stacked, plus the row after it as its test row."""
    numbered = with_row(panel).withColumn("_last", F.count(F.lit(1)).over(whole_id()))
    place = F.explode(F.sequence(F.lit(0), F.lit(rows)))
    return (
        numbered.withColumn("_offset", place)
        .withColumn("window_row", F.col(ROW) + F.col("_offset"))
        .filter((F.col("window_row") > rows) & (F.col("window_row") <= F.col("_last")))
        .select(
            "id",
            "window_row",
            "date",
            F.when(F.col("_offset") == 0, "test").otherwise("train").alias("part"),
            *cols,
        )
    )
