"""Cleaned panel to modelling rows: every optional feature family in one projection chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.functions import scalar
from panelrank.operators import clean, windows


@dataclass(frozen=True)
class FeatureOptions:
    """Feature families to build; column roles are given by name."""

    target: str
    cols: Sequence[str]
    sizes: Sequence[int] = (7,)
    lags: int = 3
    aggs: Sequence[str] = ("mean", "std", "min", "max", "trend")
    extra_lags: Mapping[str, int] = field(default_factory=dict)
    apps: Sequence[str] = ()
    productive: Sequence[str] = ()
    leisure: Sequence[str] = ()
    pair: tuple[str, str] | None = None
    product_with: str | None = None
    ratio: tuple[str, str] | None = None
    ema_cols: Sequence[str] = ()
    ema_spans: Sequence[int] = (3, 7)
    change_cols: Sequence[str] = ()
    short_cols: Sequence[str] = ()
    same_day_cols: Sequence[str] = ()
    level_cuts: tuple[float, float] | None = None
    normalise: bool = False
    volatility: bool = False
    momentum: bool = False
    autocorr: bool = False
    rmssd: bool = False
    adaptive: bool = False
    study_day: bool = False
    weekend_distance: bool = False
    missing_share: bool = False
    variation: bool = False
    ema_weighted: bool = False
    as_change: bool = False


def build_instances(panel: DataFrame, o: FeatureOptions) -> DataFrame:
    """One row per (id, date) with enough history and a target.

    All windows share one partitioning by id and order by date, so the plan has one exchange.
    """
    biggest = max(o.sizes)
    t = o.target
    df = panel.withColumn("_target", F.col(t))
    made: list[str] = []

    def added(rows: DataFrame, before: Sequence[str]) -> DataFrame:
        made.extend(c for c in rows.columns if c not in before)
        return rows

    # Families that read only the panel's own columns share one projection.
    flat = dict(windows.lag_columns(t, o.lags))
    for c, n in o.extra_lags.items():
        flat |= windows.lag_columns(c, n)
    if o.volatility:
        flat |= windows.volatility_columns(t, biggest)
    flat |= windows.day_change_columns(o.change_cols)
    flat |= windows.short_std_columns(o.short_cols)
    if o.study_day:
        flat |= windows.study_day_columns()
    if o.same_day_cols:
        flat |= windows.same_day_columns(o.same_day_cols)
    if o.missing_share:
        flat |= windows.missing_share_columns(o.cols)
    if o.ema_weighted:
        flat |= windows.ema_weighted_columns(o.cols, biggest)
    if flat:
        df = added(df.withColumns(flat), df.columns)
    steps = []
    if o.momentum:
        steps.append(lambda d: windows.momentum(d, t, biggest))
    if o.ema_cols:
        steps.append(lambda d: windows.ema(d, o.ema_cols, o.ema_spans))
    if o.autocorr:
        steps.append(lambda d: windows.rolling_autocorr(d, t, biggest))
    if o.rmssd:
        steps.append(lambda d: windows.rmssd(d, t, biggest))
    if o.adaptive:
        steps.append(lambda d: windows.adaptive_direction(d, t))
    for step in steps:
        df = added(step(df), df.columns)
    if o.apps:
        yesterday = [F.lag(c).over(windows.by_id()) for c in o.apps]
        df = added(
            df.withColumns({f"_y_{c}": y for c, y in zip(o.apps, yesterday, strict=True)})
            .withColumns(
                {
                    "app_diversity": scalar.positive_count([F.col(f"_y_{c}") for c in o.apps]),
                    "app_entropy": scalar.entropy([F.col(f"_y_{c}") for c in o.apps]),
                }
            )
            .drop(*[f"_y_{c}" for c in o.apps]),
            df.columns,
        )
    if o.normalise:
        df = windows.zscore_per_id(df, o.cols)
    keep = {"target": F.col("_target"), **{c: F.col(c) for c in made}}
    rows = windows.rolling_features(df, o.cols, o.sizes, o.aggs, keep=keep)
    rows = _row_features(rows, o)
    rows = clean.drop_missing(rows, ["target"])
    if o.as_change:
        rows = rows.withColumn("target_level", F.col("target")).withColumn(
            "target", F.col("target") - F.col(f"{t}_lag1")
        )
        rows = clean.drop_missing(rows, ["target"])
    return rows


def _row_features(rows: DataFrame, o: FeatureOptions) -> DataFrame:
    suffix = f"_w{max(o.sizes) if 7 not in o.sizes else 7}" if len(o.sizes) > 1 else ""

    def mean(c: str):
        return F.col(f"{c}_mean{suffix}")

    day = F.col("date")
    new = {
        "dow_sin": scalar.weekday_sin(day),
        "dow_cos": scalar.weekday_cos(day),
        "is_weekend": scalar.is_weekend(day),
    }
    if o.weekend_distance:
        new["weekend_distance"] = scalar.weekend_distance(day)
    if o.level_cuts:
        new["level"] = scalar.level(mean(o.target), *o.level_cuts)
    if o.product_with:
        new["target_product"] = mean(o.target) * mean(o.product_with)
    if o.ratio:
        a, b = o.ratio
        new[f"{a}_per_{b}"] = scalar.floored_ratio(mean(a), mean(b))
    if o.pair:
        vertical, horizontal = mean(o.pair[0]), mean(o.pair[1])
        new["intensity"] = scalar.intensity(vertical, horizontal)
        new["angle"] = scalar.angle(vertical, horizontal)
        place = scalar.quadrant(vertical, horizontal)
        new |= {f"quadrant_{q}": (place == q).cast("int") for q in range(1, 5)}
    if o.productive and o.leisure:
        new["productive_balance"] = scalar.balance(
            [mean(c) for c in o.productive], [mean(c) for c in o.leisure]
        )
    if o.variation:
        new |= {
            f"{c}_variation": scalar.variation(mean(c), F.col(f"{c}_std{suffix}"))
            for c in o.cols
        }
    return rows.withColumns(new)


def feature_names(instances: DataFrame) -> list[str]:
    return [c for c in instances.columns if c not in ("id", "date", "target", "target_level", "part")]
