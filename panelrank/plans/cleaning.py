"""Measurements to a cleaned daily panel, in one fixed order of steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from panelrank.operators import clean, impute, rollup, scale


@dataclass(frozen=True)
class CleanOptions:
    """Which columns play which part, and which optional steps run."""

    rules: rollup.Rules
    target: str
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    continuous: Sequence[str] = ()
    durations: Sequence[str] = ()
    outlier_cols: Sequence[str] = ()
    zero_fill_cols: Sequence[str] = ()
    signed: Sequence[str] = ()
    span: str = "id"
    drop_negatives: bool = False
    outliers: str = "iqr"
    outlier_strength: float = 3.0
    winsor: tuple[float, float] | None = None
    cap: float | None = None
    delete_gaps_over: int | None = None
    mark_gaps_over: int | None = None
    conditional_fill_min: int | None = None
    imputation: str = "ffill"
    knn_k: int = 3
    log_durations: bool = False
    time_of_day: str | None = None
    groups: Mapping[str, Sequence[str]] | None = None
    density_merge_into: str | None = None
    density: float = 0.25
    sparse_cols: Sequence[str] = ()


OUTLIERS = ("iqr", "zscore", "domain_only")
IMPUTATIONS = ("ffill", "linear", "knn", "hybrid", "regression", "none")


def clean_daily(measurements: DataFrame, options: CleanOptions) -> DataFrame:
    """Roll up, fill the calendar, clean, impute, reshape; remaining holes become 0.

    Steps that need whole-table quantiles read the panel twice, so it is written to the
    shared folder once before them; it is far smaller than the measurements.
    """
    o = options
    if o.outliers not in OUTLIERS:
        raise ValueError(f"unknown outlier method {o.outliers!r}")
    if o.imputation not in IMPUTATIONS:
        raise ValueError(f"unknown imputation {o.imputation!r}")
    df = rollup.calendar_fill(rollup.daily_rollup(measurements, o.rules), o.span, o.target)
    if o.drop_negatives:
        df = clean.null_all_negatives(df, exempt=o.signed)
    df = clean.null_out_of_range(df, o.bounds)
    if o.outlier_cols and (o.winsor or o.outliers != "domain_only"):
        df = df if scale.fits_one_task(df) else scale.cut_lineage(df)
        if o.winsor:
            df = clean.winsorize(df, o.outlier_cols, *o.winsor)
        elif o.outliers == "iqr":
            df = clean.iqr_filter(df, o.outlier_cols, o.outlier_strength)
        else:
            df = clean.zscore_filter(df, o.outlier_cols, o.outlier_strength)
    if o.cap is not None:
        df = clean.cap_values(df, o.durations, o.cap)
    if o.delete_gaps_over is not None:
        df = impute.delete_long_gaps(df, o.target, o.delete_gaps_over)
    if o.mark_gaps_over is not None:
        df = impute.long_gap_mask(df, o.target, o.mark_gaps_over)
    values = [c for c in df.columns if c not in ("id", "date", "in_long_gap")]
    if o.conditional_fill_min is not None:
        others = [c for c in values if c not in o.zero_fill_cols]
        df = clean.conditional_zero_fill(df, o.zero_fill_cols, others, o.conditional_fill_min)
    df = _imputed(df, values, o)
    if o.log_durations:
        df = clean.log1p_columns(df, o.durations)
    if o.time_of_day:
        df = df.join(rollup.time_of_day_means(measurements, o.time_of_day), ["id", "date"], "left")
    if o.groups:
        df = clean.group_columns(df, o.groups)
    if o.density_merge_into:
        thin = [c for c in o.durations if c != o.density_merge_into and c in df.columns]
        df = clean.merge_low_density(df, thin, o.density_merge_into, o.density)
    if o.sparse_cols and not o.groups:
        df = clean.drop_columns(df, o.sparse_cols)
    return clean.fill_zero(df)


def _imputed(df: DataFrame, values: Sequence[str], o: CleanOptions) -> DataFrame:
    if o.imputation == "ffill":
        return impute.forward_backward_fill(df, values)
    if o.imputation == "linear":
        return impute.interpolate_linear(df, values)
    if o.imputation == "hybrid":
        rest = [c for c in values if c not in o.continuous]
        return impute.impute_hybrid(df, o.continuous, rest)
    if o.imputation == "knn":
        return impute.impute_knn(df, values, o.knn_k)
    if o.imputation == "regression":
        return impute.impute_regression(df, values)
    return df
