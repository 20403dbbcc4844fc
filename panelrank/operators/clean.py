"""Row-wise cleaning, outlier handling and column grouping for panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrank.functions.stats import keep_missing
from panelrank.operators import scale

KEYS = ("id", "date")


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or add columns in one projection."""
    return df.withColumns(dict(new))


def numeric_columns(df: DataFrame, skip: Sequence[str] = KEYS) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", part: str = "") -> list[str]:
    return [
        c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and part in c
    ]


def null_out_of_range(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside the inclusive bounds become missing."""
    return replace_columns(
        df, {c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()}
    )


def null_negatives(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def null_all_negatives(df: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    return null_negatives(df, numeric_columns(df, (*KEYS, *exempt)))


def repair_negatives(df: DataFrame, cols: Sequence[str], cutoff: float = 10000.0) -> DataFrame:
    """Small negatives lose their sign, extreme ones become missing."""

    def repaired(x: Column) -> Column:
        return F.when(x < 0, F.when(F.abs(x) <= cutoff, F.abs(x))).otherwise(x)

    return replace_columns(df, {c: repaired(F.col(c)) for c in cols})


def cap_values(df: DataFrame, cols: Sequence[str], top: float = 10800.0) -> DataFrame:
    return replace_columns(
        df, {c: keep_missing(F.col(c), F.least(F.col(c), F.lit(float(top)))) for c in cols}
    )


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def sparse_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column the share of rows that are missing or zero."""
    shares = df.agg(
        *[
            F.avg(F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias(c)
            for c in cols
        ]
    )
    return shares.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("sparse_share")) for c in cols]
            )
        ).alias("r")
    ).select("r.*")


def drop_sparse_columns(df: DataFrame, cols: Sequence[str], most: float = 0.8) -> DataFrame:
    """Drop the listed columns whose missing-or-zero share exceeds ``most``."""
    sparse = sparse_shares(df, cols).filter(F.col("sparse_share") > most).collect()
    return df.drop(*[r["column"] for r in sparse])


def group_columns(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row sums of column groups (missing counts as 0) replace the originals."""
    old = [c for cols in groups.values() for c in cols if c in df.columns]
    new = {}
    for name, cols in groups.items():
        present = [c for c in cols if c in df.columns]
        if present:
            total = F.lit(0.0)
            for c in present:
                total = total + F.coalesce(F.col(c), F.lit(0.0))
            new[name] = total
    return replace_columns(df, new).drop(*[c for c in old if c not in new])


def merge_low_density(
    df: DataFrame, cols: Sequence[str], other: str, least: float = 0.25
) -> DataFrame:
    """Per id, columns with a small share of positive rows move into ``other``."""
    whole = Window.partitionBy("id")
    marked = df.withColumns(
        {
            f"_thin_{c}": F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)).over(whole) < least
            for c in cols
        }
    )
    total = F.col(other)
    new = {}
    for c in cols:
        thin = F.col(f"_thin_{c}")
        total = total + F.when(thin, F.col(c)).otherwise(F.lit(0.0))
        new[c] = F.when(thin, F.lit(0.0)).otherwise(F.col(c))
    new[other] = total
    return replace_columns(marked, new).drop(*[f"_thin_{c}" for c in cols])


def conditional_zero_fill(
    df: DataFrame, cols: Sequence[str], others: Sequence[str], min_active: int = 4
) -> DataFrame:
    """Missing becomes 0 only on rows with enough other columns present."""
    active = F.lit(0)
    for c in others:
        active = active + F.col(c).isNotNull().cast("int")
    return replace_columns(
        df,
        {c: F.when(F.col(c).isNull() & (active >= min_active), 0.0).otherwise(F.col(c)) for c in cols},
    )


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, list(cols) if cols is not None else numeric_columns(df))


def log1p_columns(df: DataFrame, cols: Sequence[str], clip: bool = True) -> DataFrame:
    def logged(x: Column) -> Column:
        return keep_missing(x, F.log1p(F.greatest(x, F.lit(0.0)) if clip else x))

    return replace_columns(df, {c: logged(F.col(c)) for c in cols})


def power_transform_nonzero(
    df: DataFrame, log_cols: Sequence[str] = (), sqrt_cols: Sequence[str] = ()
) -> DataFrame:
    """log1p or square root where the value is positive; zeros stay."""
    new = {c: F.when(F.col(c) > 0, F.log1p(c)).otherwise(F.col(c)) for c in log_cols}
    new |= {c: F.when(F.col(c) > 0, F.sqrt(c)).otherwise(F.col(c)) for c in sqrt_cols}
    return replace_columns(df, new)


def presence_flag(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(col).isNotNull().cast("int"))


def row_family_stats(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Count and mean of the present values of a column family, per row."""
    count, total = F.lit(0), F.lit(0.0)
    for c in cols:
        count = count + F.col(c).isNotNull().cast("int")
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns(
        {f"{prefix}_count": count, f"{prefix}_mean": F.try_divide(total, count)}
    )


def downcast(df: DataFrame) -> DataFrame:
    """64-bit integers to 32 bits where the range fits, doubles to floats."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    new = {
        f.name: F.col(f.name).cast("float")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    if longs:
        ends = df.agg(
            *[F.min(c).alias(f"{c}_lo") for c in longs], *[F.max(c).alias(f"{c}_hi") for c in longs]
        ).first()
        for c in longs:
            lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
            if lo is not None and lo >= -(2**31) and hi < 2**31:
                new[c] = F.col(c).cast("int")
    return replace_columns(df, new)


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def clean_for_model(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing, NaN and infinite become 0."""

    def finite(x: Column) -> Column:
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(x)

    return replace_columns(df, {c: finite(F.col(c).cast("double")) for c in cols})


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes missing."""
    return replace_columns(df, {c: F.col(c).try_cast("double") for c in cols})


def type_label(df: DataFrame, labels: Mapping[str, str], default: str = "other") -> DataFrame:
    """Semantic type of each variable by exact name."""
    kind = F.lit(default)
    for variable, label in labels.items():
        kind = F.when(F.col("variable") == variable, label).otherwise(kind)
    return df.withColumn("kind", kind)


def iqr_filter(
    df: DataFrame, cols: Sequence[str], mult: float = 3.0, least: int = 10
) -> DataFrame:
    """Per column over the whole table: values beyond the quartile fences become missing."""
    found = scale.quantile_values(df, cols, [0.25, 0.75])
    bounds = {}
    for c, (n, (q1, q3)) in found.items():
        if n >= least:
            bounds[c] = (q1 - mult * (q3 - q1), q3 + mult * (q3 - q1))
    return null_out_of_range(df, bounds)


def iqr_filter_long(df: DataFrame, mult: float = 3.0, upper_only: bool = False) -> DataFrame:
    """Quartile fences per variable on long rows, the lower one not below 0.

    ``upper_only`` leaves small values alone. A missing variable is a variable of its own.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("variable").cast("string")), F.lit(""))
    fences = scale.quantiles(df, ["value"], [0.25, 0.75], by=["variable"])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    fences = fences.select(
        named.alias("_variable"),
        F.greatest(F.lit(0.0), q1 - mult * (q3 - q1)).alias("_lo"),
        (q3 + mult * (q3 - q1)).alias("_hi"),
    )
    inside = F.col("value") <= F.col("_hi")
    if not upper_only:
        inside = inside & (F.col("value") >= F.col("_lo"))
    return (
        scale.join_lookup(df.withColumn("_variable", named), fences, ["_variable"])
        .withColumn("value", F.when(inside, F.col("value")))
        .drop("_variable", "_lo", "_hi")
    )


def zscore_filter(
    df: DataFrame, cols: Sequence[str], threshold: float = 3.0, least: int = 10
) -> DataFrame:
    """Values further than ``threshold`` standard deviations from the mean become missing."""
    found = df.agg(
        *[F.count(c).alias(f"{c}_n") for c in cols],
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols],
    ).first()
    new = {}
    for c in cols:
        n, mean, sd = found[f"{c}_n"], found[f"{c}_mean"], found[f"{c}_sd"]
        if n >= least and sd:
            new[c] = F.when(F.abs((F.col(c) - mean) / sd) <= threshold, F.col(c))
    return replace_columns(df, new)


def winsorize(
    df: DataFrame, cols: Sequence[str], lower: float = 5, upper: float = 95, least: int = 10
) -> DataFrame:
    """Clip columns to whole-table percentiles."""
    found = scale.quantile_values(df, cols, [lower / 100, upper / 100])
    new = {}
    for c, (n, (lo, hi)) in found.items():
        if n >= least:
            x = F.col(c)
            new[c] = keep_missing(x, F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return replace_columns(df, new)


def trim_top_quantile_if_sparse(
    df: DataFrame, col: str, bins: int = 30, empty: float = 0.3, keep: float = 0.99
) -> DataFrame:
    """Keep rows up to a quantile if too many equal-width bins are empty."""
    from panelrank.operators.profile import histogram

    filled = histogram(df, col, bins).filter(F.col("n") > 0).count()
    if (bins - filled) / bins <= empty:
        return df
    ((_, (top,)),) = scale.quantile_values(df, [col], [keep]).values()
    return df.filter(F.col(col) <= top)
