"""Joins of panel parts and of variables measured together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_parts(parts: Sequence[DataFrame], keys: Sequence[str], how: str = "full") -> DataFrame:
    """Join parts that hold different columns of the same keys."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), how)
    return out


def pair_variables(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("id", "time")) -> DataFrame:
    """Rows where both variables were measured at the same keys."""
    left = df.filter(F.col("variable") == a).select(*keys, F.col("value").alias(a))
    right = df.filter(F.col("variable") == b).select(*keys, F.col("value").alias(b))
    return left.join(right, list(keys), "inner")


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Two reports side by side with the change of each metric."""
    left = before.select(key, *[F.col(m).alias(f"{m}_before") for m in metrics])
    right = after.select(key, *[F.col(m).alias(f"{m}_after") for m in metrics])
    return left.join(right, key).withColumns(
        {f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics}
    )
