"""Name -> (Spark callable, SQL text) registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
_ENTRIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = (fn, sql)
        return fn

    return add


def spark_queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql is not None}


def _nudge(digits: int) -> float:
    """Moves values that lie exactly between two roundings, where engines round differently."""
    return 3.7182 * 10.0 ** -(digits + 2)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column: sums of doubles differ in their last bits by order."""
    return df.select(
        *[
            (
                F.round(F.col(f"`{f.name}`").cast("double") + F.lit(_nudge(digits)), digits)
                + F.lit(0.0)
            ).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rd(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL text for the same rounding."""
    return f"round(({expr})::DOUBLE + {_nudge(digits)!r}, {digits}) + 0.0 AS {name or expr}"


def rds(names: str, digits: int = 6) -> str:
    return ", ".join(rd(n, digits=digits) for n in names.split())
