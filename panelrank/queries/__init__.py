"""Registered queries and their SQL counterparts."""

from panelrank.queries import linear, models, panel, profiling, ranking, reports, storage  # noqa: F401
from panelrank.queries.registry import oracles, spark_queries

__all__ = ["oracles", "spark_queries"]
