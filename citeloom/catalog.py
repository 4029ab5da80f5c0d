"""The registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "route_exact_title"
from citeloom.plans import discovery_queries, evaluation_queries, index_queries, routing_queries

_MODULES: list = [index_queries, routing_queries, discovery_queries, evaluation_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out |= m.ORACLE
    return out
