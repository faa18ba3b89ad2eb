"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

SECTIONS = ("inspect", "copy", "alter", "changelog", "hints", "flow", "verify", "streams", "columns")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries, and the oracle SQL of those that have one."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for section in SECTIONS:
        module = import_module(f"{__name__}.{section}")
        for name, (query, sql) in module.QUERIES.items():
            queries[name] = query
            if sql:
                oracles[name] = sql
    return queries, oracles
