"""Queries of the core and their SQL. Each module of ``arborgrid.queries`` registers its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated callable(spark, folder) under ``name``, with its SQL if there is one."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from arborgrid import queries  # noqa: F401


_load()
