"""Registry of queries: what runs on Spark, what checks it, which operators it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: Callable[[], str] | str | None = None):
    """Register the function under its own name."""

    def add(run):
        if run.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {run.__name__}")
        text = sql if sql is None or callable(sql) else (lambda: sql)
        REGISTRY[run.__name__] = Query(run.__name__, covers, run, text)
        return run

    return add
