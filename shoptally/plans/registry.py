"""Named queries: what runs on Spark, the SQL that must agree, and the inventory ids covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, run: Run, sql: str | None = None, covers: str = "") -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")
    QUERIES[name] = Query(name, run, sql, tuple(covers.split()))


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Decorator form of ``register``; the function's name is the query's name."""
    def wrap(run: Run) -> Run:
        register(name or run.__name__, run, sql, covers)
        return run

    return wrap
