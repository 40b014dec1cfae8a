"""Every runnable query: name -> (survey ids, Spark callable, checking SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    ids: tuple[str, ...]
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(*ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name for the given survey ids."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(ids, fn, sql)
        return fn

    return add
