"""A query and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def registrar(into: dict[str, Query]):
    """A decorator that files a query under its function's name."""

    def register(sql: str | None = None):
        def put(run):
            into[run.__name__] = Query(run, sql)
            return run

        return put

    return register
