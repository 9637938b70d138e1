"""Decorator that files a query and its SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and oracle SQL of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def file(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query

        return file
