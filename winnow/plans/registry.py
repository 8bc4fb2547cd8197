"""Registry of named queries, each with an independent SQL statement to check it against."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from winnow.plans import views

Build = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    name: str
    build: Build
    sql: str | None
    why_no_sql: str | None


QUERIES: dict[str, Query] = {}


class Source:
    """The tables and views of one folder, opened on demand: ``src("orders")``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.folder, name)


def query(sql: str | None = None, why_no_sql: str | None = None):
    """Register ``fn(src)`` under its own name."""

    def register(fn: Callable[[Source], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        if (sql is None) == (why_no_sql is None):
            raise ValueError(f"query {name} needs SQL or a reason for having none")
        checked = views.ansi(sql) if sql else None
        QUERIES[name] = Query(name, lambda spark, folder: fn(Source(spark, folder)), checked, why_no_sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from winnow.plans import (  # noqa: F401
        join_queries,
        pack_queries,
        quality_queries,
        report_queries,
        stream_queries,
        text_queries,
    )

    return QUERIES
