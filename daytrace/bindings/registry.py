"""Query registry: name -> (builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; the session settings results depend on are set before it is built."""

    def add(build: Builder) -> Builder:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def day(c: str | Column, alias: str | None = None) -> Column:
    """A date as ISO text, which compares the same on every engine."""
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("string").alias(alias or c)


def rounded(c: str | Column, alias: str | None = None, digits: int = 4) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits).alias(alias or c)


def joined(c: str | Column, alias: str | None = None) -> Column:
    """An array of texts as one text."""
    column = F.col(c) if isinstance(c, str) else c
    return F.array_join(column, ",").alias(alias or c)
