"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; ``sql`` is its counterpart over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def names_in(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a portable SELECT whose tables are written as ``{name}``."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names_in(text)})


def plain_sql(text: str) -> str:
    """The same SELECT with plain table names."""
    for t in names_in(text):
        text = text.replace("{" + t + "}", t)
    return text


def with_clause(**parts: str) -> str:
    """``WITH a AS (...), b AS (...)`` of portable selects."""
    return "WITH " + ", ".join(f"{name} AS ({plain_sql(text)})" for name, text in parts.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
