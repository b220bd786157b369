"""Registry of queries: a DataFrame plan by name and, where SQL can say it, the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) as a query; tables(name) gives a table or a domain view as a DataFrame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from lodestone.plans.views import Tables

            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = run
        if sql is not None:
            from lodestone.plans.views import with_views

            ORACLE[name] = with_views(sql)
        return f

    return add
