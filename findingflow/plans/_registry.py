"""Where plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bindings import bind, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **tables: str) -> Callable:
    """Register the function's name as a query over bound tables; ``sql`` is the same result in plain SQL."""

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(**{arg: bind(spark, sf_dir, name) for arg, name in tables.items()})

        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = with_bindings(sql)
        return build

    return keep
