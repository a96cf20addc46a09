"""All registered queries of the findings library, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import benchmark, documents, export, findings, lifecycle, policy, portfolio, runs, sources, stores, threat  # noqa: F401
from .plans._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g1_gate"](spark, sf_dir)
