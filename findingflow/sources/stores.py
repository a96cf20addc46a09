"""Stored tables that may be written again: runs replaced as a whole, records kept by key, deletions remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable

BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system holds anything at ``path``."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def write_runs(rows: DataFrame, path: str, keys: tuple[str, ...] = ("repository", "run_id"), buckets: int = BUCKETS) -> None:
    """Write whole runs (findings, diffs, decisions, summaries: anything with ``keys``) so that writing them again changes nothing.

    The table is partitioned by a bounded bucket of the first key, usually the repository. Rows of the given runs
    replace those that are there; buckets that no given run falls into are not touched, and each touched one is
    replaced at the commit of one job. Columns must be those of the table.
    """
    spark = rows.sparkSession
    made = durable(rows.withColumn("bucket", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int")))
    if exists(spark, path):
        touched = [r.bucket for r in made.select("bucket").distinct().collect()]  # as many as there are buckets at most
        kept = spark.read.parquet(path).where(F.col("bucket").isin(*touched)).join(made.select(*keys).distinct(), list(keys), "left_anti")
        made = durable(kept.select(made.columns).unionByName(made))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str, deleted: DataFrame | None = None) -> DataFrame:
    """``stored`` and the first (by ``order``) of each new key of ``incoming``, without keys that are ``deleted``.

    A key that is there stays as it is, so adding a record twice changes nothing. Deleted keys (rows with ``key``) are
    tombstones: kept beside the table, they also hold off records that come again.
    """
    first = incoming.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_place = 1").drop("_place")
    every = stored.unionByName(first.join(stored.select(key), key, "left_anti").select(stored.columns))
    return every if deleted is None else every.join(deleted.select(key).distinct(), key, "left_anti").select(stored.columns)


def select_records(records: DataFrame, **wanted: str | None) -> DataFrame:
    """Records whose columns have the given values; empty or missing values do not filter."""
    for column, value in wanted.items():
        if value:
            records = records.where(F.col(column) == value)
    return records
