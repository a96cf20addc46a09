"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a session without executors of its own may leave it unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="findingflow-")
        sc.setCheckpointDir(found)
    return found


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor depend on live executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/findingflow/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Per-process caches that a worker gives back after each task.
caches: list[dict] = []


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of about BATCH bytes, whatever the length of texts (unless the session sets another bound); afterwards the worker empties its caches, as the process lives on for other stages."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH)

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(wrapped, schema)


class Memo(dict):
    """A bounded memo of ``make``. Once ``limit`` keys are held they become the old generation, which keeps only what is asked for again; keys beyond ``longest`` characters are not held. Results never depend on it."""

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 40):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            kept = dict(self)
            self.clear()
            self.old = kept
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts in ``column`` hold about ``most`` bytes; a longer text is a run of its own."""
    texts, at = batch.column(column), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(batch):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def values(column: pa.Array, step: int = 500) -> Iterator:
    """The values of an Arrow column as Python objects, a few hundred at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def text_groups(rows: Iterable[tuple], most: int = 1_000_000) -> Iterator[list[tuple]]:
    """Consecutive rows of (id, text) in groups of about ``most`` characters and 4000 rows at most, so that numpy work arrays stay small."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= most or len(group) >= 4000:
            yield group
            group, size = [], 0
    if group:
        yield group
