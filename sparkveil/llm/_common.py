"""Helpers that the operators of this subpackage share: tables, shared scratch storage and Arrow mapping."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.sources.scratch import place, shared_dir

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of text that a Python worker takes up in one step; a longer text makes a step of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expose(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from the place the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later readers do not recompute it, and its
    lineage ends in files that outlive any executor. `released` removes the files; what is not released goes with
    the driver's JVM, whatever file system it is on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkveil-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, where = place(spark, path)
    system.deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def released(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for df in tables:
        system, where = place(df.sparkSession, df.stored_at)
        system.delete(where, True)


#: Keys with more rows than this are joined by a broadcast of their facts, as long as there are no more of them.
HEAVY_ROWS, MOST_HEAVY = 1024, 100_000


def join_by_count(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to facts, which has a row a key and in `count` how many of `total` rows have it.

    Keys of many rows, at most MOST_HEAVY by the bound on their rows, are broadcast, so that no task gets all rows of
    one; the others are merge-joined, which spills and so holds at any size. Null keys match nothing. `how` is inner
    or left. facts is read three times.
    """
    limit = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy, light = facts.where(F.col(count) > limit).drop(count), facts.where(F.col(count) <= limit).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge"), on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


def spare_prefix(columns: list[str]) -> str:
    """A prefix for columns of an operator's own that no given column starts with."""
    prefix = "_v"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    expose(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column that hold up to `limit` bytes each, or one row."""
    first = held = 0
    for i, value in enumerate(column):
        size = len(value.as_buffer() or b"") if value.is_valid else 0
        if i > first and held + size > limit:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(column):
        yield first, len(column)
