"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_ROWS = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it from there: lost executors cost no recomputation.

    ``paths`` takes note of where it is.
    """
    path = scratch(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``stored`` for tables of one step: their files are removed when the block ends.

    What the step returns must be written by then. Only paths that the block itself made are removed.
    """
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, paths)

    try:
        yield keep
    finally:
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers take whole texts, so a batch holds at most ``BATCH_ROWS`` of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return. Null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not hold, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def own_columns(df: DataFrame) -> list[Column]:
    """The table's columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a table only where a count has shown that it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
