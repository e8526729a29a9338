"""Checks on columns and on emptiness."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise before any job runs when columns are missing; else return ``df``."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"The table has no column {', '.join(missing)}; it has {', '.join(df.columns)}.")
    return df


def require_rows(df: DataFrame, message: str = "The table holds no row.") -> DataFrame:
    """Raise when the table holds no row; else return ``df``. Reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def classes_of(df: DataFrame, label_column: str, max_classes: int = 1000) -> list[str]:
    """Distinct labels in ascending order, null as the empty string.

    The list goes to the driver, hence the checked bound.
    """
    rows = (
        df.select(F.coalesce(F.col(label_column).cast("string"), F.lit("")).alias("label"))
        .distinct()
        .limit(max_classes + 1)
        .collect()
    )
    if len(rows) > max_classes:
        raise ValueError(f"Column '{label_column}' holds more than {max_classes} classes.")
    return sorted(r.label for r in rows)


def chunk_counts(df: DataFrame) -> DataFrame:
    """(chunk, rows_in_chunk, total_rows): rows per input partition and their running total.

    One row per partition is left before the running total is formed.
    """
    chunks = df.groupBy(F.spark_partition_id().alias("chunk")).agg(F.count("*").alias("rows_in_chunk"))
    return chunks.withColumn("total_rows", F.sum("rows_in_chunk").over(Window.orderBy("chunk")))
