"""Sinks: cleaned tables, annotated CSV, features and reports; published versions are in ``versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.operators.checks import require_rows


def write_cleaned(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The cleaned table as Parquet. Raises when nothing was written."""
    df.write.mode(mode).parquet(path)
    require_rows(df.sparkSession.read.parquet(path), "No rows were written after preprocessing.")
    return path


def write_annotated_csv(df: DataFrame, path: str) -> str:
    """The annotated table as CSV with header, one file per partition. White space in cells is kept."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_features(df: DataFrame, path: str, split_column: str = "split") -> str:
    """Features and labels as one table, partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_column).parquet(path)
    return path


def read_features(spark: SparkSession, path: str, split: str | None = None, split_column: str = "split") -> DataFrame:
    """Features of one split (a partition filter) or of all; a missing path raises."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col(split_column) == split)


def write_report(report: DataFrame, path: str) -> str:
    """The one-row model report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


# ---- tables that hold several versions --------------------------------------------------


def newest_version(df: DataFrame, version_column: str = "version") -> int:
    found = df.agg(F.max(version_column)).first()[0]
    if found is None:
        raise ValueError("The dataset has no version.")
    return found


def latest_rows(df: DataFrame, version_column: str = "version") -> DataFrame:
    """Rows of the newest version of a table with a version column."""
    return df.filter(F.col(version_column) == F.lit(newest_version(df, version_column)))
