"""Review sources: CSV uploads, cleaned Parquet, plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.operators.checks import require_columns, require_rows


# --- fixed values: what a number, a truth value and a missing cell look like ---
INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"
NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?\s*$"
TRUTH = ("True", "False", "TRUE", "FALSE", "true", "false")
MISSING = ("", "#N/A", "N/A", "NA", "n/a", "NaN", "nan", "-nan", "-NaN", "NULL", "null", "None", "<NA>")


def cell_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The narrowest type that holds every cell of a text column: boolean, bigint, double or string.

    One pass: each column reports which types have held for all cells so far, and partial reports are combined by and.
    Missing cells fit any type; a column without any other cell stays text.
    """
    if not columns:
        return {}
    reports = []
    for n, name in enumerate(columns):
        cell = F.col(f"`{name}`")
        present = cell.isNotNull() & ~cell.isin(*MISSING)
        tests = {"seen": F.max(present), "truth": cell.isin(*TRUTH), "whole": cell.rlike(INTEGER), "number": cell.rlike(NUMBER)}
        for kind, test in tests.items():
            found = test if kind == "seen" else F.min(F.when(present, test))
            reports.append(found.alias(f"{kind}{n}"))
    row = df.agg(*reports).first()

    def kind(n: int) -> str:
        if not row[f"seen{n}"]:
            return "string"
        for test, name in (("truth", "boolean"), ("whole", "bigint"), ("number", "double")):
            if row[f"{test}{n}"]:
                return name
        return "string"

    return {name: kind(n) for n, name in enumerate(columns)}


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text cells cast to the types found; missing cells of a typed column become null."""
    typed = {}
    for name, kind in types.items():
        if kind != "string":
            cell = F.col(f"`{name}`")
            typed[name] = F.when(~cell.isin(*MISSING), F.trim(cell).cast(kind))
    return df.withColumns(typed) if typed else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give every core work when a small source has fewer splits than there are cores.

    Meant for a bare scan. A source with enough splits is returned as it is.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, reduced to ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_raw_csv(
    spark: SparkSession,
    path: str,
    cfg: CleanConfig = CleanConfig(),
    require_non_empty: bool = True,
    multi_line: bool | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Raw reviews from CSV with header. Required columns are checked before any job.

    Column names come from the header. Text and label stay text; the types of further columns are inferred from all their
    cells in one pass, or are those given in ``types`` (an empty mapping leaves text). A file with quoted line
    breaks is read by one task (``multi_line``), any other in splits; unless it is given, a pass over the lines tells which.
    """
    df = _csv(spark, path, multi_line)
    require_columns(df, [cfg.text_column, cfg.label_column])
    df = require_rows(df) if require_non_empty else df
    if types is None:
        types = cell_types(df, [c for c in df.columns if c not in (cfg.text_column, cfg.label_column)])
    return with_types(df, types)


def read_upload(spark: SparkSession, path: str, text_column: str, multi_line: bool | None = None) -> DataFrame:
    """A caller's CSV whose text column is named by the caller, with the guards of an upload. Lines as in ``read_raw_csv``."""
    if not text_column.strip():
        raise ValueError("Name the column that holds the text.")
    if not path.lower().endswith(".csv"):
        raise ValueError("The name of an upload must end in .csv.")
    try:
        df = _csv(spark, path, multi_line)
    except Exception as error:
        raise ValueError(f"The upload cannot be read as CSV: {error}") from error
    if not df.columns:
        raise ValueError("The upload has no header and no rows.")
    if text_column not in df.columns:
        raise ValueError(f"The upload has no column {text_column}; it has {', '.join(df.columns)}.")
    return df


def read_cleaned(spark: SparkSession, path: str, required: Sequence[str] = ("text_clean", "sentiment")) -> DataFrame:
    """The cleaned table; a missing path raises, and so does an empty table."""
    df = spark.read.parquet(path)
    require_columns(df, required)
    return require_rows(df, "The cleaned table holds no row.")


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Does any quoted cell hold a line break? Then a line has an odd number of quotes. Reads the files in splits."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def number_rows(df: DataFrame, id_column: str = "review_id") -> DataFrame:
    """Adds a unique id that grows with the read order inside every file split.

    For a source without a key. The id is stable as long as the same files are planned the
    same way; write the numbered table before using the id in several jobs.
    """
    return df.withColumn(id_column, F.monotonically_increasing_id())


def _csv(spark: SparkSession, path: str, multi_line: bool | None) -> DataFrame:
    lines = has_line_breaks(spark, path) if multi_line is None else multi_line
    return (
        spark.read.option("header", True)
        .option("multiLine", lines)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
