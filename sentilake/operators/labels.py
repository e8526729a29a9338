"""Label encoding and balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.operators.checks import classes_of


def label_index_table(df: DataFrame, label_column: str) -> DataFrame:
    """(label, label_index): distinct labels in ascending order, counted from zero."""
    labels = classes_of(df, label_column)
    return df.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), "label string, label_index int")


def encode_labels(df: DataFrame, label_column: str, labels: Sequence[str], output: str = "label_index") -> DataFrame:
    """Adds the index of the label within the sorted class list; a null label is class ''."""
    value = F.coalesce(F.col(label_column).cast("string"), F.lit(""))
    known = F.array(*[F.lit(x) for x in labels])
    position = F.array_position(known, value)
    return df.withColumn(output, F.when(position > 0, (position - 1).cast("int")))


def decode_labels(df: DataFrame, index_column: str, labels: Sequence[str] | None, output: str) -> DataFrame:
    """Adds the label text of a class index; without a class list the index itself as text."""
    index = F.col(index_column).cast("int")
    if labels is None:
        return df.withColumn(output, index.cast("string"))
    return df.withColumn(output, F.get(F.array(*[F.lit(x) for x in labels]), index))


def class_weights(df: DataFrame, label_column: str) -> DataFrame:
    """(label, n, weight) with weight = n_all / (n_classes * n_label)."""
    counts = (
        df.select(F.coalesce(F.col(label_column).cast("string"), F.lit("")).alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )
    # Two numbers: the total and the number of classes. The classes themselves stay a table.
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(whole["total"]) / (F.lit(whole["k"]) * F.col("n")))
