"""Classification metrics and model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: metric name -> score column ---
SCORE_COLUMNS = {
    "accuracy": "test_accuracy",
    "precision_weighted": "test_precision_weighted",
    "recall_weighted": "test_recall_weighted",
    "f1_weighted": "test_f1_weighted",
}

# --- fixed values: metric name -> evaluator metric ---
EVALUATOR_METRICS = {
    "accuracy": "accuracy",
    "precision_weighted": "weightedPrecision",
    "recall_weighted": "weightedRecall",
    "f1_weighted": "f1",
}


def score_column(metric: str) -> str:
    if metric not in SCORE_COLUMNS:
        raise ValueError(f"No model can be chosen by {metric!r}; choose one of {', '.join(SCORE_COLUMNS)}.")
    return SCORE_COLUMNS[metric]


def confusion_classes(confusion: DataFrame, label: str, prediction: str, *keys: str) -> DataFrame:
    """Per key and class: support, precision, recall, f1, each undefined value as 0.

    ``confusion`` is (*keys, label, prediction, n).
    """
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), none.alias("called"), hit.alias("tp")),
        F.struct(F.col(prediction).alias("class"), none.alias("support"), F.col("n").alias("called"), none.alias("tp")),
    )
    per_class = (
        confusion.select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("called")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    scored = per_class.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def confusion_metrics(confusion: DataFrame, label: str, prediction: str, *keys: str) -> DataFrame:
    """One row per key: accuracy and support-weighted precision, recall, f1."""
    support = F.sum("support")
    return confusion_classes(confusion, label, prediction, *keys).groupBy(*keys).agg(
        (F.sum("tp") / support).alias("test_accuracy"),
        *[
            (F.sum(F.col(m) * F.col("support")) / support).alias(f"test_{m}_weighted")
            for m in ("precision", "recall", "f1")
        ],
    )


def _confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The rows reduced to the confusion table; only that small table is reshaped later."""
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: support, precision, recall, f1, each undefined value as 0."""
    return confusion_classes(_confusion(df, label, prediction), "actual", "predicted")


def weighted_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, f1."""
    return confusion_metrics(_confusion(df, label, prediction), "actual", "predicted")


def best_model(scores: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """The row with the highest metric; the earliest ``ordinal`` wins a tie."""
    return scores.orderBy(F.col(score_column(metric)).desc(), F.col("ordinal")).limit(1)
