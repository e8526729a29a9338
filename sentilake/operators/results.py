"""Shapes in which scored reviews leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATION_COLUMNS = (
    "overall_sentiment",
    "positive_score",
    "negative_score",
    "confidence",
    "features_and_sentiments",
)

RESPONSE_COLUMNS = (
    "input_text",
    "cleaned_text",
    "tokens",
    "token_count",
    "embedding_shape",
    "predicted_label",
    "overall_sentiment",
    "predicted_raw",
    "positive_score",
    "negative_score",
    "sentiment_breakdown",
    "aspect_sentiments",
    "aspect_sentiment_scores",
    "main_feature_points",
    "confidence",
    "decision_margin",
    "class_probabilities",
)

PREVIEW_LENGTH = 80


def shown_label(overall: Column, predicted: Column, default: str = "") -> Column:
    return F.coalesce(overall, predicted, F.lit(default))


def features_text(points: Column) -> Column:
    """``feature: sentiment`` strings joined by comma, in point order; none gives ''."""
    parts = F.transform(points, lambda p: F.concat_ws(": ", p["feature"], p["sentiment"]))
    return F.coalesce(F.array_join(parts, ", "), F.lit(""))


def _score_or_zero(column: str) -> Column:
    # A scored row whose model gives no such score shows 0; a failed row stays null.
    return F.when(F.col("error").isNull(), F.coalesce(F.col(column), F.lit(0.0)))


def annotation_columns() -> list[Column]:
    """The five scalar columns added to a caller's table."""
    return [
        shown_label(F.col("overall_sentiment"), F.col("predicted_label")).alias("overall_sentiment"),
        *[_score_or_zero(c).alias(c) for c in ("positive_score", "negative_score", "confidence")],
        features_text(F.col("main_feature_points")).alias("features_and_sentiments"),
    ]


def result_rows(scored: DataFrame, id_column: str) -> DataFrame:
    """Scored reviews without the failed ones, as (id, review, labels, scores, features)."""
    return scored.filter(F.col("error").isNull()).select(
        id_column,
        F.col("input_text").alias("review"),
        shown_label(F.col("overall_sentiment"), F.col("predicted_label")).alias("overall_sentiment"),
        *[_score_or_zero(c).alias(c) for c in ("positive_score", "negative_score", "confidence")],
        F.col("main_feature_points").alias("features"),
    )


def response_rows(scored: DataFrame, id_column: str) -> DataFrame:
    """The answer to one review: everything but the word list."""
    return scored.select(id_column, *RESPONSE_COLUMNS)


def percent(score: Column, digits: int = 1) -> Column:
    return F.round(score * 100, digits)


def bar_width(score: Column) -> Column:
    """A score as a bar width between 0 and 100; no score gives 0."""
    return F.when(score.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * 100)))


def display_rows(results: DataFrame, id_column: str) -> DataFrame:
    """One line per result as a list view shows it: preview, tone, percentages, bar widths."""
    # An empty label shows as 'unknown', like a missing one.
    label = F.coalesce(F.nullif(F.col("overall_sentiment"), F.lit("")), F.lit("unknown"))
    preview = F.when(
        F.length("review") > PREVIEW_LENGTH,
        F.concat(F.substring("review", 1, PREVIEW_LENGTH), F.lit("...")),
    ).otherwise(F.col("review"))
    # The list badge is positive only for an exactly positive label.
    tone = F.when(F.lower(label) == "positive", "positive").otherwise("negative")
    return results.select(
        id_column,
        preview.alias("preview"),
        label.alias("label"),
        tone.alias("tone"),
        percent(F.col("positive_score")).alias("positive_pct"),
        percent(F.col("negative_score")).alias("negative_pct"),
        percent(F.col("confidence")).alias("confidence_pct"),
        bar_width(F.col("positive_score")).alias("positive_width"),
        bar_width(F.col("negative_score")).alias("negative_width"),
    )


def aspect_cards(results: DataFrame, id_column: str) -> DataFrame:
    """One line per feature point; the card tone is negative only for an exactly negative label."""
    rows = results.select(id_column, F.posexplode("features").alias("pos", "p"))
    tone = F.when(F.lower(F.col("p.sentiment")) == "negative", "negative").otherwise("positive")
    return rows.select(
        id_column,
        "pos",
        F.col("p.feature").alias("feature"),
        F.coalesce(F.nullif(F.col("p.sentiment"), F.lit("")), F.lit("unknown")).alias("sentiment"),
        tone.alias("tone"),
        percent(F.col("p.scores.positive")).alias("positive_pct"),
        percent(F.col("p.scores.negative")).alias("negative_pct"),
        F.col("p.evidence").alias("evidence"),
    )
