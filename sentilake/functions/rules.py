"""Sentiment rules as column expressions: breakdown, neutral rule, clause polarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentilake.functions import fixed_words as words
from sentilake.functions.lexicon import Lexicon


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of log scores, shifted by the maximum first."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, v: a + v))


def scaled_sigmoids(scores: Column) -> Column:
    """Probabilities of one machine a class: each score's sigmoid, scaled to a sum of one."""
    each = F.transform(scores, sigmoid)
    total = F.aggregate(each, F.lit(0.0), lambda a, v: a + v)
    return F.transform(each, lambda p: F.when(total > 0, p / total).otherwise(1.0 / F.size(scores)))


def match_label(labels: Sequence[str], candidates: Sequence[str]) -> int | None:
    """Index of the first class whose lower-cased name equals or contains a candidate."""
    lowered: dict[str, int] = {}
    for index, label in enumerate(labels):
        lowered[str(label).lower()] = index
    hits = (index for wanted in candidates for name, index in lowered.items() if wanted in name)
    return next(hits, None)


def sentiment_indexes(labels: Sequence[str]) -> tuple[int, int] | None:
    """(positive, negative) class positions, or None when either is missing."""
    found = (match_label(labels, words.POSITIVE_LABEL_NAMES), match_label(labels, words.NEGATIVE_LABEL_NAMES))
    return None if None in found else found  # type: ignore[return-value]


def label_scores(label: Column) -> tuple[Column, Column]:
    """(positive, negative) implied by a bare label."""
    low = F.lower(label)
    positive = F.when(low == "positive", 1.0).when(low == "negative", 0.0).otherwise(0.5)
    return positive, 1.0 - positive


def overall_label(
    label: Column, confidence: Column, positive: Column, negative: Column, lexicon: Lexicon
) -> Column:
    """Neutral when confidence is low or the two scores lie close together."""
    threshold = float(lexicon.neutral_confidence_threshold)
    return (
        F.when(confidence < F.lit(threshold), F.lit("neutral"))
        .when(F.abs(positive - negative) < F.lit(1.0 - threshold), F.lit("neutral"))
        .otherwise(label)
    )


def clause_rule(tokens: Column, lexicon: Lexicon) -> Column:
    """Lexicon evidence of a clause: ``forced`` score floor and ``balance`` of the cues.

    ``tokens`` must be a plain column or lambda variable, as it is used several times.
    """
    return F.struct(
        lexicon.forced_score(tokens).alias("forced"),
        lexicon.cue_sum(tokens, "positive").alias("positive_cues"),
        lexicon.cue_sum(tokens, "negative").alias("negative_cues"),
    )


def apply_clause_rule(
    rule: Column, label: Column, positive: Column, negative: Column, lexicon: Lexicon
) -> Column:
    """Final (label, positive, negative) of a clause after the lexicon rules.

    ``greatest`` skips nulls, so a model without scores falls back to the floors.
    """
    forced, pos, neg = rule["forced"], rule["positive_cues"], rule["negative_cues"]
    floor = F.lit(words.CUE_SCORE)
    unclear = F.greatest(positive, negative) < F.lit(float(lexicon.neutral_confidence_threshold))
    down = F.when(forced.isNotNull(), F.greatest(negative, forced)).when(neg > pos, F.greatest(negative, floor))
    up = F.greatest(positive, floor)
    is_down = forced.isNotNull() | (neg > pos)
    return F.struct(
        F.when(is_down, F.lit("negative"))
        .when(pos > neg, F.lit("positive"))
        .when(unclear, F.lit("neutral"))
        .otherwise(label)
        .alias("sentiment"),
        F.when(is_down, 1.0 - down).when(pos > neg, up).otherwise(positive).alias("positive"),
        F.when(is_down, down).when(pos > neg, 1.0 - up).otherwise(negative).alias("negative"),
    )
