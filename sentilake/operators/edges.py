"""Aspect-opinion pairs from a table of dependency edges.

Edges: (id, i, text, lemma, pos, dep, head_i), one row per token, filled by any annotator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.functions import lists
from sentilake.functions.lexicon import Lexicon
from sentilake.operators.checks import require_columns

EDGE_COLUMNS = ("i", "text", "lemma", "pos", "dep", "head_i")


def aspect_opinion_pairs(edges: DataFrame, lexicon: Lexicon, key: str = "review_id") -> DataFrame:
    """(key, pos, aspect, opinion): first occurrence per aspect; opinion '' for bare preferred nouns.

    Nouns ask for opinions at two tree positions: their own (adjectives hanging on the noun)
    and, if they are a subject, that of their head (adjectives on the head, and the head
    itself when it is a cue verb). Adjectives and verbs answer at the position they describe,
    so a single equi join on (key, position) finds every opinion.
    """
    require_columns(edges, [key, *EDGE_COLUMNS])
    nouns = edges.filter(
        F.col("pos").isin("NOUN", "PROPN") & ~F.expr(lists.one_of(lexicon.banned_aspect_tokens, "lower(text)")) & (F.length("text") >= 3)
    )
    is_subject = F.col("dep").isin("nsubj", "nsubjpass")
    asked = nouns.select(
        key,
        F.col("i").alias("noun_i"),
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("i").alias("at"), F.lit("own").alias("ask")),
                    F.struct(F.when(is_subject, F.col("head_i")).alias("at"), F.lit("head").alias("ask")),
                ),
                lambda a: a["at"].isNotNull(),
            )
        ),
    )
    cues = (*lexicon.positive_cues, *lexicon.negative_cues)
    cue_verb = (F.col("pos") == "VERB") & F.expr(lists.one_of(cues, "lower(lemma)"))
    describing = F.when(
        (F.col("pos") == "ADJ") & F.col("dep").isin("amod", "acomp", "attr"),
        F.struct(F.col("head_i").alias("at"), F.col("dep").alias("role"), F.lower("text").alias("word")),
    ).when(cue_verb, F.struct(F.col("i").alias("at"), F.lit("verb").alias("role"), F.lower("lemma").alias("word")))
    answers = (
        edges.select(key, F.col("i").alias("word_i"), describing.alias("d"))
        .filter(F.col("d").isNotNull())
        .select(key, "word_i", "d.at", "d.role", "d.word")
    )
    fits = ((F.col("ask") == "own") & F.col("role").isin("amod", "acomp")) | (
        (F.col("ask") == "head") & F.col("role").isin("acomp", "attr", "verb")
    )
    rank = F.when(F.col("ask") == "own", 0).when(F.col("role") != "verb", 1).otherwise(2)
    found = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "word_i", "word")))
    opinions = (
        asked.join(answers, [key, "at"])
        .filter(fits)
        .groupBy(key, "noun_i")
        .agg(F.array_join(F.transform(found, lambda o: o["word"]), " ").alias("opinion"))
    )
    aspect = F.lower("lemma")
    named = (
        nouns.select(key, F.col("i").alias("noun_i"), aspect.alias("aspect"))
        .join(opinions, [key, "noun_i"], "left")
        .filter(F.col("opinion").isNotNull() | F.expr(lists.one_of(lexicon.preferred_features, "aspect")))
    )
    # Keeping the smallest position per aspect is a combinable aggregate, not a window sort.
    first = F.min(F.struct(F.col("noun_i").alias("pos"), F.coalesce("opinion", F.lit("")).alias("opinion")))
    return named.groupBy(key, "aspect").agg(first.alias("f")).select(key, "f.pos", "aspect", "f.opinion")
