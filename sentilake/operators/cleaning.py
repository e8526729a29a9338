"""Review cleaning as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import text
from sentilake.operators.checks import require_columns
from sentilake.operators.lemmas import LEMMAS, with_lemmas


def clean_reviews(df: DataFrame, cfg: CleanConfig = CleanConfig(), lemma_table: DataFrame | None = None) -> DataFrame:
    """All input columns plus the cleaned text; blank results dropped, text optionally unique.

    Map-only unless deduplication or a lemma table is asked for.
    """
    require_columns(df, [cfg.text_column])
    raw = df.withColumn(cfg.text_column, text.as_text(F.col(cfg.text_column)))
    if cfg.deduplicate_on_text:
        raw = first_per_text(raw, cfg.text_column, cfg.id_column)
    if lemma_table is not None:
        raw, mapped = with_lemmas(raw, lemma_table, cfg)
        cleaned = raw.withColumn(cfg.output_column, text.clean_text(F.col(cfg.text_column), mapped)).drop(LEMMAS)
        return cleaned.filter(F.col(cfg.output_column) != "") if cfg.drop_empty_rows else cleaned
    clean = text.clean_text(F.col(cfg.text_column), cfg)
    if not cfg.drop_empty_rows:
        return raw.withColumn(cfg.output_column, clean)
    # A plain filter on the cleaned column would be pushed below the projection and clean
    # every text twice. Exploding a one-element array that is empty for blank text yields
    # the column and drops the row in a single evaluation.
    kept = F.explode(F.filter(F.array(clean), lambda c: c != ""))
    return raw.select(*[c for c in raw.columns if c != cfg.output_column], kept.alias(cfg.output_column))


def first_per_text(df: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """Keep, for every distinct raw text, the row with the smallest id. Ids must be unique.

    Only (digest, id) pairs are grouped, and they are combined before the shuffle, so a text
    repeated in a third of all rows costs one partial row per task. The wide rows then meet
    the winning ids by a semi join on the unique id, which has no hot key.
    """
    require_columns(df, [text_column, id_column])
    winners = (
        df.select(F.sha2(F.col(text_column), 256).alias("digest"), F.col(id_column))
        .groupBy("digest")
        .agg(F.min(id_column).alias(id_column))
        .select(id_column)
    )
    return df.join(winners, id_column, "left_semi")


def lemmatize_with_table(
    tokens: DataFrame, lemma_table: DataFrame, id_column: str, min_token_length: int = 2
) -> DataFrame:
    """Look every token up in ``lemma_table(token, lemma)``; unknown tokens stay as they are.

    ``tokens`` is (id, pos, token). A lemma table of checked small size is broadcast by the
    optimizer; beyond that the left side of the sort-merge join may be split on hot tokens
    by adaptive skew handling. Output: (id, pos, token) with short tokens dropped.
    """
    require_columns(lemma_table, ["token", "lemma"])
    lookup = lemma_table.groupBy("token").agg(F.min("lemma").alias("lemma"))
    looked_up = F.coalesce(F.col("lemma"), F.col("token"))
    return (
        tokens.join(lookup, "token", "left")
        .select(id_column, "pos", looked_up.alias("token"))
        .filter(F.length("token") >= min_token_length)
    )


def remove_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Relational stop-word removal: anti join on ``token``, repeats of other tokens kept."""
    return tokens.join(stop_words.select("token").distinct(), "token", "left_anti")
