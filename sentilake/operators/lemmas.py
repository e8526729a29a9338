"""A caller's lemma table for whole jobs: each review gets a map of its own tokens' lemmas."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import text
from sentilake.operators.checks import require_columns

LEMMAS = "_lemmas"
#: Lemma tables up to this many rows are broadcast, about 40 MB; of larger ones only the entries of heavy tokens are.
TABLE_ROWS = 500_000
#: Tokens that this share of the reviews hold are heavy. At most this many of them are answered from a broadcast map.
HEAVY_SHARE, HEAVY_TOKENS = 0.001, 10_000


def own_tokens(value: Column, cfg: CleanConfig) -> Column:
    """All distinct tokens that cleaning a text or one of its clauses can meet, before lemmas.

    Clauses hold tokens of their own only where their border cuts a tag or an address.
    """
    raw = text.as_text(value)
    whole = text.raw_tokens(raw, cfg)
    clauses = F.flatten(F.transform(text.split_clauses(raw), lambda c: text.raw_tokens(c, cfg)))
    cuttable = raw.contains("<") | raw.contains("://") | raw.contains("www.")
    return F.array_distinct(F.when(cuttable, F.concat(whole, clauses)).otherwise(whole))


def looked_up(tokens: DataFrame, lemma_table: DataFrame, reviews: int) -> DataFrame:
    """(*, token, lemma) of the tokens that the table changes. ``tokens`` names each token once a review.

    A small table is broadcast. For a large one, tokens that many reviews hold are counted and answered from a map of bounded
    size; the others meet the table in a join without a hot key.
    """
    require_columns(lemma_table, ["token", "lemma"])
    lookup = lemma_table.groupBy("token").agg(F.min("lemma").alias("lemma")).filter(F.col("lemma") != F.col("token"))
    if lookup.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS:
        return tokens.join(F.broadcast(lookup), "token")
    heavy = (
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > max(1, int(HEAVY_SHARE * reviews)))
        .orderBy(F.col("n").desc(), "token").limit(HEAVY_TOKENS).select("token")
    )
    heavy = F.broadcast(heavy.join(lookup, "token", "left").withColumn("heavy", F.lit(True)))
    first = tokens.join(heavy, "token", "left")
    answered = first.filter(F.col("heavy") & F.col("lemma").isNotNull()).drop("heavy")
    rest = first.filter(F.col("heavy").isNull()).drop("heavy", "lemma").join(lookup, "token")
    return answered.unionByName(rest)


def with_lemmas(
    df: DataFrame, lemma_table: DataFrame, cfg: CleanConfig = CleanConfig(), columns: tuple[str, ...] = ()
) -> tuple[DataFrame, CleanConfig]:
    """The rows with a map of their tokens' lemmas, and the settings that make every cleaning step use it.

    ``columns`` are the text columns (the settings' one by default). Ids must be unique. ``lemma_table`` is (token, lemma); a token
    without an entry stays as it is, of several entries the smallest lemma counts. The tokens of a review are few, so its map is.
    """
    key = cfg.id_column
    require_columns(df, [key, *(columns or (cfg.text_column,))])
    every = F.array_distinct(F.concat(*[own_tokens(F.col(c), cfg) for c in columns or (cfg.text_column,)]))
    tokens = df.select(key, F.explode(every).alias("token"))
    changed = looked_up(tokens, lemma_table, df.count())
    maps = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias(LEMMAS))
    return df.drop(LEMMAS).join(maps, key, "left"), replace(cfg, lemma_map=LEMMAS)
