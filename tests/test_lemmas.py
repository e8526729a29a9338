"""A caller's lemma table: broadcast and counted ways agree, and every cleaning step uses it."""

import pytest
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import text
from sentilake.functions.lexicon import Lexicon
from sentilake.operators import cleaning, lemmas, scoring

TABLE = [("draining", "drain"), ("draining", "zzz"), ("loved", "love"), ("camera", "camera"), ("speakers", "speaker"), ("xx", "y")]


@pytest.fixture()
def reviews(spark):
    rows = [(i, ["Draining battery, loved screen", "speakers; draining!", "nothing here", None, "", "xx <b;draining> xx"][i % 6]) for i in range(60)]
    return spark.createDataFrame(rows, "review_id long, text string").repartition(3)


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(TABLE, "token string, lemma string")


def plain(value, cfg):
    best = {}
    for token, lemma in TABLE:
        best[token] = min(lemma, best.get(token, lemma))
    return [t for t in (best.get(t, t) for t in value) if len(t) >= cfg.min_token_length]


@pytest.mark.parametrize("limit", [None, 0])
def test_tokens_equal_a_lookup_by_hand(spark, reviews, table, monkeypatch, limit):
    if limit is not None:
        # a large table: tokens of many reviews are answered from the bounded map, the others by a join
        monkeypatch.setattr(lemmas, "TABLE_ROWS", limit)
        monkeypatch.setattr(lemmas, "HEAVY_SHARE", 0.2)
    cfg = CleanConfig()
    rows, mapped = lemmas.with_lemmas(reviews, table, cfg)
    got = rows.select("review_id", text.raw_tokens(F.col("text")).alias("raw"), text.clean_tokens(F.col("text"), mapped).alias("t")).collect()
    assert len(got) == 60
    for r in got:
        assert r.t == plain(r.raw, cfg)
    assert any(r.t[:2] == ["drain", "battery"] for r in got)


def test_heavy_tokens_never_meet_the_table_in_a_shuffle(spark, reviews, table, monkeypatch):
    monkeypatch.setattr(lemmas, "TABLE_ROWS", 0)
    monkeypatch.setattr(lemmas, "HEAVY_SHARE", 0.2)
    tokens = reviews.select("review_id", F.explode(lemmas.own_tokens(F.col("text"), CleanConfig())).alias("token"))
    found = lemmas.looked_up(tokens, table, 60)
    assert {(r.token, r.lemma) for r in found.collect()} == {("draining", "drain"), ("loved", "love"), ("speakers", "speaker"), ("xx", "y")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_cleaning_keeps_columns_and_blank_rows(spark, reviews, table):
    kept = cleaning.clean_reviews(reviews, CleanConfig(drop_empty_rows=False), table)
    assert kept.columns == ["review_id", "text", "text_clean"] and kept.count() == 60
    dropped = cleaning.clean_reviews(reviews, CleanConfig(), table)
    assert {r.text_clean for r in dropped.collect()} >= {"drain battery love screen", "speaker drain"}
    assert dropped.filter("text_clean = ''").count() == 0


def test_clauses_that_cut_a_tag_find_their_lemmas(spark, reviews, table):
    rows, mapped = lemmas.with_lemmas(reviews, table)
    units = scoring.review_units(rows, mapped, Lexicon()).select("review_id", F.explode("units").alias("u"))
    tokens = {t for r in units.collect() for t in r.u.tokens}
    assert "drain" in tokens and "draining" not in tokens
