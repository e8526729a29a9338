"""Every branch of the sentiment rules, boundaries included."""

import json

import pytest
from pyspark.sql import functions as F

from sentilake.functions import fixed_words as words
from sentilake.functions import rules
from sentilake.functions.aspects import clause_units
from sentilake.functions.lexicon import Lexicon, read_lexicon
from sentilake.config import CleanConfig

LEX = Lexicon()


def ruled(spark, tokens, label, p, n, lexicon=LEX):
    row = spark.createDataFrame([(tokens, label, p, n)], "t array<string>, l string, p double, n double")
    rule = row.select("*", rules.clause_rule(F.col("t"), lexicon).alias("r"))
    got = rule.select(rules.apply_clause_rule(F.col("r"), F.col("l"), F.col("p"), F.col("n"), lexicon).alias("x")).first().x
    return got.sentiment, got.positive if got.positive is None else round(got.positive, 9), got.negative if got.negative is None else round(got.negative, 9)


@pytest.mark.parametrize(
    "tokens, label, p, n, want",
    [
        (["battery", "drain"], "positive", 0.9, 0.1, ("negative", 0.18, 0.82)),
        (["battery", "drain"], "positive", 0.05, 0.95, ("negative", 0.05, 0.95)),
        (["battery", "drain"], "positive", None, None, ("negative", 0.18, 0.82)),
        (["great", "drain", "great"], "positive", 0.9, 0.1, ("negative", 0.18, 0.82)),
        (["waste", "my", "money", "great", "best"], "positive", 0.9, 0.1, ("negative", 0.28, 0.72)),
        (["waste", "great"], "positive", 0.9, 0.1, ("negative", 0.3, 0.7)),
        (["does", "work", "fine"], "positive", 0.9, 0.1, ("positive", 0.9, 0.1)),
        (["does", "not", "work"], "positive", 0.9, 0.1, ("negative", 0.28, 0.72)),
        (["bad"], "positive", 0.9, 0.1, ("negative", 0.3, 0.7)),
        (["bad"], "positive", 0.2, 0.8, ("negative", 0.2, 0.8)),
        (["bad"], "positive", None, None, ("negative", 0.3, 0.7)),
        (["good"], "negative", 0.1, 0.9, ("positive", 0.7, 0.3)),
        (["good"], "negative", 0.95, 0.05, ("positive", 0.95, 0.05)),
        (["good"], "negative", None, None, ("positive", 0.7, 0.3)),
        (["good", "bad"], "negative", 0.41, 0.59, ("neutral", 0.41, 0.59)),
        (["good", "bad"], "negative", 0.4, 0.6, ("negative", 0.4, 0.6)),
        (["good", "bad"], "maybe", None, None, ("maybe", None, None)),
        (["plain"], "positive", 0.55, 0.45, ("neutral", 0.55, 0.45)),
        (["handy", "noisy"], "positive", 0.7, 0.3, ("positive", 0.7, 0.3)),
        # added in token order: 1.2 + 0.6 stays below 1.8 in floating point
        (["good", "fast", "broken"], "positive", 0.9, 0.1, ("negative", 0.3, 0.7)),
        (["user", "friendly"], "negative", 0.1, 0.9, ("positive", 0.7, 0.3)),
        (["top", "notch"], "negative", 0.1, 0.9, ("negative", 0.1, 0.9)),
    ],
)
def test_clause_rules(spark, tokens, label, p, n, want):
    assert ruled(spark, tokens, label, p, n) == want


@pytest.mark.parametrize(
    "confidence, p, n, want",
    [
        (0.59, 0.59, 0.41, "neutral"),
        (0.6, 0.6, 0.4, "neutral"),
        (0.7, 0.7, 0.3, "neutral"),  # 0.7 - 0.3 is just below 0.4 in floating point
        (0.71, 0.71, 0.29, "positive"),
        (0.6, 0.0, 0.6, "positive"),
        (None, 0.69, 0.31, "neutral"),
        (None, 0.75, 0.25, "positive"),
        (None, None, None, "positive"),
        (0.9, None, None, "positive"),
    ],
)
def test_overall_label(spark, confidence, p, n, want):
    row = spark.createDataFrame([("positive", confidence, p, n)], "l string, c double, p double, n double")
    assert row.select(rules.overall_label(F.col("l"), F.col("c"), F.col("p"), F.col("n"), LEX)).first()[0] == want


def test_label_scores(spark):
    rows = spark.createDataFrame([("Positive",), ("NEGATIVE",), ("other",)], "l string")
    got = rows.select(*rules.label_scores(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 1.0), (0.5, 0.5)]


def test_match_label():
    assert rules.sentiment_indexes(["negative", "positive"]) == (1, 0)
    assert rules.sentiment_indexes(["0", "1"]) == (1, 0)
    assert rules.sentiment_indexes(["NEG", "neutral", "POS"]) == (2, 0)
    assert rules.sentiment_indexes(["happy", "sad"]) is None
    # containment counts, and the first candidate that matches any class wins
    assert rules.match_label(["very positive", "1"], words.POSITIVE_LABEL_NAMES) == 0


def test_softmax_is_stable(spark):
    row = spark.createDataFrame([([1000.0, 1001.0],)], "s array<double>")
    got = row.select(rules.softmax(F.col("s"))).first()[0]
    assert sum(got) == pytest.approx(1.0) and got[1] == pytest.approx(0.7310585786)


def test_aspect_names(spark):
    def name(clause):
        row = spark.createDataFrame([(clause,)], "t string")
        got = row.select(clause_units(F.col("t"), CleanConfig(), LEX).alias("u")).first().u
        return [u.feature for u in got]

    assert name("The camera is amazing but the battery drains quickly.") == ["camera", "battery"]
    assert name("great camera with a bug and a screen") == ["bug"]
    assert name("great camera and great screen for kids") == ["screen"]
    assert name("great toys") == ["toys"]
    assert name("good; bad") == ["aspect_1", "aspect_2"]
    # all raw words banned, stopped or -ly; cleaned words get a second chance without the -ly test
    assert name("lovely good") == ["lovely"]
    # clauses without a cue count in the numbering
    assert name("hello there! good") == ["aspect_2"]
    assert name("nothing of note") == []


def test_lexicon_counts():
    assert (len(LEX.positive_cues), len(LEX.negative_cues)) == (124, 133)
    assert (len(LEX.positive_weights), len(LEX.negative_weights)) == (81, 86)
    assert sum(w not in LEX.positive_weights for w in LEX.positive_cues) == 43
    # one negative cue of the original file is a boolean and can never match a token
    assert sum(w not in LEX.negative_weights for w in LEX.negative_cues) == 47
    assert not set(LEX.positive_cues) & set(LEX.negative_cues)


def test_lexicon_file(spark, tmp_path):
    good, bad, odd = (str(tmp_path / n) for n in ("good.json", "bad.json", "odd.json"))
    (tmp_path / "good.json").write_text(json.dumps({"positive_cues": ["yay", True], "positive_weights": {"yay": 2}, "x": 1}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "odd.json").write_text("[1]")
    read = read_lexicon(spark, good)
    assert read.positive_cues == ("yay",) and read.positive_weights == {"yay": 2.0}
    assert read.negative_cues == words.FALLBACK_NEGATIVE_CUES
    for path in (bad, odd, str(tmp_path / "missing.json")):
        with pytest.warns(UserWarning, match="default entries"):
            assert read_lexicon(spark, path) == Lexicon.fallback()
    (tmp_path / "long.json").write_text("{" + "\n" * 25_000 + '"positive_cues": ["yay"]\n}')
    assert read_lexicon(spark, str(tmp_path / "long.json")).positive_cues == ("yay",)
    assert ruled(spark, ["good", "drain"], "negative", 0.1, 0.9, Lexicon.fallback()) == ("positive", 0.7, 0.3)
    with pytest.raises(ValueError, match="at most"):
        Lexicon(positive_cues=tuple(f"w{i}" for i in range(30_000)))


def test_cue_table_covers_every_cue(spark):
    rows = {r.word: (r.polarity, r.weight) for r in LEX.cue_table(spark).collect()}
    assert rows["drain"] == ("negative", 1.8) and rows["handy"] == ("positive", 1.0) and len(rows) == 257
