"""Cleaning, clauses and terms against plain Python on the given texts."""

import re

import duckdb
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import fixed_words as words
from sentilake.functions import text

SF = "/root/testdata/sf0.001"
SAMPLES = [
    "The camera is amazing but the battery drains quickly.",
    "Camera is amazing but battery drains fast.",
    "Example.com has a great product but it has many bugs.",
    "<p class='x'>Great</p>buy at HTTP://a.b or https://a.b/c?d=1&e now www.x.y",
    "début café Été naïve buté   x y",
    "I cannot, wanna, gonna lemme; gimme gotta!",
    "user-friendly top-notch 12345 a b cd",
    "BUT However.yet while-though; a. but b! c? d. E",
    "women's shoes boxes batteries glasses bus this analysis series freezes crashes issues",
    "",
    "   \n\t ",
    "12 34",
]


def python_lemma(t):
    if t in words.IRREGULAR_NOUNS:
        return words.IRREGULAR_NOUNS[t]
    if not t.endswith("s") or len(t) <= 3 or t in words.KEPT_NOUNS:
        return t
    if t.endswith("ies"):
        return t[:-3] + "y" if len(t) > 4 else t[:-1]
    if t.endswith(("sses", "ches", "shes", "xes", "oes")) or t in [f"{n}es" for n in words.NOUNS_WITH_ES]:
        return t[:-2]
    return t if t.endswith(("ss", "us", "is")) else t[:-1]


def python_clean(x):
    x = re.sub(r"<[^>]+>", " ", x or "")
    x = re.sub(r"https?://\S+|www\.\S+", " ", x).lower()
    x = re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z\s]", " ", x)).strip()
    tokens = []
    for t in x.split():
        pair = next(((a, b) for a, b in words.FUSED_WORDS if t == a + b), None)
        tokens += list(pair) if pair else [t]
    kept = (python_lemma(t) for t in tokens if t not in words.STOP_WORDS)
    return " ".join(t for t in kept if len(t) >= 2)


def python_clauses(x):
    parts = re.split(
        r"\b(?:but|however|though|although|whereas|while|yet)\b|[;!?]|\.(?=\s+[A-Z])", x or "", flags=re.IGNORECASE
    )
    return [p.strip() for p in parts if p and p.strip()]


def texts():
    rows = duckdb.connect().execute(
        f"SELECT text FROM '{SF}/documents.parquet' UNION ALL SELECT html FROM '{SF}/pages.parquet'"
    )
    return SAMPLES + [r[0] for r in rows.fetchall()]


def test_clean_text_equals_python(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, text string")
    got = {r.i: r.c for r in rows.select("i", text.clean_text(F.col("text")).alias("c")).collect()}
    for i, x in enumerate(texts()):
        assert got[i] == python_clean(x), x[:200]


def test_clauses_equal_python(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, text string")
    got = {r.i: r.c for r in rows.select("i", text.split_clauses(F.col("text")).alias("c")).collect()}
    for i, x in enumerate(texts()):
        assert got[i] == python_clauses(x), x[:200]


def test_null_and_other_types_become_text(spark):
    rows = spark.createDataFrame([(None, 12), ("x", None)], "t string, n int")
    got = rows.select(text.as_text(F.col("t")), text.as_text(F.col("n")), text.clean_text(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("", "12", ""), ("x", "", "")]


def test_every_cleaning_step_can_be_switched_off(spark):
    row = spark.createDataFrame([("<b>The</b> BUGS, at www.x.y 5!",)], "t string")

    def clean(**off):
        return row.select(text.clean_text(F.col("t"), CleanConfig(**off))).first()[0]

    assert clean() == "bug"
    assert clean(remove_html=False) == "bug"
    assert clean(remove_urls=False) == "bug www"
    assert clean(lowercase=False) == "The BUGS"
    assert clean(remove_non_alpha=False, min_token_length=1) == "bugs, 5!"
    assert clean(remove_stopwords=False) == "the bug at"
    assert clean(lemmatize=False) == "bugs"
    assert clean(min_token_length=4) == ""


def test_a_lemma_that_is_a_stop_word_survives(spark):
    # Stop words go first, so "thes" loses its ending and stays as "the".
    row = spark.createDataFrame([("thes",)], "t string")
    assert row.select(text.clean_text(F.col("t"))).first()[0] == "the"


def test_ngram_terms(spark):
    row = spark.createDataFrame([(["aa", "b", "cc", "dd"], ["xx"], [])], "a array<string>, b array<string>, c array<string>")
    got = row.select(*[text.ngram_terms(F.col(c)) for c in "abc"], text.ngram_terms(F.col("a"), 2, 2)).first()
    assert list(got) == [["aa", "cc", "dd", "aa cc", "cc dd"], ["xx"], [], ["aa cc", "cc dd"]]


def test_blank(spark):
    rows = spark.createDataFrame([("",), (None,), ("   \x1c\n",), (" .",)], "t string")
    assert [r[0] for r in rows.select(text.is_blank(F.col("t"))).collect()] == [True, True, True, False]


def test_dictionary_forms(spark):
    forms = {"lenses": "lens", "heroes": "hero", "buses": "bus", "canvas": "canvas", "physics": "physics", "texas": "texas",
             "cameras": "camera", "cases": "case", "batteries": "battery", "boxes": "box", "this": "this", "gases": "gas",
             "mangoes": "mango", "echoes": "echo", "shoes": "shoe", "kansas": "kansas", "mathematics": "mathematics", "gas": "gas",
             "viruses": "virus", "excuses": "excuse", "houses": "house", "databases": "database", "biases": "bias", "ideas": "idea",
             "topics": "topic", "whereas": "whereas", "analyses": "analysis", "women": "woman", "glasses": "glass", "as": "as"}
    rows = spark.createDataFrame([(w,) for w in forms], "t string").select("t", F.expr(text.lemma()).alias("l"))
    assert {r.t: r.l for r in rows.collect()} == forms
