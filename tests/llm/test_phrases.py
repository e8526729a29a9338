"""Phrase mining against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np

from sentilake.llm import phrases


def plain_phrases(rows, least, covered, top):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        body = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", body):
            ws = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for ws, a in f.items():
            if len(ws) < 2 or a < least:
                continue
            score, _, left, rest = min(
                (2000000 * a // (f[ws[:k]] + f[ws[k:]]), k, f[ws[:k]], f[ws[k:]]) for k in range(1, len(ws))
            )
            longer = [
                n
                for other, n in f.items()
                if n >= least and len(other) > len(ws) and any(other[i : i + len(ws)] == ws for i in range(len(other)))
            ]
            if not any(100 * n >= covered * a for n in longer):
                kept.append((-score, -a, " ".join(ws).encode(), left, rest))
        for rank, (score, a, phrase, left, rest) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, rest, sizes[lang], -score))
    return sorted(out)


def found(spark, rows, schema="text string, lang string", **options):
    out = phrases.mine_phrases(spark.createDataFrame(rows, schema), **options)
    return sorted(tuple(r) for r in out.collect())


def test_equals_plain_counts(spark):
    rng = random.Random(5)
    vocabulary = ["New", "york", "city", "de", "la", "été", "x", "Z y", "日本", "don't"]
    rows = []
    for n in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in ws)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None])))
    rows += [("New York city hall. " * 9, "en")] * 3 + [(None, "en"), ("", None), (" \t.;", "xx"), ("one", "yy")]
    for options in ({"least": 3, "covered": 80, "top": 50}, {"least": 1, "covered": 50, "top": 10_000}):
        assert found(spark, rows, **options) == plain_phrases(rows, **options)


def test_long_text_repeats_and_other_columns(spark):
    long = "alpha beta gamma delta epsilon, " * 20_000
    rows = [(long, "en", 1, "a"), ("alpha beta", "en", 1, "b"), ("alpha beta", "en", 1, "b")]
    schema = "text string, lang string, n long, w1 string"
    got = found(spark, rows, schema)
    assert got == plain_phrases([r[:2] for r in rows], 30, 80, 2000)
    assert [r[2] for r in got] == ["alpha beta gamma delta", "beta gamma delta epsilon"]


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en")]) == []


def test_windows_stop_at_rare_pairs_without_loss(spark):
    """The map of frequent pairs may hold too much, never too little."""
    rows = [("a b c d e f", "en")] * 30 + [("a b x y", "en")] * 29
    counts = phrases.phrase_counts(phrases.longest_windows(spark.createDataFrame(rows, "text string, lang string")))
    f = {" ".join(filter(None, r[2:6])): r.f for r in counts.collect() if r["size"] > 1}
    assert f["a b"] == 59 and f["a b c d"] == 30 and "b x" not in f and f["c d e f"] == 30


def test_slots_are_merged_exactly(spark, monkeypatch):
    """Counts stop at the threshold within a task and are handed on early, and still no frequent phrase is lost."""
    rows = [(f"k{n % 40} m{n % 40} end{n % 3}", "en") for n in range(2600)]
    want = plain_phrases(rows, 60, 80, 500)
    assert found(spark, rows, least=60, top=500) == want and want
    many = [("often seen", "en")] * 900 + [("not so", "en")] * 150
    assert found(spark, many, least=200) == plain_phrases(many, 200, 80, 2000)
    slots, counts = phrases._merged([(np.array([3, 9], np.uint64), np.array([1, 70])), (np.array([3, 5], np.uint64), np.array([2, 4]))], 30)
    assert slots.tolist() == [3, 5, 9] and counts.tolist() == [3, 4, 30]
