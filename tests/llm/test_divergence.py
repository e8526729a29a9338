"""Source divergence against sums over every term and every pair of groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from sentilake.llm import divergence


def plain_audit(rows, least=3, top=200):
    counts, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in df[lang].items() if n >= least}

        def share(f):
            total = sum(f[t] for t in kept)
            return {t: 1 + 10**9 * (f[t] + 1) // (total + len(kept)) for t in kept}

        whole = Counter()
        for s in names:
            whole.update(counts[lang, s])
        p, q = {s: share(counts[lang, s]) for s in names}, share(whole)
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [
                (t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]
            ]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, schema="text string, lang string, source string", **options):
    out = divergence.audit_sources(spark.createDataFrame(rows, schema), **options)
    return sorted(tuple(r) for r in out.collect())


def test_equals_sums_over_all_terms(spark):
    rng = random.Random(3)
    vocabulary = ["été", "Été", "über", "日本", "a", "B", "cd"] + [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(400)]
    rows = []
    for _ in range(300):
        mine = rng.sample(vocabulary, 30)
        text = "".join(rng.choice(mine) + rng.choice([" ", "-", "3", ".", "\n", "\x00"]) for _ in range(rng.randint(0, 50)))
        rows.append((text, rng.choice(["en", "en", "fr", None]), rng.choice(["x", "y", None, "z", "é"])))
    rows += [rows[0]] * 4 + [(None, "en", "bare"), ("", "xx", "one"), ("only twice", "yy", "a"), ("only twice", "yy", "b")]
    got = found(spark, rows)
    assert got == plain_audit(rows)
    assert [r for r in got if r[0] == "yy"] == [("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "xx"]
    assert found(spark, rows, least=1, top=2) == plain_audit(rows, 1, 2)


def test_many_groups_make_pairs_of_tiles(spark):
    rng = random.Random(4)
    rows = [
        (" ".join(f"t{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(0, 12))), "en", f"s{n % 70}") for n in range(280)
    ]
    assert found(spark, rows) == plain_audit(rows)


def test_joint_leaves_are_the_cells_not_zero_on_both_sides():
    rng = np.random.default_rng(2)
    for rows, columns, share in ((1, 1, 1.0), (2, 7, 0.3), (5, 64, 0.02), (32, 100, 0.0), (8, 8, 1.0)):
        a, b = (rng.random((rows, columns)) < share for _ in range(2))
        got = set(zip(*(x.tolist() for x in divergence.joint_leaves(a, b, False)), strict=True))
        cells = [(i, j, k) for i in range(rows) for j in range(rows) for k in range(columns)]
        assert got == {(i, j, k) for i, j, k in cells if a[i, k] or b[j, k]}
        got = set(zip(*(x.tolist() for x in divergence.joint_leaves(a, a, True)), strict=True))
        assert got == {(i, j, k) for i, j, k in cells if i < j and (a[i, k] or a[j, k])}


def test_empty_table_long_text_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [("ab cd " * 50_000, "en", "s", 1, 2), ("ab ef", "en", "t", 1, 2), ("ab ef", "en", "t", 1, 2), ("ef", "en", "t", 1, 2)]
    schema = "text string, lang string, source string, n int, term int"
    assert found(spark, rows, schema) == plain_audit([r[:3] for r in rows])
