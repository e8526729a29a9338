import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sentilake.llm import decontaminate, ngrams, passages, quality


def vocabulary(draw, n=3000):
    return ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(3, 8))) for _ in range(n)]


def grams(w, size=5):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def agree(a, b):
    a, b = grams(a), grams(b)
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


# ---- decontamination ----------------------------------------------------------------------


def normal(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def test_contaminated_equals_windows_by_hand(spark):
    draw = random.Random(1)
    v = vocabulary(draw)
    items = [[draw.choice(v) for _ in range(draw.randint(5, 45))] for _ in range(25)]
    docs = []
    for n in range(120):
        body = [draw.choice(v) for _ in range(draw.randint(0, 150))]
        if n % 3 == 0:
            leak = list(draw.choice(items))
            for _ in range(n % 4):
                at = draw.randrange(len(leak))
                leak[at : at + 1] = draw.choice([[], [draw.choice(v)], [leak[at], draw.choice(v)]])
            at = draw.randint(0, len(body))
            body[at:at] = leak
        docs.append((n, draw.choice([" ", ", ", "\n"]).join(body).title()))
    docs += [(500, None), (501, ""), (None, " ".join(items[0])), (502, " ".join(items[1] * 3)), (0, "other text"), (502, " ".join(items[1] * 3))]
    benchmark = [(n, " ".join(i)) for n, i in enumerate(items)] + [(90, "too few words"), (91, None), (92, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("clash"))
    known = spark.createDataFrame(benchmark, "item_id long, text string")
    want = set()
    for i, text in docs:
        w = normal(text)
        for item, t in benchmark:
            b = normal(t)
            if len(b) >= 5 and any(agree(w[s : s + len(b)], b) >= 0.8 for s in range(max(1, len(w) - len(b) + 1))):
                want.add((i, item))
    got = decontaminate.contaminated(df, known).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want) and all(r["similarity"] >= 0.8 for r in got)
    clean = decontaminate.drop_contaminated(df, known)
    assert clean.columns == df.columns
    leaked = {i for i, _ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(
        i for i, t in docs if i not in leaked or (i == 0 and t == "other text")
    )
    assert decontaminate.contaminated(df.limit(0), known).count() == 0
    assert decontaminate.contaminated(df, known.limit(0)).count() == 0


def test_reordered_items_are_contamination(spark):
    """Halves of an item swapped: only a start that no shingle is aligned with gives the window."""
    draw = random.Random(2)
    v = vocabulary(draw)
    items = [[draw.choice(v) for _ in range(n)] for n in (50, 50, 80, 46)]
    body = lambda: [draw.choice(v) for _ in range(30)]
    docs = {n: body() + item[len(item) // 2 :] + item[: len(item) // 2] + body() for n, item in enumerate(items)}
    docs[10] = body() + items[0][:25] + body() + items[0][25:] + body()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    known = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(df, known).collect()}
    assert set(got) == {(n, n) for n in range(4)}
    for (i, item), r in got.items():
        levels = [agree(docs[i][s : s + len(items[item])], items[item]) for s in range(len(docs[i]) - len(items[item]) + 1)]
        assert r["similarity"] == max(levels) and r["start"] == levels.index(max(levels))


# ---- quality ------------------------------------------------------------------------------


def test_gram_buckets_follow_the_words():
    texts = ["a b a b", "", None, "b!! b!! é", "a b a b"]
    for _, _, data, offsets in ngrams.chunks(pa.array(texts)):
        bucket, row = quality.gram_buckets(data, offsets, 1 << 30)
        by_row = [sorted(bucket[row == n].tolist()) for n in range(len(texts))]
    assert [len(b) for b in by_row] == [7, 0, 0, 9, 7]
    assert by_row[0] == by_row[4] and len(set(by_row[0])) == 4


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7)]).slice(1)
    seen = [(a, b, len(d)) for a, b, d, _ in ngrams.chunks(texts, 50)]
    assert seen[0][0] == 0 and seen[-1][1] == 5 and sum(s[2] for s in seen) == 115


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 10)
    draw = random.Random(4)
    values = [draw.gauss(0, 100) for _ in range(3000)] + [7.5] * 500 + [None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    ranked = sorted((x for x in values if x is not None), reverse=True)
    for k in (1, 2, 700, 1500, 3499):
        assert quality.kth_largest(df, "x", k) == ranked[k - 1]
    assert quality.kth_largest(df, "x", 3500) == -math.inf and quality.kth_largest(df, "x", 0) == math.inf


def test_best_cut():
    w, g = np.array([-9.0, -3.0, 1.0, 4.0]), np.array([False, False, True, True])
    assert quality.best_cut(w, g) == -1.0
    assert quality.best_cut(w, g | True) == -math.inf and quality.best_cut(w, g & False) == math.inf
    assert quality.best_cut(w[:0], g[:0]) == -math.inf


def test_junk_goes_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "the and of")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).withColumn("weight", F.lit("clash"))
    fitted, weights = quality.fit_quality(docs, labels)
    kept = fitted.keep(docs)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert ids == {r[0] for r in weights.filter(F.col("key") >= fitted.cut).select("doc_id").collect()}
    known = labels.collect()
    good = [r["doc_id"] in ids for r in known if r["quality"] == 1]
    bad = [r["doc_id"] in ids for r in known if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert ids >= {10**9, 10**9 + 1, None}


def test_toxic_text_of_quality_counts_as_bad(spark):
    draw = random.Random(9)
    kinds = [(300, 1, 0, "g"), (80, 1, 1, "t"), (400, 0, 0, "b")]
    rows = []
    for n, good, toxic, letter in kinds:
        rows += [(len(rows) + i, " ".join(f"{letter}{draw.randrange(50)}" for _ in range(40)), good, toxic) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    fitted, _ = quality.fit_quality(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"))
    assert {r["doc_id"] for r in fitted.keep(df).collect()} == set(range(300))


def test_quality_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == 2
    assert quality.resample(docs.limit(0), labels).count() == 0


# ---- passages -----------------------------------------------------------------------------


def test_compact_windows_equal_brute_force():
    draw = np.random.default_rng(3)
    for size in (1, 3, 7):
        row = np.sort(draw.integers(0, 4, 60))
        values = draw.integers(0, 25, 60).astype(np.uint64) << np.uint64(40)
        got = set(zip(*[x.tolist() for x in passages.compact_windows(values, row, size)], strict=True))
        want = set()
        for c in range(60):
            left = right = c
            while left and row[left - 1] == row[c] and values[left - 1] > values[c]:
                left -= 1
            while right < 59 and row[right + 1] == row[c] and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= size:
                want.add((c, left, right))
        assert got == want


def test_repeated_passages_are_found_and_others_left_alone(spark):
    draw = random.Random(6)
    v = vocabulary(draw, 5000)
    fresh = lambda n: [draw.choice(v) for _ in range(n)]
    shared, hot, line = fresh(70), fresh(60), fresh(20)
    docs = {i: fresh(draw.randint(60, 200)) for i in range(150)}
    for i in (10, 20):
        docs[i][30:30] = shared
    edited = list(shared)
    edited[35] = "changed"
    docs[30][5:5] = edited
    for i in range(50, 100):
        docs[i][draw.randint(0, 40) : 0] = hot
    for i in range(100, 150):
        docs[i][draw.randint(0, 50) : 0] = line
    docs[40] = list(docs[41])
    docs[42] = fresh(30)
    docs[43] = list(docs[42])
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(200, None), (201, ""), (None, " ".join(shared)), (202, "w " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = passages.repeated_passages(df).collect()
    hit = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert hit == {10, 20, 30, 40, 41, *range(50, 100)}
    split = {i: t.split() for i, t in rows if t}
    for r in got:
        a, b = split[r["doc_id"]][r["start"] : r["end"]], split[r["other_id"]][r["other_start"] : r["other_end"]]
        assert len(a) == len(b) >= 50 and r["other_id"] < r["doc_id"]
        assert max(agree(a[n : n + 50], b[n : n + 50]) for n in range(len(a) - 49)) >= 0.8
    assert all(any(r["doc_id"] == i for r in got) for i in range(51, 100))
    assert passages.repeated_passages(df.limit(0)).count() == 0


def fresh_words(seed):
    draw = random.Random(seed)
    v = vocabulary(draw, 5000)
    return draw, lambda n: [draw.choice(v) for _ in range(n)]


def named(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    return passages.repeated_passages(df).collect()


def test_a_later_copy_of_a_line_brings_its_passage(spark):
    """The smaller id holds the line in other text first, once and again, and only later within the shared passage."""
    missed = []
    for seed in range(2):
        _, fresh = fresh_words(seed)
        docs = {}
        for n in range(12):
            line = fresh(40)
            passage = fresh(6) + line + fresh(6)
            docs[2 * n] = fresh(60) + line + fresh(60) + line + fresh(60) + passage + fresh(60)
            docs[2 * n + 1] = fresh(70) + passage + fresh(70)
        found = {(r["doc_id"], r["other_id"]) for r in named(spark, docs) if r["end"] <= 70 + 52 + 5 and r["other_start"] >= 250}
        missed += [(seed, n) for n in range(12) if (2 * n + 1, 2 * n) not in found]
    assert not missed


def test_passages_in_long_groups_of_a_line_are_found(spark):
    """Thirty documents hold a line; pairs of them hold passages around it, and the smallest id holds it elsewhere."""
    for seed in (50,):
        _, fresh = fresh_words(seed)
        line = fresh(40)
        docs = {0: fresh(60) + line + fresh(60)}
        for n in range(1, 15):
            passage = fresh(6) + line + fresh(6)
            for i in (2 * n, 2 * n + 1):
                docs[i] = fresh(60) + passage + fresh(60)
        found = {(r["doc_id"], r["other_id"]) for r in named(spark, docs)}
        assert found == {(2 * n + 1, 2 * n) for n in range(1, 15)}


def test_variants_alike_to_each_other_but_not_to_the_first_are_found(spark):
    draw, fresh = fresh_words(70)
    base = fresh(54)
    docs = {0: fresh(60) + base[:10] + fresh(1) + base[11:27] + fresh(1) + base[28:44] + fresh(1) + base[45:] + fresh(60)}
    for i in range(1, 30):
        docs[i] = fresh(60) + base[:26] + fresh(1) + base[27:] + fresh(60)
    twin = base[:10] + fresh(1) + base[11:26] + fresh(1) + base[27:]
    docs[30], docs[31] = fresh(60) + twin + fresh(60), fresh(60) + twin + fresh(60)
    assert (31, 30) in {(r["doc_id"], r["other_id"]) for r in named(spark, docs)}


# ---- pipeline -----------------------------------------------------------------------------


def test_stages_keep_the_columns_and_their_decisions_hold(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3]
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert placed.count() == counts[-1] and set(docs.columns) < set(placed.columns)


def test_run_on_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_the_map_of_documents_with_windows_loses_none(spark, monkeypatch):
    rows = spark.createDataFrame([(n if n % 9 else None, n * 7919) for n in range(3000)], "doc_id long, body long")
    chosen = rows.filter("body % 5 = 0")
    for bits in (27, 17):
        monkeypatch.setattr(decontaminate, "MAP_BITS", bits)
        kept = decontaminate.marked_rows(rows, chosen, "doc_id", "body")
        assert kept.columns == rows.columns
        got = {tuple(r) for r in kept.collect()}
        want = {tuple(r) for r in chosen.collect()}
        assert want <= got and len(got) < len(want) + (5 if bits == 27 else 60)
    assert decontaminate.marked_rows(rows, chosen.limit(0), "doc_id", "body").count() == 0


def _brute_runs(a, b, size, similarity):
    """Runs of agreeing windows of one pair: those that lie over each other, or if there are none, all with moved shingles."""
    over = [sum(x == y for x, y in zip(a[n : n + size], b[n : n + size], strict=True)) for n in range(len(a) - size + 1)]
    moved = [sum((Counter(a[n : n + size]) & Counter(b[n : n + size])).values()) for n in range(len(a) - size + 1)]
    levels = [[s / (2 * size - s) for s in shared] for shared in (over, moved)]
    level = levels[0] if max(levels[0]) >= similarity else levels[1]
    runs, start = [], None
    for n, x in enumerate([*level, 0.0]):
        if x >= similarity and start is None:
            start = n
        elif x < similarity and start is not None:
            runs.append((start, n - 1, max(level[start:n])))
            start = None
    return runs


def test_stretches_verified_together_agree_with_each_alone():
    rng = np.random.default_rng(5)
    for trial in range(60):
        size, similarity = (46, 0.8) if trial % 2 else (int(rng.integers(1, 9)), float(rng.choice([0.3, 0.5, 0.8, 1.0])))
        pairs = []
        for _ in range(6):
            span = int(rng.choice([2, 9, 2**31 - 1]))  # few values: shingles that stand in a window several times
            a = rng.integers(-span, span, size + int(rng.integers(0, 60))).astype(np.int32)
            b = np.roll(a, int(rng.integers(0, 4)))
            other = rng.random(len(a)) < rng.choice([0.0, 0.1, 1.0])
            b[other] = rng.integers(-span, span, other.sum())
            pairs.append((a, b))
        flat = [np.concatenate(side) for side in zip(*pairs, strict=True)]
        found = passages.agreeing_runs(*flat, np.array([len(a) for a, _ in pairs]), size, similarity)
        wanted = [(n, *run) for n, (a, b) in enumerate(pairs) for run in _brute_runs(a.tolist(), b.tolist(), size, similarity)]
        assert list(zip(*[x.tolist() for x in found], strict=True)) == wanted


def test_common_shingles_are_counted_in_the_same_documents_whatever_their_order(spark):
    """Before, the eighth of the documents was drawn by place, so the stretches that were compared changed with the files."""
    rng = np.random.default_rng(6)
    rows = [(n, " ".join(f"w{x}" for x in rng.integers(0, 9999, 20))) for n in range(400)]
    found = [passages.shingle_levels(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)) for x in (rows, rows[::-1])]
    assert found[0].any() and (found[0] == found[1]).all()
