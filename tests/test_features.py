"""Vocabulary, TF-IDF, split, folds, labels and metrics against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentilake.config import FeatureConfig
from sentilake.operators import features, labels, metrics, search, splitting
from sentilake.plans import jobs

DOCS = [
    (1, "aa bb cc aa", "p"),
    (2, "aa bb dd", "n"),
    (3, "aa cc cc ee", "p"),
    (4, "zz", "n"),
    (5, "aa", "p"),
    (6, "aa bb", "n"),
]
CFG = FeatureConfig(id_column="id", text_column="t", label_column="l")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, t string, l string")


def brute_terms(t):
    w = [x for x in t.split() if len(x) >= 2]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(cfg):
    n = len(DOCS)
    df, tf = Counter(), Counter()
    for _, t, _ in DOCS:
        tf.update(brute_terms(t))
        df.update(set(brute_terms(t)))
    kept = [t for t in df if df[t] >= cfg.min_df and df[t] <= cfg.max_df * n]
    kept = sorted(sorted(kept, key=lambda t: (-tf[t], t))[: cfg.max_features])
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    x = {}
    for i, t, _ in DOCS:
        c = {k: v * idf[k] for k, v in Counter(brute_terms(t)).items() if k in idf}
        norm = math.sqrt(sum(v * v for v in c.values()))
        x.update({(i, k): v / norm for k, v in c.items()})
    return kept, df, tf, idf, x


@pytest.mark.parametrize("k", [50_000, 3, 2, 1])
def test_vocabulary_and_weights(docs, k):
    cfg = FeatureConfig(id_column="id", text_column="t", label_column="l", max_features=k)
    kept, df, tf, idf, x = brute(cfg)
    model = features.fit_tfidf(docs, cfg)
    assert model.n_docs == len(DOCS)
    rows = model.vocabulary.orderBy("idx").collect()
    assert [r.term for r in rows] == kept and [r.idx for r in rows] == list(range(len(kept)))
    assert [(r.df, r.tf) for r in rows] == [(df[t], tf[t]) for t in kept]
    assert [r.idf for r in rows] == pytest.approx([idf[t] for t in kept])
    got = {(r.id, r.term): r.tfidf for r in features.tfidf_long(docs, model).collect()}
    assert got.keys() == x.keys()
    assert [got[i] for i in x] == pytest.approx(list(x.values()))


def test_no_task_gathers_terms_before_they_are_placed(docs):
    stats = features.term_statistics(docs, CFG)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" in plan
    # The plan is printed from its end: what follows the exchange runs where the texts are read.
    assert "Aggregate" not in plan[plan.index("Exchange") :]
    _, df, tf, _, _ = brute(CFG)
    got = {r.term: (r.df, r.tf) for r in stats.collect()}
    assert got.pop(features.EVERY_DOCUMENT) == (len(DOCS), 0)
    assert got == {t: (df[t], tf[t]) for t in df}


def test_max_df_cut(docs):
    cfg = FeatureConfig(id_column="id", text_column="t", label_column="l", max_df=0.5, min_df=1)
    kept = [r.term for r in features.fit_tfidf(docs, cfg).vocabulary.orderBy("idx").collect()]
    assert kept == brute(cfg)[0] and "aa" not in kept and "zz" in kept


def test_vectors_equal_long_form(docs):
    model = features.fit_tfidf(docs, CFG)
    long = {(r.id, r.idx): r.tfidf for r in features.tfidf_long(docs, model).collect()}
    for row in features.vectorize(docs, model).collect():
        v = row.features
        assert {(row.id, int(i)): x for i, x in zip(v.indices, v.values)} == pytest.approx(
            {k: x for k, x in long.items() if k[0] == row.id}
        )


def test_shuffle_partitions_do_not_change_the_result(spark, docs):
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        model = features.fit_tfidf(docs, CFG)
        seen.append(sorted((r.id, r.term, round(r.tfidf, 12)) for r in features.tfidf_long(docs, model).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_for_any_histogram(spark, monkeypatch, digits):
    monkeypatch.setattr(splitting, "CELL_DIGITS", digits)
    # one class holds nearly all rows, one holds a single row, one is null
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") == 7, None).when(F.col("id") == 8, "one").when(F.col("id") % 50 == 0, "b").otherwise("a").alias("l")
    )
    got = splitting.assign_split(rows, "id", "l", 0.2, 42).collect()
    assert len(got) == 3000
    for label in ("a", "b", "one", None):
        part = [r for r in got if r.l == label]
        test = sum(r.split == "test" for r in part)
        assert test == math.floor(len(part) * 0.2 + 0.5)
    again = {(r.id, r.split) for r in splitting.assign_split(rows.repartition(7), "id", "l", 0.2, 42).collect()}
    assert again == {(r.id, r.split) for r in got}
    other = {(r.id, r.split) for r in splitting.assign_split(rows, "id", "l", 0.2, 43).collect()}
    assert other != again


def test_split_does_not_shuffle_the_table(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("l"), F.lit("wide").alias("text"))
    plan = splitting.assign_split(rows, "id", "l")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("digits", [1, 4])
def test_folds_are_balanced_per_class(spark, monkeypatch, digits):
    monkeypatch.setattr(splitting, "CELL_DIGITS", digits)
    rows = spark.range(1001).select("id", F.when(F.col("id") < 5, "x").otherwise("y").alias("l"))
    got = splitting.assign_folds(rows, "id", "l", 3).groupBy("l", "fold").count().collect()
    assert sorted((r.l, r.fold, r["count"]) for r in got) == [
        ("x", 0, 2), ("x", 1, 2), ("x", 2, 1), ("y", 0, 332), ("y", 1, 332), ("y", 2, 332),
    ]


def test_tiny_classes_have_folds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, l string")
    got = {(r.l, r.fold) for r in splitting.assign_folds(rows, "id", "l", 3).collect()}
    assert got == {("a", 0), ("b", 0), ("b", 1)}


def test_too_many_classes_are_refused(spark):
    rows = spark.range(7500).select("id", (F.col("id") % 1500).cast("string").alias("l"))
    with pytest.raises(ValueError, match="classes"):
        splitting.assign_split(rows, "id", "l")


def test_labels(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "zz")], "id long, l string")
    assert [tuple(r) for r in labels.label_index_table(rows, "l").collect()] == [("", 0), ("a", 1), ("b", 2), ("zz", 3)]
    coded = labels.encode_labels(rows, "l", ["", "a", "b"]).orderBy("id")
    assert [r.label_index for r in coded.collect()] == [2, 0, 1, None]
    assert [r.x for r in labels.decode_labels(coded, "label_index", ["", "a", "b"], "x").collect()] == ["b", "", "a", None]
    assert [r.x for r in labels.decode_labels(coded, "label_index", None, "x").collect()] == ["2", "0", "1", None]


def brute_weighted(pairs):
    classes = sorted({c for p in pairs for c in p})
    out = np.zeros(3)
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        called, support = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p = tp / called if called else 0.0
        r = tp / support if support else 0.0
        out += np.array([p, r, 2 * p * r / (p + r) if p + r else 0.0]) * support / len(pairs)
    return [sum(a == b for a, b in pairs) / len(pairs), *out]


@pytest.mark.parametrize(
    "pairs",
    [
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")],
        [("a", "b"), ("a", "b")],
        [("a", "a")] * 5 + [("b", "a")],
    ],
)
def test_weighted_metrics(spark, pairs):
    got = metrics.weighted_metrics(spark.createDataFrame(pairs, "l string, p string"), "l", "p").first()
    assert list(got) == pytest.approx(brute_weighted(pairs))
    assert got.test_recall_weighted == pytest.approx(got.test_accuracy)


def test_metric_names():
    assert metrics.score_column("f1_weighted") == "test_f1_weighted"
    with pytest.raises(ValueError, match="chosen by 'auc'"):
        metrics.score_column("auc")


def test_rows_are_made_once_for_split_vocabulary_folds_and_vectors(spark):
    """Before, each of these passes cleaned every text anew."""
    made = spark.sparkContext.accumulator(0)

    def clean(text):
        made.add(1)
        return text.lower()

    raw = [(n, f"Good word{n % 7} film", "positive" if n % 2 else "negative") for n in range(60)]
    df = spark.createDataFrame(raw, ["review_id", "text", "sentiment"]).withColumn("text_clean", F.udf(clean)("text"))
    built = jobs.build_features(df, FeatureConfig())
    train, test = (search.training_vectors(part, built.tfidf, built.labels) for part in (built.train, built.test))
    assert train.count() + test.count() == 60 and set(built.rows.columns) == {*df.columns, "split"}
    assert made.value == 60


def test_rows_that_parquet_cannot_hold_are_kept_too(spark):
    rows = [(n, f"good word{n % 3} film", "positive" if n % 2 else "negative") for n in range(40)]
    df = spark.createDataFrame(rows, ["review_id", "text_clean", "sentiment"]).withColumn("nothing", F.lit(None))
    assert jobs.build_features(df, FeatureConfig()).rows.filter("nothing IS NULL").count() == 40
