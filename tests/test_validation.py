"""Batched validation and the naive Bayes search against one fit and one scoring after another."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest, LinearSVC
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sentilake.operators import bayes_search, search, validation

TERMS, FOLDS = 6, 3


def table(spark, classes, n=90, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = float(rng.randrange(classes))
        entries = {t: rng.random() + (t % classes == label) for t in rng.sample(range(TERMS - 1), rng.randint(0, 4))}
        v = Vectors.sparse(TERMS, entries) if i % 3 else Vectors.dense([entries.get(t, 0.0) for t in range(TERMS)])
        rows.append((i, label, v, i % FOLDS, 1.0))
    return rows, spark.createDataFrame(rows, ["id", "label", "features", "fold", "unit"]).withColumn("fold", F.col("fold").cast("int"))


def plain_bayes(rows, alpha, classes):
    x = np.array([r[2].toArray() for r in rows])
    y = np.array([int(r[1]) for r in rows])
    sums = np.array([x[y == c].sum(axis=0) for c in range(classes)])
    with np.errstate(divide="ignore"):
        priors = np.log(np.bincount(y, minlength=classes) / len(y))
    return np.log((sums + alpha) / (sums.sum(axis=1, keepdims=True) + alpha * TERMS)), priors


@pytest.mark.parametrize("classes", [2, 3])
def test_every_fold_and_alpha_equals_a_fit_of_its_own(spark, classes):
    rows, df = table(spark, classes)
    sums = bayes_search.fold_sums(df, FOLDS, classes)
    alphas = (0.1, 2.0)
    grid = bayes_search.held_out_models(sums, alphas)
    got = {r.id: (r.fold, r.scores) for r in validation.class_scores(df, grid, "id").collect()}
    assert len(got) == len(rows)
    for i, _, v, fold, _ in rows:
        want = []
        for alpha in alphas:
            w, b = plain_bayes([r for r in rows if r[3] != fold], alpha, classes)
            want += list(w @ v.toArray() + b)
        assert got[i] == (fold, pytest.approx(want))
    weights, priors = bayes_search.whole_model(sums, 0.5)
    w, b = plain_bayes(rows, 0.5, classes)
    assert priors == pytest.approx(tuple(b))
    for r in weights.collect():
        assert r.w == pytest.approx(list(w[:, r.idx]))
    # shares of a class's terms sum to one, with terms that no row shows
    assert weights.agg(F.sum(F.exp(F.get("w", F.lit(0)))).alias("t")).first().t == pytest.approx(1.0)
    assert weights.count() == TERMS


def test_a_class_that_only_one_fold_holds_cannot_be_predicted_there(spark):
    rows = [(i, float(i % 2), Vectors.sparse(2, {i % 2: 1.0}), i % 2, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, ["id", "label", "features", "fold", "unit"]).withColumn("fold", F.col("fold").cast("int"))
    sums = bayes_search.fold_sums(df, 2, 2)
    grid = bayes_search.held_out_models(sums, (1.0,))
    assert grid.intercepts == {0: (-math.inf, 0.0), 1: (0.0, -math.inf)}
    assert validation.fold_scores(df, grid, "id", "accuracy") == [[0.0, 0.0]]
    with pytest.raises(ValueError, match="Fold 0"):
        bayes_search.held_out_models(bayes_search.fold_sums(df.filter("fold = 0"), 2, 2), (1.0,))


@pytest.mark.parametrize("metric", ["f1_weighted", "accuracy"])
def test_one_pass_scores_like_one_model_after_another(spark, metric):
    for classes in (2, 3):
        _, df = table(spark, classes, seed=classes)
        df = df.cache()
        estimators = [LogisticRegression(maxIter=5, regParam=r) for r in (0.01, 1.0)]
        if classes == 3:
            estimators.append(OneVsRest(classifier=LinearSVC(maxIter=5, regParam=0.1)))
        evaluator = MulticlassClassificationEvaluator(metricName={"f1_weighted": "f1"}.get(metric, metric))
        models, want = {}, []
        for fold in range(FOLDS):
            fitted = [e.fit(df.filter(F.col("fold") != fold)) for e in estimators]
            models[fold] = [(np.array([np.asarray(r) for r in w]), b) for w, b, _ in map(search._coefficients, fitted)]
            want.append([evaluator.evaluate(m.transform(df.filter(F.col("fold") == fold))) for m in fitted])
        grid = validation.gathered_weights(spark, models)
        got = validation.fold_scores(df, grid, "id", metric)
        assert np.array(got) == pytest.approx(np.array(want).T)


def test_one_scan_serves_all_points(spark):
    _, df = table(spark, 2)
    sums = bayes_search.fold_sums(df, FOLDS, 2)
    grid = bayes_search.held_out_models(sums, (0.1, 0.5, 1.0))
    seen = validation.confusions(df, grid, "id")
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    # the rows stand once on the scored side and once on the side that keeps rows without terms
    assert plan.count("features") and plan.count("Aggregate") == 2
    assert seen.agg(F.sum("n")).first()[0] == 3 * df.count()


def test_ties_go_to_the_first_class_and_the_first_point(spark):
    rows = [(0, 0.0, Vectors.sparse(2, {}), 0, 1.0), (1, 1.0, Vectors.sparse(2, {}), 0, 1.0)]
    df = spark.createDataFrame(rows, ["id", "label", "features", "fold", "unit"]).withColumn("fold", F.col("fold").cast("int"))
    grid = validation.gathered_weights(spark, {0: [(np.zeros((2, 2)), [0.0, 0.0])] * 2})
    assert {(r.point, r.predicted) for r in validation.confusions(df, grid, "id").collect()} == {(0, 0), (1, 0)}
    assert validation.best_point([[0.5, 0.5], [0.5, 0.5], [0.4, 0.6]])[0] == 0
