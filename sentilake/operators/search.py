"""Grid search over linear classifiers, evaluation, and the step from a fitted model to a scorer."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.config import TrainConfig
from sentilake.operators import bayes_search, solver, validation
from sentilake.operators.certificates import bayes_violation, optimality
from sentilake.operators.features import TfidfModel, vectorize
from sentilake.operators.labels import encode_labels
from sentilake.operators.metrics import confusion_metrics, score_column
from sentilake.operators.models import MARGIN, PROBABILITY, SIGMOIDS, LinearTextModel
from sentilake.operators.solver import HINGE, LOGISTIC, SQUARED_HINGE, Problem, Solution
from sentilake.operators.splitting import assign_folds
from sentilake.session import cut_lineage, remove_checkpoint

REPORT_SCHEMA = (
    "name string, ordinal int, cv_best_score double, test_accuracy double, test_precision_weighted double, "
    "test_recall_weighted double, test_f1_weighted double, best_params map<string,string>"
)

# --- fixed values: the search space ---
C_VALUES = (0.1, 1.0, 5.0)
NB_ALPHAS = (0.1, 0.5, 1.0)
SGD_ALPHAS = (1e-4, 1e-3, 1e-2)
SGD_L1_SHARE = 0.15
#: The solvers stop where the largest subgradient has come down to this share of that of the zero model.
EXACT, STOCHASTIC = 1e-3, 1e-2


@dataclass(frozen=True)
class Point:
    """One point of a model's grid: its loss, its penalties for a number of rows, and its parameters for the report."""

    described: dict[str, str]
    loss: str
    strengths: Callable[[int], tuple[float, float]]
    limit: int
    tolerance: float
    balanced: bool = False
    heavy_intercept: bool = False

    def problems(self, n: int, fold: int | None, classes: int) -> list[Problem]:
        """One machine for two classes, else one for each class against all others."""
        l2, l1 = self.strengths(n)
        one = Problem(self.loss, l2, l1, fold, self.balanced, self.heavy_intercept)
        return [one] if classes == 2 else [replace(one, positive=c) for c in range(classes)]

    def output(self, classes: int) -> str:
        if self.loss != LOGISTIC:
            return MARGIN
        return PROBABILITY if classes == 2 else SIGMOIDS


@dataclass(frozen=True)
class Candidate:
    """A model and its grid in the order in which ties are decided. Naive Bayes has smoothing values instead of points."""

    name: str
    points: tuple[Point, ...] = ()
    alphas: tuple[float, ...] = ()


@dataclass(frozen=True)
class FittedModel:
    """Class by term weights, class intercepts, and the machines they come from."""

    weights: np.ndarray
    intercepts: tuple[float, ...]
    output: str
    problems: tuple[Problem, ...]
    solutions: tuple[Solution, ...]


@dataclass(frozen=True)
class BayesModel:
    """Naive Bayes as (idx, w) and class intercepts."""

    weights: DataFrame
    intercepts: tuple[float, ...]


@dataclass(frozen=True)
class Tuned:
    name: str
    model: FittedModel | BayesModel
    cv_best_score: float
    cv_scores: tuple[float, ...]
    best_params: dict[str, str]
    metrics: dict[str, float]


def search_space(cfg: TrainConfig = TrainConfig()) -> list[Candidate]:
    """The models to search, in declaration order.

    The inverse strength C of a summed loss becomes ``1 / (C * n)`` of the mean loss, with n the rows of the fit; for the
    squared hinge loss likewise. These two penalise the intercept as a weight, the stochastic model does not.
    """

    def summed(c: float) -> Callable[[int], tuple[float, float]]:
        return lambda n: (1.0 / (c * n), 0.0)

    def mixed(alpha: float, share: float) -> Callable[[int], tuple[float, float]]:
        return lambda n: (alpha * (1.0 - share), alpha * share)

    regression = tuple(
        Point({"C": str(c), "class_weight": w}, LOGISTIC, summed(c), cfg.logistic_iterations, EXACT, w == "balanced", True)
        for c in C_VALUES
        for w in ("None", "balanced")
    )
    machine = tuple(
        Point({"C": str(c)}, SQUARED_HINGE, summed(c), cfg.machine_iterations, EXACT, heavy_intercept=True) for c in C_VALUES
    )
    stochastic = tuple(
        Point(
            {"alpha": str(a), "loss": name, "penalty": penalty},
            loss,
            mixed(a, 0.0 if penalty == "l2" else SGD_L1_SHARE),
            cfg.stochastic_iterations,
            STOCHASTIC,
        )
        for a in SGD_ALPHAS
        for name, loss in (("hinge", HINGE), ("log_loss", LOGISTIC))
        for penalty in ("l2", "elasticnet")
    )
    space = {
        "LogisticRegression": Candidate("LogisticRegression", regression),
        "LinearSVC": Candidate("LinearSVC", machine),
        "MultinomialNB": Candidate("MultinomialNB", alphas=NB_ALPHAS),
        "SGDClassifier": Candidate("SGDClassifier", stochastic),
    }
    return [space[name] for name in cfg.models]


def training_vectors(
    train: DataFrame, tfidf: TfidfModel, labels: Sequence[str], cfg: TrainConfig = TrainConfig()
) -> DataFrame:
    """(id, label, features, fold): the rows that fits and validation read.

    Written once, in parts large enough that scheduling does not outweigh the arithmetic.
    """
    fc = tfidf.cfg
    folded = assign_folds(train, fc.id_column, fc.label_column, cfg.cv_folds, cfg.seed)
    encoded = encode_labels(folded, fc.label_column, labels)
    vectors = vectorize(encoded, tfidf).select(
        fc.id_column,
        F.col("label_index").cast("double").alias("label"),
        "features",
        "fold",
    )
    return cut_lineage(vectors.repartition(max(1, math.ceil(encoded.count() / solver.ROWS_PER_FIT_TASK))))


def _test_metrics(test: DataFrame, grid: validation.GridWeights, key: str) -> dict[str, float]:
    table = validation.confusions(test.withColumn("fold", F.lit(0)), grid, key)
    return confusion_metrics(table, "label", "predicted").first().asDict()


def class_sizes(train: DataFrame) -> dict[tuple[int, float], int]:
    """Rows per fold and class."""
    return {(r["fold"], r["label"]): r["count"] for r in train.groupBy("fold", "label").count().collect()}


def tune_bayes(
    candidate: Candidate, train: DataFrame, test: DataFrame, classes: int, cfg: TrainConfig = TrainConfig()
) -> Tuned:
    """All smoothing values of naive Bayes: one pass for the sums, one that validates every fold and value."""
    key = train.columns[0]
    sums = bayes_search.fold_sums(train, cfg.cv_folds, classes)
    grid = bayes_search.held_out_models(sums, candidate.alphas)
    top, means = validation.best_point(validation.fold_scores(train, grid, key, cfg.primary_metric))
    weights, priors = bayes_search.whole_model(sums, candidate.alphas[top])
    whole = validation.GridWeights(weights.withColumn("fold", F.lit(0)), {0: priors}, 1, classes, sums.terms)
    metrics = _test_metrics(test, whole, key)
    described = {"alpha": str(candidate.alphas[top])}
    return Tuned(candidate.name, BayesModel(weights, priors), means[top], tuple(means), described, metrics)


def fitted_models(
    rows: DataFrame,
    wanted: Sequence[tuple[Point, int | None]],
    sizes: dict[tuple[int, float], int],
    classes: int,
    terms: int,
    near: Sequence[np.ndarray] | None = None,
) -> list[FittedModel]:
    """Models of all (grid point, fold left out) pairs, solved together. ``near``: for each of their machines, where to begin."""
    problems, limits, tolerances = [], [], []
    for point, fold in wanted:
        n = sum(k for (f, _), k in sizes.items() if f != fold)
        if not n:
            raise ValueError(f"Fold {fold} leaves no rows to train on.")
        machines = point.problems(n, fold, classes)
        if near:
            machines = [replace(m, near=x) for m, x in zip(machines, near[len(problems) :], strict=False)]
        problems += machines
        limits += [point.limit] * len(machines)
        tolerances += [point.tolerance] * len(machines)
    solutions = solver.solve(rows, problems, limits, tolerances, terms, sizes)
    each = len(problems) // len(wanted)
    out = []
    for n, (point, _) in enumerate(wanted):
        mine = slice(n * each, (n + 1) * each)
        found = [s.weights for s in solutions[mine]]
        # Two classes have one machine: class 0 keeps the score zero.
        weights = np.stack([*([np.zeros(terms + 1)] if classes == 2 else []), *found])
        out.append(
            FittedModel(
                weights[:, :-1], tuple(weights[:, -1]), point.output(classes), tuple(problems[mine]), tuple(solutions[mine])
            )
        )
    return out


def tune_linear(
    candidates: Sequence[Candidate], train: DataFrame, test: DataFrame, classes: int, cfg: TrainConfig = TrainConfig()
) -> list[Tuned]:
    """Cross-validated search over the grids of all linear models at once, refits on all training rows, test metrics.

    Row count and class weights of a fit come from the rows it reads, in each fold as in the refit. All fits share their
    passes over the rows, then one pass validates all points and folds. The first column of ``train`` is the unique row id.
    """
    if not candidates:
        return []
    spark, key = train.sparkSession, train.columns[0]
    sizes = class_sizes(train)
    held = {f for f, _ in sizes}
    if missing := sorted(set(range(cfg.cv_folds)) - held):
        raise ValueError(f"Fold {missing[0]} leaves no rows to validate on.")
    terms = train.select(F.unwrap_udt("features").alias("v")).select(F.coalesce("v.size", F.size("v.values"))).first()[0]
    points = [(c, p) for c, candidate in enumerate(candidates) for p in candidate.points]
    folds = range(cfg.cv_folds)
    machines = len(points) * cfg.cv_folds * (1 if classes == 2 else classes)
    n = sum(sizes.values())
    # Every part gives a gradient for each fit, so parts of few rows are not cut: tasks share their fits instead.
    parts = min(solver.row_parts(n, spark.sparkContext.defaultParallelism, machines, terms), math.ceil(n / solver.FEW_ROWS))
    # Read in the very parts that are written: files would be cut into splits of which most hold no row.
    rows = cut_lineage(solver.entry_rows(train.repartition(parts).sortWithinPartitions("fold")))
    try:
        fitted = fitted_models(rows, [(p, fold) for fold in folds for _, p in points], sizes, classes, terms)
        by_fold = {
            fold: [(m.weights, m.intercepts) for m in fitted[fold * len(points) : (fold + 1) * len(points)]] for fold in folds
        }
        grid = validation.gathered_weights(spark, by_fold)
        scores = validation.fold_scores(train, grid, key, cfg.primary_metric)
        chosen, near = [], []
        for c, candidate in enumerate(candidates):
            mine = [n for n, (owner, _) in enumerate(points) if owner == c]
            top, means = validation.best_point([scores[n] for n in mine])
            chosen.append((candidate.points[top], means[top], tuple(means)))
            # The refit of a point lies near the mean of its folds.
            found = [[s.weights for s in fitted[fold * len(points) + mine[top]].solutions] for fold in folds]
            near += [np.mean(machine, axis=0) for machine in zip(*found, strict=True)]
        whole = fitted_models(rows, [(point, None) for point, _, _ in chosen], sizes, classes, terms, near)
    finally:
        remove_checkpoint(rows)
    out = []
    for candidate, model, (point, best, means) in zip(candidates, whole, chosen, strict=True):
        metrics = _test_metrics(test, validation.gathered_weights(spark, {0: [(model.weights, model.intercepts)]}), key)
        out.append(Tuned(candidate.name, model, best, means, point.described, metrics))
    return out


def tune(
    space: Sequence[Candidate], train: DataFrame, test: DataFrame, classes: int, cfg: TrainConfig = TrainConfig()
) -> list[Tuned]:
    """All models searched, in declaration order. ``train`` and ``test`` are ``training_vectors``."""
    linear = tune_linear([c for c in space if c.points], train, test, classes, cfg)
    found = {t.name: t for t in linear}
    for candidate in space:
        if candidate.alphas:
            found[candidate.name] = tune_bayes(candidate, train, test, classes, cfg)
    return [found[c.name] for c in space]


def certificate(tuned: Tuned, train: DataFrame) -> dict[str, Any]:
    """How far a searched model is from the minimum of its objective, and whether its solver stopped by itself.

    ``violation`` is the largest distance of zero from a coordinate's subgradient over all machines, as a share of that of the
    zero model, counted anew from the rows. Naive Bayes has no solver: its violation is how far the term shares of a class
    are from a sum of one.
    """
    if isinstance(tuned.model, BayesModel):
        worst = bayes_violation(tuned.model.weights, len(tuned.model.intercepts))
        return {"name": tuned.name, "converged": True, "violation": worst}
    sizes = class_sizes(train)
    found = []
    for problem, solution in zip(tuned.model.problems, tuned.model.solutions, strict=True):
        row = optimality(train, problem, solution.weights, solver.class_shares(problem, sizes)).first()
        found.append(row["violation"] / (row["scale"] or 1.0))
    return {"name": tuned.name, "converged": all(s.converged for s in tuned.model.solutions), "violation": max(found)}


def score_table(tuned: Sequence[Tuned], spark: Any) -> DataFrame:
    """One row per tuned model, in declaration order."""
    return spark.createDataFrame(
        [
            (
                t.name,
                i,
                float(t.cv_best_score),
                *[t.metrics[c] for c in ("test_accuracy", "test_precision_weighted", "test_recall_weighted", "test_f1_weighted")],
                t.best_params,
            )
            for i, t in enumerate(tuned)
        ],
        REPORT_SCHEMA,
    )


def pick_best(tuned: Sequence[Tuned], metric: str) -> Tuned:
    """Highest metric; the first declared wins a tie."""
    if not tuned:
        raise ValueError("There is no searched model to choose from.")
    column = score_column(metric)
    best = tuned[0]
    for candidate in tuned[1:]:
        if candidate.metrics[column] > best.metrics[column]:
            best = candidate
    return best


def model_report(scores: DataFrame, best: str, metric: str, artifact_path: str) -> DataFrame:
    """One row {primary_metric, best_model{...}, models{name -> scores}}; a row per model goes in."""
    fields = ("cv_best_score", "test_accuracy", "test_precision_weighted", "test_recall_weighted", "test_f1_weighted")
    entry = F.struct(F.col("name"), F.struct(*fields, "best_params"))
    chosen = F.struct(
        F.col("name"),
        F.col(score_column(metric)).alias("score"),
        F.lit(artifact_path).alias("artifact_path"),
        F.col("name").alias("estimator"),
        F.col("best_params"),
    )
    return scores.agg(
        F.first(F.when(F.col("name") == best, chosen), ignorenulls=True).alias("best_model"),
        F.map_from_entries(F.collect_list(entry)).alias("models"),
    ).select(F.lit(metric).alias("primary_metric"), "best_model", "models")


def as_text_model(model: Model | FittedModel | BayesModel, tfidf: TfidfModel, labels: Sequence[str]) -> LinearTextModel:
    """The fitted model as a (term, weights) table for relational scoring.

    Coefficients are at most ``max_features`` rows per class.
    """
    vocabulary = tfidf.vocabulary.select("term", "idx", "idf")
    if isinstance(model, BayesModel):
        weights, intercepts, output = model.weights, model.intercepts, PROBABILITY
        size = vocabulary.count()
    else:
        if isinstance(model, FittedModel):
            matrix, intercepts, output = model.weights, model.intercepts, model.output
        else:
            rows, intercepts, output = _coefficients(model)
            matrix = np.array([np.asarray(r, float) for r in rows])
        size = matrix.shape[1]
        weights = validation.gathered_weights(vocabulary.sparkSession, {0: [(matrix, intercepts)]}).table.drop("fold")
    joined = vocabulary.join(weights, "idx").select("term", "idx", "idf", "w")
    return LinearTextModel(joined, tuple(labels), tuple(float(b) for b in intercepts), output, size)


def _coefficients(model: Model) -> tuple[list[Any], list[float], str]:
    kind = type(model).__name__
    if kind == "LogisticRegressionModel":
        if model.numClasses == 2:
            return [[0.0] * model.numFeatures, model.coefficients.toArray()], [0.0, float(model.intercept)], PROBABILITY
        return list(model.coefficientMatrix.toArray()), [float(b) for b in model.interceptVector], PROBABILITY
    if kind == "NaiveBayesModel":
        return list(model.theta.toArray()), [float(p) for p in model.pi.toArray()], PROBABILITY
    if kind == "LinearSVCModel":
        return [[0.0] * model.numFeatures, model.coefficients.toArray()], [0.0, float(model.intercept)], MARGIN
    if kind == "OneVsRestModel":
        parts = model.models
        return [m.coefficients.toArray() for m in parts], [float(m.intercept) for m in parts], MARGIN
    raise ValueError(f"Unsupported model type {kind}")
