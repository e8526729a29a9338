"""The batched solver against plain descent, and its results against subgradients counted by Spark."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sentilake.operators import certificates, search, solver
from sentilake.operators.solver import HINGE, LOGISTIC, SQUARED_HINGE, Problem
from sentilake.session import written

TERMS = 12


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        label = float(rng.random() < 0.3)
        entries = {t: rng.uniform(0.1, 1) + (t < 4) * label for t in rng.sample(range(TERMS), rng.randint(0, 5))}
        v = Vectors.sparse(TERMS, entries) if i % 4 else Vectors.dense([entries.get(t, 0.0) for t in range(TERMS)])
        rows.append((i, label, v, i % 3))
    df = spark.createDataFrame(rows, ["id", "label", "features", "fold"]).repartition(3).cache()
    sizes = search.class_sizes(df)
    return rows, df, written(solver.entry_rows(df), "rows")[0], sizes


def objective(rows, problem, w, sizes):
    kept = [r for r in rows if r[3] != problem.left_out]
    x = np.array([r[2].toArray() for r in kept])
    y = np.array([1.0 if int(r[1]) == problem.positive else -1.0 for r in kept])
    shares = solver.class_shares(problem, sizes)
    c = np.array([shares[int(r[1])] for r in kept])
    loss, _ = solver.loss_and_slope(problem.loss, y * (x @ w[:-1] + w[-1]))
    last = w[-1] ** 2 if problem.heavy_intercept else 0.0
    return float(c @ loss) + problem.l2 / 2 * (w[:-1] @ w[:-1] + last) + problem.l1 * np.abs(w[:-1]).sum()


PROBLEMS = [
    Problem(LOGISTIC, 0.01, heavy_intercept=True),
    Problem(LOGISTIC, 0.01, balanced=True, left_out=1),
    Problem(LOGISTIC, 0.002, 0.01),
    Problem(LOGISTIC, 0.1, 0.2),
    Problem(SQUARED_HINGE, 0.01, heavy_intercept=True, left_out=0),
    Problem(HINGE, 0.01, left_out=2),
    Problem(HINGE, 0.005, 0.01),
    Problem(LOGISTIC, 0.01, positive=0),
]


def solved(data, problems=PROBLEMS, limit=400, tolerance=1e-4):
    _, _, rows, sizes = data
    n = len(problems)
    return solver.solve(rows, problems, [limit] * n, [tolerance] * n, TERMS, sizes)


def test_no_step_aside_is_lower(data):
    rng = np.random.default_rng(0)
    for problem, found in zip(PROBLEMS, solved(data), strict=True):
        assert found.converged and found.violation <= 1e-4 * found.scale, problem
        best = objective(data[0], problem, found.weights, data[3])
        for size in (1e-3, 1e-2, 0.3):
            for _ in range(60):
                aside = found.weights + rng.normal(0, size, TERMS + 1)
                assert objective(data[0], problem, aside, data[3]) >= best - 1e-6, problem
        assert objective(data[0], problem, np.zeros(TERMS + 1), data[3]) >= best
    sparse = solved(data, [Problem(LOGISTIC, 0.0, 0.02), Problem(LOGISTIC, 0.0, 10.0)])
    assert 0 < (sparse[0].weights[:-1] == 0).sum() < TERMS
    assert not sparse[1].weights[:-1].any() and sparse[1].weights[-1] != 0


def test_problems_solved_together_and_alone_agree(data):
    together = solved(data)
    for n in (1, 6):
        (alone,) = solved(data, [PROBLEMS[n]])
        assert alone.weights == pytest.approx(together[n].weights) and alone.iterations == together[n].iterations
    mirrored = solved(data, [Problem(LOGISTIC, 0.01)])[0].weights
    assert together[-1].weights == pytest.approx(-mirrored, abs=1e-3)


def test_spark_sums_blocks_where_the_driver_must_not(data, monkeypatch):
    plain = solved(data, PROBLEMS[:3], limit=6)
    monkeypatch.setattr(solver, "DRIVER_BYTES", 0)
    monkeypatch.setattr(solver, "BLOCK", 5)
    for a, b in zip(plain, solved(data, PROBLEMS[:3], limit=6), strict=True):
        assert a.weights == pytest.approx(b.weights) and a.iterations == b.iterations


@pytest.mark.parametrize("n", range(len(PROBLEMS)))
def test_certificate_counts_the_same_subgradient(data, n):
    problem, found = PROBLEMS[n], solved(data, PROBLEMS[n : n + 1])[0]
    shares = solver.class_shares(problem, data[3])
    row = certificates.optimality(data[1], problem, found.weights, shares, "id").first()
    if problem.loss != HINGE:
        assert row.violation == pytest.approx(found.violation, abs=1e-9)
        assert row.scale == pytest.approx(found.scale)
    assert row.violation <= found.violation + 1e-9
    off = found.weights + 0.5
    assert certificates.optimality(data[1], problem, off, shares, "id").first().violation > 0.05 * row.scale


def test_limits_empty_folds_and_rows_without_terms(data, spark):
    short = solved(data, [PROBLEMS[0]], limit=2)[0]
    assert short.iterations == 2 and not short.converged
    df = spark.createDataFrame([(0, 1.0, Vectors.sparse(2, {}), 0)], ["id", "label", "features", "fold"])
    with pytest.raises(ValueError, match="Fold 0"):
        solver.solve(written(solver.entry_rows(df), "rows")[0], [Problem(LOGISTIC, 1.0, left_out=0)], [5], [1e-3], 2, search.class_sizes(df))
    (one,) = solver.solve(written(solver.entry_rows(df), "rows")[0], [Problem(LOGISTIC, 1.0)], [5], [1e-3], 2, search.class_sizes(df))
    assert not one.weights[:-1].any() and one.weights[-1] > 0


def test_only_parts_with_rows_count(data, spark, monkeypatch):
    """A file of one row group is cut into splits of which one has the rows: its cores must not stay idle."""
    kept, _, _, sizes = data
    context = spark.sparkContext
    split = context.parallelize(kept, 1).union(context.parallelize([], 7))
    rows = solver.entry_rows(spark.createDataFrame(split, ["id", "label", "features", "fold"]))
    assert rows.rdd.getNumPartitions() == 8
    seen, evaluate = [], solver.evaluate
    monkeypatch.setattr(solver, "evaluate", lambda rows, parts, *rest: seen.append(parts) or evaluate(rows, parts, *rest))
    found = solver.solve(rows, PROBLEMS[:2], [3, 3], [1e-4, 1e-4], TERMS, sizes)
    assert set(seen) == {1}
    for a, b in zip(found, solved(data, PROBLEMS[:2], limit=3), strict=True):
        assert a.weights == pytest.approx(b.weights)


def test_rows_are_written_in_as_many_parts_as_there_is_work_for():
    assert solver.row_parts(100, 8, 4, 1000) == 8
    assert solver.row_parts(100, 8, 63, 50_000) == 5 and solver.row_parts(100, 8, 10_000, 50_000) == 1
    assert solver.row_parts(10 * solver.ROWS_PER_FIT_TASK + 1, 8, 63, 50_000) == 11


@pytest.mark.parametrize("products", [1, 7, 1 << 17])
def test_products_of_many_columns_in_runs(products, monkeypatch):
    monkeypatch.setattr(solver, "PRODUCTS", products)
    rng = np.random.default_rng(1)
    to, source = np.sort(rng.integers(0, 9, 50)), rng.integers(0, 6, 50).astype(np.int32)
    values, matrix = rng.normal(size=50), rng.normal(size=(6, 3))
    want = np.zeros((10, 3))
    np.add.at(want, to, values[:, None] * matrix[source])
    assert solver._product(to, source, values, matrix, 10) == pytest.approx(want)
    none = np.empty(0, int)
    assert not solver._product(none, none, np.empty(0), matrix, 2).any()


def _passes(problem, rows, label, near=None, limit=200):
    """A search on rows in memory: its weights and the points at which it asked for loss and slope."""
    n, terms = rows.shape
    share = np.full(n, 1.0 / n)
    full = np.column_stack([rows, np.ones(n)])
    penalised = np.append(np.ones(terms), float(problem.heavy_intercept))
    bend = solver.BEND[problem.loss] * share @ full**2
    search_ = solver._Search(problem, limit, 1e-3, np.zeros(terms + 1), penalised, bend, trial=np.zeros(terms + 1), near=near)
    asked = 0
    while not search_.done:
        asked += 1
        loss, slope = solver.loss_and_slope(problem.loss, label * (full @ search_.trial))
        search_.take(float(share @ loss), full.T @ (share * slope * label))
    return search_, asked


@pytest.mark.parametrize("loss", [LOGISTIC, SQUARED_HINGE, HINGE])
def test_terms_of_unlike_size_and_a_near_start_take_few_passes(loss):
    """Before, every term was stepped alike: of such rows the three losses took 123, 152 and 214 passes."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 30)) * np.logspace(0, -2, 30)
    label = np.where(rows @ rng.normal(size=30) / 3 + rng.normal(size=400) > 0, 1.0, -1.0)
    problem = Problem(loss, 1e-5, heavy_intercept=True)
    found, asked = _passes(problem, rows, label)
    assert found.violation <= 1e-3 * found.scale and asked <= 60
    again, few = _passes(problem, rows, label, near=found.x)
    assert few == 2 and again.scale == found.scale and (again.x == found.x).all()
    # A start that is worse than zero is left again.
    bad, _ = _passes(problem, rows, label, near=np.full(31, 1e3))
    assert bad.violation <= 1e-3 * bad.scale and not bad.steps
