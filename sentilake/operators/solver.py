"""Linear classifiers of many settings and folds at once: each iteration of all of them reads the rows once."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The tasks' functions travel by value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOGISTIC = "logistic"
HINGE = "hinge"
SQUARED_HINGE = "squared_hinge"

#: The hinge's kink is rounded off over this width of the margin.
KINK = 0.05
#: About how steeply each loss bends. The hinge does so at its kink only, so one stands for it at large.
BEND = {LOGISTIC: 0.25, SQUARED_HINGE: 2.0, HINGE: 1.0}
#: Gradients of all parts that are summed on the driver, in bytes; beyond it Spark sums them by blocks of terms.
DRIVER_BYTES = 128 << 20
BLOCK = 8192
ROWS_PER_FIT_TASK = 20_000
#: Rows that are read by tasks which share the fits, rather than cut further.
FEW_ROWS = 10_000
#: Fits of a task that are worked out one after the other.
ONE_BY_ONE = 8
#: Products that a task makes in one go, and bytes of the gradients that it holds.
PRODUCTS, MATRIX_BYTES = 1 << 17, 64 << 20
#: Pairs of steps and gradient changes that stand for the curvature of each fit. They are held in single precision.
MEMORY = 24


@dataclass(frozen=True)
class Problem:
    """One fit: mean of c_i loss(y_i (w x_i + b)) over the rows of the other folds + l2 / 2 |w|^2 + l1 |w|_1.

    Rows of class ``positive`` have y = 1, all others -1. ``balanced`` weighs both sides alike for
    two classes, all classes alike otherwise. ``heavy_intercept``: b is penalised as a weight. ``near``: a point that the solution
    is thought to be near to; it is tried after zero, of which the tolerance is a share.
    """

    loss: str
    l2: float
    l1: float = 0.0
    left_out: int | None = None
    balanced: bool = False
    heavy_intercept: bool = False
    positive: int = 1
    near: np.ndarray | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Solution:
    """Weights (the last is the intercept), and how the solver ended.

    ``violation`` is the largest distance of zero from a coordinate's subgradient, ``scale`` the same at the start.
    """

    weights: np.ndarray
    violation: float
    scale: float
    iterations: int
    converged: bool


def loss_and_slope(kind: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative at y (w x + b)."""
    if kind == LOGISTIC:
        return np.logaddexp(0.0, -margin), -0.5 * (1.0 - np.tanh(0.5 * margin))
    gap = np.maximum(0.0, 1.0 - margin)
    if kind == SQUARED_HINGE:
        return gap * gap, -2.0 * gap
    return np.where(gap < KINK, gap * gap / (2 * KINK), gap - KINK / 2), -np.minimum(gap / KINK, 1.0)


@dataclass(frozen=True)
class _Rows:
    """Rows of one fold: label, entries of each row, and the entries one after the other."""

    fold: int
    label: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.sizes)), self.sizes), self.terms, self.values

    def by_term(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Short numbers are sorted in linear time.
        order = np.argsort(self.terms.astype(np.uint16) if length <= 1 << 16 else self.terms, kind="stable")
        return self.terms[order], self.by_row()[0][order], self.values[order]

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        held = np.flatnonzero(self.sizes)
        if len(held):
            products = w[self.terms]
            products *= self.values
            out[held] = np.add.reduceat(products, (np.cumsum(self.sizes) - self.sizes)[held])
        return out

    def gradient(self, slope: np.ndarray, length: int) -> np.ndarray:
        weighted = np.repeat(slope, self.sizes)
        weighted *= self.values
        return np.bincount(self.terms, weights=weighted, minlength=length)


def _part(batches: Iterator[pa.RecordBatch]) -> list[_Rows]:
    """The rows of a task, fold by fold."""
    table = pa.Table.from_batches(list(batches))
    if (np.diff(table["fold"].to_numpy()) < 0).any():
        table = table.take(np.argsort(table["fold"].to_numpy(), kind="stable"))
    terms, values = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("idx", np.int32), ("value", float)))
    sizes = pc.binary_length(table["idx"]).to_numpy() // 4
    label, fold, terms = table["label"].to_numpy().astype(int), table["fold"].to_numpy(), terms.astype(np.intp)
    starts = np.append(0, np.cumsum(sizes))
    out = []
    for f in np.unique(fold):
        first, end = np.searchsorted(fold, f), np.searchsorted(fold, f, "right")
        held = slice(starts[first], starts[end])
        out.append(_Rows(int(f), label[first:end], sizes[first:end], terms[held], values[held]))
    return out


def _product(to: np.ndarray, source: np.ndarray, values: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values * matrix[source]`` by place, for all columns at once; ``to``, the places, must ascend."""
    out = np.zeros((size, matrix.shape[1]))
    step = max(1, PRODUCTS // matrix.shape[1])
    for start in range(0, len(to), step):
        some = slice(start, start + step)
        terms = matrix.take(source[some], axis=0)
        terms *= values[some, None]
        place = to[some]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        # A place stands once among these sums, so nothing is lost where it goes on in the next run of entries.
        out[place[first]] += np.add.reduceat(terms, first, axis=0)
    return out


def _gradient_batches(
    state: Broadcast[tuple[list[tuple[str, int, int | None]], list[dict[int, float]], np.ndarray]], blocks: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        mine, groups = rows[0].column("mine")[0].as_py(), rows[0].column("groups")[0].as_py()
        pieces = _part(iter(rows))
        problems, shares, weights = state.value
        length = weights.shape[1]
        own = list(range(mine, len(problems), groups))
        # Few fits are quicker one by one than all entries are sorted by term.
        orders = [(piece.by_row(), piece.by_term(length)) if len(own) > ONE_BY_ONE else None for piece in pieces]
        together = max(1, MATRIX_BYTES // (8 * length))
        size = BLOCK if blocks else length
        for at in range(0, len(own), together):
            part = own[at : at + together]
            losses = np.zeros(len(part))
            gradients = np.zeros((len(part), length))
            for piece, order in zip(pieces, orders, strict=True):
                # A fit that leaves these rows out has no part in their products.
                open_ = [k for k, n in enumerate(part) if problems[n][2] != piece.fold]
                if not open_:
                    continue
                w = weights[[part[k] for k in open_]]
                slopes = _product(*order[0], np.ascontiguousarray(w.T), len(piece.label)) if order else np.stack([piece.margins(x) for x in w], axis=1)
                slopes += w[:, -1]
                for column, k in enumerate(open_):
                    kind, positive, _ = problems[part[k]]
                    side = np.where(piece.label == positive, 1.0, -1.0)
                    share = np.zeros(len(piece.label))
                    for c, value in shares[part[k]].items():
                        share[piece.label == c] = value
                    loss, slope = loss_and_slope(kind, side * slopes[:, column])
                    losses[k] += float((loss * share).sum())
                    slopes[:, column] = slope * side * share
                if order:
                    gradients[open_] += _product(*order[1], slopes, length).T
                else:
                    for column, k in enumerate(open_):
                        gradients[k] += piece.gradient(slopes[:, column], length)
                gradients[open_, -1] += slopes.sum(axis=0)
            for k, n in enumerate(part):
                yield _in_blocks(n, float(losses[k]), gradients[k], size)

    return run


#: A run of a gradient travels as its bytes.
_SCHEMA = "problem int, block int, loss double, slope binary"


def _encoded(found: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(found[c], k) for c, k in zip(found, kinds, strict=True)], list(found))


def _in_blocks(n: int, loss: float, slope: np.ndarray, size: int) -> pa.RecordBatch:
    starts = range(0, len(slope), size)
    runs = [slope[start : start + size].tobytes() for start in starts]
    found = {"problem": [n] * len(runs), "block": [start // size for start in starts], "loss": [loss, *[0.0] * (len(runs) - 1)]}
    return _encoded(found | {"slope": runs})


def _sum_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_buffer()) for x in rows["slope"]], axis=0)
    found = {"problem": [key[0].as_py()], "block": [key[1].as_py()], "loss": [pc.sum(rows["loss"]).as_py()], "slope": [total.tobytes()]}
    return pa.Table.from_batches([_encoded(found)])


def evaluate(
    rows: DataFrame, parts: int, problems: list[Problem], shares: list[dict[int, float]], weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss and its gradient for every problem, in one pass over (label, fold, idx, value).

    Where the rows have fewer parts than there are cores, each part is read by several tasks, which share the problems.
    """
    context = rows.sparkSession.sparkContext
    groups = max(1, min(len(problems), context.defaultParallelism // max(parts, 1)))
    copies = [rows.withColumns({"mine": F.lit(g), "groups": F.lit(groups)}) for g in range(groups)]
    dealt = reduce(DataFrame.unionByName, copies)
    state = context.broadcast(([(p.loss, p.positive, p.left_out) for p in problems], shares, weights))
    small = parts * weights.nbytes <= DRIVER_BYTES
    found = _summed(dealt.mapInArrow(_gradient_batches(state, not small), _SCHEMA), small, *weights.shape)
    state.destroy()
    return found


def _summed(sums: DataFrame, small: bool, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What the parts found for ``n`` problems, added up: on the driver, or before by blocks in Spark."""
    if not small:
        sums = sums.groupBy("problem", "block").applyInArrow(_sum_blocks, _SCHEMA)
    loss, slope = np.zeros(n), np.zeros((n, length))
    size = length if small else BLOCK
    found = sums.toArrow()
    runs = [np.frombuffer(x.as_buffer()) for x in found["slope"]]
    problems, blocks, losses = (found[c].to_numpy() for c in ("problem", "block", "loss"))
    # The order of the parts must not change the sum.
    for row in np.lexsort((losses, blocks, problems)):
        of, start = problems[row], blocks[row] * size
        loss[of] += losses[row]
        slope[of, start : start + size] += runs[row]
    return loss, slope


def class_squares(rows: DataFrame, parts: int, classes: int, terms: int) -> np.ndarray:
    """For each class the sums of its rows' squared values by term; the last is the number of its rows."""
    small = parts * classes * 8 * (terms + 1) <= DRIVER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        pieces = _part(iter(found))
        for c in range(classes):
            total = np.zeros(terms + 1)
            for piece in pieces:
                of = np.repeat(piece.label == c, piece.sizes)
                total += np.bincount(piece.terms[of], weights=piece.values[of] ** 2, minlength=terms + 1)
                total[-1] += (piece.label == c).sum()
            yield _in_blocks(c, float(c), total, terms + 1 if small else BLOCK)

    return _summed(rows.mapInArrow(run, _SCHEMA), small, classes, terms + 1)[1]


@dataclass
class _Search:
    """Limited-memory quasi-Newton descent on one problem, orthant by orthant where weights are made sparse.

    ``bend`` of the loss, term by term, stands for what the memory does not know yet. Any positive values lead to the same minimum.
    """

    problem: Problem
    limit: int
    tolerance: float
    x: np.ndarray
    penalised: np.ndarray
    bend: np.ndarray
    value: float = math.inf
    gradient: np.ndarray | None = None
    slope: np.ndarray | None = None
    trial: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    iterations: int = 0
    scale: float = 0.0
    violation: float = math.inf
    done: bool = False
    near: np.ndarray | None = None
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def _subgradient(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The subgradient nearest to zero."""
        l1 = self.problem.l1
        if not l1:
            return g
        at_zero = np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)
        return np.where(self.penalised > 0, np.where(x != 0, g + l1 * np.sign(x), at_zero), g)

    @property
    def curvature(self) -> np.ndarray:
        return self.bend + self.problem.l2 * self.penalised

    def take(self, loss: float, slope: np.ndarray) -> None:
        """The objective at the trial point is known: go there, or try nearer. After zero, a point that is said to be near is tried."""
        x = self.trial
        ridge = self.problem.l2 * self.penalised
        weights = self.penalised[:-1] * np.abs(x[:-1])
        value = loss + 0.5 * float(ridge @ (x * x)) + self.problem.l1 * float(weights.sum())
        if self.gradient is not None and self.near is not None:
            self.near = None
            if value >= self.value:
                self._turn()
                return
        elif self.gradient is not None:
            line = float(self.slope @ (x - self.x))
            if value > self.value + 1e-4 * line:
                # The lowest point of the parabola through what is known, within bounds.
                self.step *= min(0.5, max(0.05, -line / (2.0 * (value - self.value - line))))
                if self.step < 1e-12:
                    self._end()
                else:
                    self._try()
                return
        g = slope + ridge * x
        if self.gradient is not None:
            s, y, curvature = x - self.x, g - self.gradient, self.curvature
            if float(s @ y) > 1e-12 * float(y @ (y / curvature)):
                self.steps = [*self.steps[1 - MEMORY :], (s.astype(np.float32), y.astype(np.float32))]
            self.iterations += 1
        self.x, self.value, self.gradient = x, value, g
        self.slope = self._subgradient(x, g)
        self.violation = float(np.abs(self.slope).max())
        if self.iterations == 0:
            self.scale = self.violation
        if self.violation <= self.tolerance * self.scale or self.iterations >= self.limit:
            self._end()
            return
        if self.near is not None:
            self.trial = self.near
            return
        self._turn()

    def _end(self) -> None:
        """What goes on needs the driver's memory."""
        self.done, self.steps = True, []
        self.gradient = self.slope = self.trial = self.direction = None

    def _turn(self) -> None:
        """A new direction from where the search stands."""
        d = -self._curved(self.slope)
        if self.problem.l1:
            d[(self.penalised > 0) & (d * self.slope >= 0)] = 0.0
        if float(d @ self.slope) >= 0:
            self.steps, d = [], -self.slope / self.curvature
        self.direction = d
        self.step = 1.0
        self._try()

    def _try(self) -> None:
        self.trial = self.x + self.step * self.direction
        if self.problem.l1:
            kept = np.where(self.x != 0, np.sign(self.x), -np.sign(self.slope))
            self.trial = np.where((self.penalised > 0) & (self.trial * kept <= 0), 0.0, self.trial)

    def _curved(self, g: np.ndarray) -> np.ndarray:
        q, found = g.copy(), []
        pairs = [(s.astype(float), y.astype(float)) for s, y in self.steps]
        for s, y in reversed(pairs):
            a = float(s @ q) / float(s @ y)
            found.append(a)
            q -= a * y
        curvature = self.curvature
        q /= curvature
        if pairs:
            s, y = pairs[-1]
            q *= float(s @ y) / float(y @ (y / curvature))
        for (s, y), a in zip(pairs, reversed(found), strict=True):
            q += (a - float(y @ q) / float(s @ y)) * s
        return q


def class_shares(problem: Problem, sizes: dict[tuple[int, float], int]) -> dict[int, float]:
    """Per class the weight of one row, so that all weights of the fit sum to one."""
    counts: dict[int, int] = {}
    for (fold, label), k in sizes.items():
        if fold != problem.left_out:
            counts[int(label)] = counts.get(int(label), 0) + k
    n = sum(counts.values())
    if not n:
        raise ValueError(f"Fold {problem.left_out} leaves no rows to train on.")
    return {c: 1.0 / (len(counts) * k) if problem.balanced else 1.0 / n for c, k in counts.items()}


def _bytes(lists: pa.Array, kind: pa.DataType) -> pa.Array:
    """The values of each list as its bytes."""
    width = kind.bit_width // 8
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]) * width
    flat = lists.flatten().cast(kind).to_numpy(zero_copy_only=False)
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), buffers).cast(pa.binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        entries = [_bytes(rows.column("idx"), pa.int32()), _bytes(rows.column("value"), pa.float64())]
        yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("fold"), *entries], ["label", "fold", "idx", "value"])


def entry_rows(vectors: DataFrame) -> DataFrame:
    """(label, fold, idx, value): the entries of each row's vector, as the bytes of whole numbers and doubles.

    Every pass reads them again, and bytes are copied where an array would be read value by value.
    """
    v = F.unwrap_udt("features")
    dense = F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1))
    rows = vectors.select(
        F.col("label").cast("int").alias("label"),
        F.col("fold").cast("int").alias("fold"),
        F.when(v["type"] == 0, v["indices"]).otherwise(F.coalesce(dense, F.array().cast("array<int>"))).alias("idx"),
        v["values"].alias("value"),
    )
    return rows.mapInArrow(_packed, "label int, fold int, idx binary, value binary")


def row_parts(n: int, cores: int, problems: int, terms: int) -> int:
    """Into how many parts to write ``n`` rows: no part of too many rows, and beyond that as many as the driver can add up."""
    on_driver = DRIVER_BYTES // (8 * problems * (terms + 1))
    return max(1, math.ceil(n / ROWS_PER_FIT_TASK), min(cores, on_driver))


def solve(
    rows: DataFrame,
    problems: Sequence[Problem],
    limits: Sequence[int],
    tolerances: Sequence[float],
    terms: int,
    sizes: dict[tuple[int, float], int],
) -> list[Solution]:
    """Fit all problems on (label, fold, idx, value) rows with ``terms`` terms. Every iteration reads them: pass a written table.

    Steps are measured by how much each term bends the loss, from the squares of its values. A pass over the rows gives loss and gradient of every problem that is not done yet, each at a point of its own. The
    driver holds a few vectors of the vocabulary's length for each problem, never a row.
    """
    searches = []
    # A file of one row group is cut into many splits, of which one holds all its rows.
    parts = rows.select(F.spark_partition_id().alias("part")).distinct().count()
    squares = class_squares(rows, parts, 1 + max(int(c) for _, c in sizes), terms)
    shares = [class_shares(p, sizes) for p in problems]
    # Vectors that many fits have alike are held once.
    start = np.zeros(terms + 1)
    penalties = {heavy: np.append(np.ones(terms), float(heavy)) for heavy in (False, True)}
    bends: dict[tuple, np.ndarray] = {}
    for problem, share, limit, tolerance in zip(problems, shares, limits, tolerances, strict=True):
        alike = (problem.loss, *sorted(share.items()))
        if alike not in bends:
            bends[alike] = BEND[problem.loss] * sum(weight * squares[c] for c, weight in share.items())
            # A term that no row holds bends nothing; it stays at zero whatever stands here.
            bends[alike][bends[alike] <= 0] = 1.0
        vectors = (start, penalties[problem.heavy_intercept], bends[alike])
        searches.append(_Search(problem, limit, tolerance, *vectors, trial=start, near=problem.near))
    while open_ := [n for n, s in enumerate(searches) if not s.done]:
        at = np.stack([searches[n].trial for n in open_])
        loss, slope = evaluate(rows, parts, [problems[n] for n in open_], [shares[n] for n in open_], at)
        for k, n in enumerate(open_):
            searches[n].take(float(loss[k]), slope[k])
    return [Solution(s.x, s.violation, s.scale, s.iterations, s.violation <= s.tolerance * s.scale) for s in searches]
