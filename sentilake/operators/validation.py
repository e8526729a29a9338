"""Many linear models over one vocabulary, scored on the rows of their folds in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.operators.metrics import confusion_metrics, score_column

#: Weights up to this many bytes are broadcast; beyond it the join with the terms of the rows shuffles.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class GridWeights:
    """Linear models of all grid points and folds.

    ``table`` is (fold, idx, w): the weights of one term in one fold, point by point and class by class within a point.
    ``intercepts`` holds as many values for each fold. The rows of a fold are those that its models have not seen.
    """

    table: DataFrame
    intercepts: dict[int, tuple[float, ...]]
    points: int
    classes: int
    terms: int

    def lookup(self) -> DataFrame:
        size = self.terms * len(self.intercepts) * (self.points * self.classes + 2) * 8
        return F.broadcast(self.table) if size <= BROADCAST_BYTES else self.table


def gathered_weights(
    spark: SparkSession, models: dict[int, Sequence[tuple[np.ndarray, Sequence[float]]]]
) -> GridWeights:
    """From fitted models: per fold one (class x term matrix, class intercepts) for each point.

    As large as the vocabulary times points and folds, all capped by the settings.
    """
    parts, intercepts = [], {}
    for fold, found in models.items():
        w = np.concatenate([m for m, _ in found]).T.astype(float)
        intercepts[fold] = tuple(float(b) for _, bs in found for b in bs)
        width = w.shape[1]
        lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, width, dtype=np.int32), pa.array(w.ravel()))
        parts.append(
            pa.table(
                [np.full(len(w), fold, np.int32), np.arange(len(w), dtype=np.int32), lists], names=["fold", "idx", "w"]
            )
        )
    first = next(iter(models.values()))
    table = spark.createDataFrame(pa.concat_tables(parts))
    return GridWeights(table, intercepts, len(first), first[0][0].shape[0], first[0][0].shape[1])


def vector_terms(vectors: DataFrame, *keep: str) -> DataFrame:
    """(*keep, idx, value): the entries of a vector column, dense or sparse, zeros left out."""
    v = F.unwrap_udt("features")
    dense = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    where = F.when(v["type"] == 0, v["indices"]).when(F.size(v["values"]) > 0, dense).otherwise(F.array().cast("array<int>"))
    entries = F.arrays_zip(where.alias("idx"), v["values"].alias("value"))
    return vectors.select(*keep, F.inline(entries)).toDF(*keep, "idx", "value").filter("value <> 0")


def class_scores(rows: DataFrame, grid: GridWeights, key: str, *keep: str) -> DataFrame:
    """(key, *keep, fold, scores): for each row the class scores of all points of its fold's models.

    ``rows`` is (key, *keep, fold, features). One join with the weights and one shuffle of sums, whatever the number of points;
    a row without a known term has the intercepts for scores.
    """
    width = grid.points * grid.classes
    summed = (
        vector_terms(rows, key, "fold")
        .join(grid.lookup(), ["fold", "idx"])
        .groupBy(key)
        .agg(*[F.sum(F.col("value") * F.get("w", F.lit(n))).alias(f"s{n}") for n in range(width)])
    )
    base = {fold: F.array(*[F.lit(b) for b in bs]) for fold, bs in grid.intercepts.items()}
    intercepts = F.coalesce(*[F.when(F.col("fold") == fold, b) for fold, b in base.items()])
    scores = F.array(*[F.coalesce(F.col(f"s{n}"), F.lit(0.0)) + F.get("base", F.lit(n)) for n in range(width)])
    return (
        rows.select(key, *keep, "fold", intercepts.alias("base")).join(summed, key, "left")
        .select(key, *keep, "fold", scores.alias("scores"))
    )


def predicted_class(scores: Column, point: int, classes: int) -> Column:
    """The first class of highest score of a grid point."""
    mine = F.slice(scores, point * classes + 1, classes)
    return (F.array_position(mine, F.array_max(mine)) - 1).cast("int")


def confusions(rows: DataFrame, grid: GridWeights, key: str) -> DataFrame:
    """(fold, point, label, predicted, n): the confusion tables of all folds and points at once."""
    said = F.array(
        *[
            F.struct(F.lit(p).alias("point"), predicted_class(F.col("scores"), p, grid.classes).alias("predicted"))
            for p in range(grid.points)
        ]
    )
    seen = class_scores(rows, grid, key, "label").select("fold", F.col("label").cast("int").alias("label"), F.inline(said))
    return seen.groupBy("fold", "point", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def fold_scores(rows: DataFrame, grid: GridWeights, key: str, metric: str) -> list[list[float]]:
    """The metric of every point in every fold, points first: at most points x folds rows come back."""
    wanted = score_column(metric)
    table = confusion_metrics(confusions(rows, grid, key), "label", "predicted", "fold", "point").collect()
    found = {(r["point"], r["fold"]): r[wanted] for r in table}
    return [[found.get((p, fold), math.nan) for fold in sorted(grid.intercepts)] for p in range(grid.points)]


def best_point(scores: Sequence[Sequence[float]]) -> tuple[int, list[float]]:
    """The point of highest mean over the folds, the first of equal ones, and all means."""
    means = [sum(s) / len(s) for s in scores]
    return max(range(len(means)), key=lambda p: (means[p], -p)), means


