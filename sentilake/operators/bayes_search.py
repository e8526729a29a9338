"""Naive Bayes for all folds and smoothing values from one table of sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.operators.validation import GridWeights, vector_terms
from sentilake.session import cut_lineage


@dataclass(frozen=True)
class FoldSums:
    """Sufficient statistics of naive Bayes: TF-IDF sums per term, fold and class.

    ``table`` is (idx, sums), one row per vocabulary term, the sums fold by fold and class by class within a fold.
    ``rows`` holds the number of rows and ``totals`` the sum over all terms, in the same order.
    """

    table: DataFrame
    terms: int
    folds: int
    classes: int
    rows: tuple[int, ...]
    totals: tuple[float, ...]

    def _cells(self, left_out: int | None, c: int) -> list[int]:
        return [f * self.classes + c for f in range(self.folds) if f != left_out]

    def priors(self, left_out: int | None = None) -> tuple[float, ...]:
        """Log shares of the classes in all folds but one; a class without rows cannot be predicted."""
        counts = [sum(self.rows[n] for n in self._cells(left_out, c)) for c in range(self.classes)]
        if not sum(counts):
            raise ValueError(f"Fold {left_out} leaves no rows to train on.")
        return tuple(math.log(k / sum(counts)) if k else -math.inf for k in counts)

    def log_weights(self, alpha: float, left_out: int | None = None) -> list[Column]:
        """Per class the smoothed log share of a term. The other folds are added up, so nothing cancels."""
        out = []
        for c in range(self.classes):
            cells = self._cells(left_out, c)
            mine = sum((F.get("sums", F.lit(n)) for n in cells), start=F.lit(0.0))
            total = sum(self.totals[n] for n in cells) + alpha * self.terms
            out.append(F.log((mine + F.lit(float(alpha))) / F.lit(total)))
        return out


def fold_sums(vectors: DataFrame, folds: int, classes: int) -> FoldSums:
    """One aggregation over (label, fold, features); sums are combined before the shuffle, so no class or fold is a hot spot."""
    cells = [(f, c) for f in range(folds) for c in range(classes)]
    counted = {(r["fold"], int(r["label"])): r["n"] for r in vectors.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = vectors.select(F.unwrap_udt("features").alias("v")).select(F.coalesce("v.size", F.size("v.values")).alias("n")).first()
    terms = first["n"] if first else 0
    picked = [
        F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("label") == c), F.col("value"))), F.lit(0.0)) for f, c in cells
    ]
    sums = vector_terms(vectors, "label", "fold").groupBy("idx").agg(F.array(*picked).alias("sums"))
    # Terms that no row shows are part of the vocabulary too.
    every = vectors.sparkSession.range(terms).select(F.col("id").cast("int").alias("idx"))
    nothing = F.array(*[F.lit(0.0)] * len(cells))
    table = cut_lineage(every.join(sums, "idx", "left").select("idx", F.coalesce("sums", nothing).alias("sums")))
    totals = table.agg(*[F.sum(F.get("sums", F.lit(n))).alias(f"t{n}") for n in range(len(cells))]).first()
    return FoldSums(
        table, terms, folds, classes, tuple(counted.get(cell, 0) for cell in cells), tuple(t or 0.0 for t in totals)
    )


def held_out_models(sums: FoldSums, alphas: Sequence[float]) -> GridWeights:
    """Per fold the models of all smoothing values, fitted on the other folds. Columns of one table, no further pass."""
    per_fold = [
        F.struct(
            F.lit(fold).alias("fold"),
            F.array(*[w for alpha in alphas for w in sums.log_weights(alpha, fold)]).alias("w"),
        )
        for fold in range(sums.folds)
    ]
    table = sums.table.select("idx", F.inline(F.array(*per_fold))).select("fold", "idx", "w")
    intercepts = {fold: sums.priors(fold) * len(alphas) for fold in range(sums.folds)}
    return GridWeights(table, intercepts, len(alphas), sums.classes, sums.terms)


def whole_model(sums: FoldSums, alpha: float) -> tuple[DataFrame, tuple[float, ...]]:
    """The model of all rows: (idx, w) and the class intercepts."""
    return sums.table.select("idx", F.array(*sums.log_weights(alpha)).alias("w")), sums.priors()
