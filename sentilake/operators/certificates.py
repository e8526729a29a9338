"""Is a fitted linear model the minimum of its objective? Subgradients as aggregates over (row, term, weight).

At a minimum zero lies in every coordinate's subgradient. What the solver says of itself is not used: slopes are taken anew from the
rows, joined with the weights and summed per term by Spark.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.operators.solver import HINGE, KINK, LOGISTIC, Problem
from sentilake.operators.validation import class_scores, gathered_weights, vector_terms
from sentilake.session import cut_lineage


def slope_bounds(problem: Problem, margin: Column, kink: float = KINK) -> tuple[Column, Column]:
    """The least and the greatest slope of a loss at a margin; they differ only near the hinge's kink."""
    if problem.loss == LOGISTIC:
        slope = -1.0 / (1.0 + F.exp(margin))
        return slope, slope
    if problem.loss == HINGE:
        low = F.when(margin > 1.0 + kink, F.lit(0.0)).otherwise(F.lit(-1.0))
        high = F.when(margin < 1.0 - kink, F.lit(-1.0)).otherwise(F.lit(0.0))
        return low, high
    slope = -2.0 * F.greatest(F.lit(0.0), 1.0 - margin)
    return slope, slope


def term_slopes(rows: DataFrame, problem: Problem, weights: np.ndarray, shares: dict[int, float], key: str) -> DataFrame:
    """(idx, low, high): bounds of the mean loss's slope in each weight; idx -1 is the intercept.

    ``rows`` is (key, label, features, fold).
    """
    grid = gathered_weights(rows.sparkSession, {0: [(weights[None, :-1], [weights[-1]])]})
    scored = class_scores(rows.withColumn("fold", F.lit(0)), grid, key, "label")
    side = F.when(F.col("label") == problem.positive, F.lit(1.0)).otherwise(F.lit(-1.0))
    share = F.coalesce(*[F.when(F.col("label") == c, F.lit(w)) for c, w in shares.items()], F.lit(0.0))
    ends = [side * share * bound for bound in slope_bounds(problem, side * F.get("scores", F.lit(0)))]
    slopes = scored.select(key, F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    entries = vector_terms(rows, key).unionByName(rows.select(key, F.lit(-1).alias("idx"), F.lit(1.0).alias("value")))
    both = [F.col("value") * F.col(bound) for bound in ("low", "high")]
    return (
        entries.join(slopes, key)
        .groupBy("idx")
        .agg(F.sum(F.least(*both)).alias("low"), F.sum(F.greatest(*both)).alias("high"))
    )


def optimality(
    rows: DataFrame, problem: Problem, weights: np.ndarray, shares: dict[int, float], key: str | None = None
) -> DataFrame:
    """One row (violation, scale): the largest distance of zero from a coordinate's subgradient, here and at the zero model.

    ``rows`` is (key, label, features, fold), ``weights`` end with the intercept, ``shares`` are the classes' row weights. Two joins
    and two aggregations for each of both models, whatever the solver did.
    """
    key = key or rows.columns[0]
    held = rows.select(key, "label", "features", "fold")
    if problem.left_out is not None:
        held = held.filter(F.col("fold") != problem.left_out)
    held = cut_lineage(held)
    spark, terms = held.sparkSession, len(weights) - 1
    every = spark.range(-1, terms).select(F.col("id").cast("int").alias("idx"))
    fitted = gathered_weights(spark, {0: [(weights[None, :-1], [0.0])]}).table.select("idx", F.get("w", F.lit(0)).alias("w"))
    every = every.join(fitted, "idx", "left").fillna({"w": 0.0 if not problem.heavy_intercept else float(weights[-1])})
    free = F.col("idx") < 0
    ridge = F.lit(problem.l2) if problem.heavy_intercept else F.when(free, F.lit(0.0)).otherwise(F.lit(problem.l2))
    lasso = F.when(free, F.lit(0.0)).otherwise(F.lit(problem.l1))

    def violation(at: np.ndarray, w: Column) -> DataFrame:
        found = every.join(term_slopes(held, problem, at, shares, key), "idx", "left").fillna(0.0, ["low", "high"])
        sign = F.when(w > 0, lasso).when(w < 0, -lasso)
        low = F.col("low") + ridge * w + F.coalesce(sign, -lasso)
        high = F.col("high") + ridge * w + F.coalesce(sign, lasso)
        return found.agg(F.coalesce(F.max(F.greatest(F.lit(0.0), low, -high)), F.lit(0.0)).alias("far"))

    none = F.lit(None).cast("double")
    here = violation(weights, F.col("w")).select(F.col("far").alias("violation"), none.alias("scale"))
    start = violation(np.zeros_like(weights), F.lit(0.0)).select(none.alias("violation"), F.col("far").alias("scale"))
    return here.unionByName(start).agg(F.max("violation").alias("violation"), F.max("scale").alias("scale"))


def bayes_violation(weights: DataFrame, classes: int) -> float:
    """Naive Bayes is fitted in closed form: the term shares of each class sum to one. The largest distance from that."""
    sums = weights.agg(*[F.sum(F.exp(F.get("w", F.lit(c)))).alias(f"s{c}") for c in range(classes)]).first()
    return max((abs((s or 0.0) - 1.0) for s in sums), default=math.nan)
