"""Stratified split and folds by rank of a seeded hash, without sorting a class in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentilake.operators.checks import require_columns

# Four hex digits: 65,536 histogram cells per class.
CELL_DIGITS = 4
# Cuts per class: one for a split, folds - 1 for folds.
MAX_CUTS = 100


def seeded_hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))


def rank_cuts(
    df: DataFrame,
    group: str,
    key: str,
    positions: Callable[[Column], Column],
    max_groups: int = 1000,
) -> DataFrame:
    """Per group the key values found at the wanted 1-based ranks, as (group, cuts array).

    ``positions`` maps the group size to an array of ranks. A histogram over key prefixes is
    combined before the shuffle and locates the one cell that holds each rank; only the rows
    of those cells are then ranked. No task ever sees a whole class.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"))
    rows = rows.withColumn("cell", F.substring("k", 1, CELL_DIGITS))
    by_cell = Window.partitionBy("g").orderBy("cell")
    cells = rows.groupBy("g", "cell").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(by_cell))
    wanted = (
        cells.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
        .select("g", "cell", "n", "upto", F.posexplode(positions(F.col("total"))).alias("cut_no", "rank"))
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("g", "cell", "cut_no", (F.col("rank") - F.col("upto") + F.col("n")).alias("offset"))
    )
    # A few rows per class; with their number checked they can be broadcast, so the second
    # pass drops all other cells before anything is shuffled.
    found = wanted.limit(max_groups * MAX_CUTS + 1).collect()
    if len({r.g for r in found}) > max_groups or len(found) > max_groups * MAX_CUTS:
        raise ValueError(f"Column '{group}' holds more than {max_groups} classes.")
    cut_cells = df.sparkSession.createDataFrame(found, wanted.schema)
    in_cell = Window.partitionBy("g", "cell", "cut_no").orderBy("k")
    cuts = (
        rows.join(F.broadcast(cut_cells), ["g", "cell"])
        .withColumn("rn", F.row_number().over(in_cell))
        .filter(F.col("rn") == F.col("offset"))
        .groupBy("g")
        .agg(F.array_sort(F.collect_list("k")).alias("cuts"))
        .collect()
    )
    schema = f"{group} {df.schema[group].dataType.simpleString()}, cuts array<string>"
    return df.sparkSession.createDataFrame([(r.g, r.cuts) for r in cuts], schema)


def assign_split(
    df: DataFrame,
    id_column: str,
    label_column: str,
    test_size: float = 0.2,
    seed: int = 42,
    stratify: bool = True,
    output: str = "split",
) -> DataFrame:
    """Adds ``split`` = 'test' for the first ``test_size`` share of each class in hash order.

    Rows are classified in place against a handful of broadcast cut values; the wide table
    is not shuffled.
    """
    require_columns(df, [id_column, label_column])
    share = F.lit(float(test_size))
    keyed, group = _keyed(df, id_column, label_column, seed, stratify)
    cuts = rank_cuts(keyed, group, "_key", lambda n: F.array(F.floor(n * share + 0.5)))
    is_test = F.exists(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: F.col("_key") <= c)
    return _classified(keyed, cuts, group, F.when(is_test, "test").otherwise("train").alias(output), output)


def assign_folds(
    df: DataFrame,
    id_column: str,
    label_column: str,
    folds: int = 3,
    seed: int = 42,
    output: str = "fold",
) -> DataFrame:
    """Adds an integer fold; every class is cut into ``folds`` near-equal runs in hash order."""
    require_columns(df, [id_column, label_column])
    if not 2 <= folds <= MAX_CUTS:
        raise ValueError(f"folds must lie within 2..{MAX_CUTS}")

    def borders(n: Column) -> Column:
        quotient, rest = F.floor(n / folds), n % folds
        return F.array(*[f * quotient + F.least(F.lit(f), rest) for f in range(1, folds)])

    keyed, group = _keyed(df, id_column, label_column, seed, True)
    cuts = rank_cuts(keyed, group, "_key", borders)
    passed = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<string>")), lambda c: F.col("_key") > c))
    return _classified(keyed, cuts, group, passed.cast("int").alias(output), output)


def _keyed(df: DataFrame, id_column: str, label_column: str, seed: int, stratify: bool) -> tuple[DataFrame, str]:
    group = F.coalesce(F.col(label_column).cast("string"), F.lit("")) if stratify else F.lit("")
    return df.withColumn("_key", seeded_hash(id_column, seed)).withColumn("_group", group), "_group"


def _classified(keyed: DataFrame, cuts: DataFrame, group: str, column: Column, output: str) -> DataFrame:
    kept = [c for c in keyed.columns if c not in ("_key", "_group", output)]
    # One row per class, at most max_groups of them: a proven bound.
    return keyed.join(F.broadcast(cuts), group, "left").select(*kept, column)
