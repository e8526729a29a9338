"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm.common import fresh, own_columns, small_side, stored, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BINS = 4096
SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``rows``: one row per document; ``targets``: one row per source; ``budget``: units to take in all."""

    rows: DataFrame
    targets: DataFrame
    budget: float


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Targets of the sources: ``share`` of all units dealt out by weight, none above ``repeats`` times its size.

    What a capped source cannot use goes to the others by weight, until none is above: sources are sorted by
    cap over weight, and the first prefix of capped sources is taken whose rest fits under its caps.
    Sources are few, so the windows run over one small table. ``totals``: source, source_size.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy()
    weighted = (
        totals.withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("position") % len(weights)))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    order = Window.orderBy("ratio", "position")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levels = weighted.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "position", "level"))).over(every)
    return levels.withColumn("chosen", chosen["level"]).select(
        "source",
        "source_size",
        F.when(F.col("chosen").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("chosen") * F.col("weight")))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    size: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = "mix",
) -> Mix:
    """Take each document zero to ``repeats`` times so that every source comes near its target.

    A source's documents are shuffled by hash. Pass p of a document ends at the virtual time
    ``(p * source_size + units of the source up to and with it) / target``. All passes are merged by virtual time
    and cut where the units taken reach the budget, the sum of all targets. Both running sums are split:
    cells of the shuffle hash give a source's sum (a hot source is many cells), bins of virtual time the global
    one; only the bin that holds the cut is ranked row by row.

    Rows: id, source, size, source_size, target, taken. A null text has size 0; a null source is a source, last in order;
    documents of size 0 are taken 0 units. Equal ids are ordered by size, so reruns agree. An empty table gives an
    empty result.
    """
    size = word_count(F.col("text")) if size is None else size
    sizes = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            size.alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")))).alias("turn"),
        ),
        "mix-sizes",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, share, repeats), "mix-targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0

    cell = F.substring("turn", 1, 3)
    cells = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("units"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("source", "cell", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("source", "cell").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size")
    run = run.rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("cell", cell).withColumn("so_far", F.sum("size").over(run)).alias("p")
    placed = (
        placed.join(bases.alias("b"), F.expr("p.source <=> b.source AND p.cell = b.cell"))
        .select("p.*", (F.col("so_far") + F.col("base")).alias("reached"))
        .alias("p")
    )
    known = small_side(targets, SOURCES).alias("t")
    timed = stored(
        placed.join(known, F.expr("p.source <=> t.source")).select(
            "p.doc_id", "p.source", "p.size", "p.turn", "p.reached", "t.source_size", "t.target"
        ),
        "mix-times",
    )

    def finish(p: Column | int) -> Column:
        reached = F.col("reached") + F.col("source_size") * (F.lit(p) if isinstance(p, int) else p)
        return F.when(F.col("target") > 0, reached / F.col("target"))

    def bin_of(time: Column) -> Column:
        return F.floor(F.least(time, F.lit(2.0)) * BINS)

    passes = timed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("time", finish(F.col("round"))).filter("time IS NOT NULL")
    summed = passes.groupBy(bin_of(F.col("time")).alias("bin")).agg(F.sum("size").alias("units"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        summed.withColumn("end", F.sum("units").over(upto)).filter(F.col("end") > budget).orderBy("bin").first()
    )
    if crossing is None:
        taken = F.when(F.col("target") > 0, F.col("size") * repeats).otherwise(F.lit(0))
    else:
        start = crossing["end"] - crossing["units"]
        keys = ("time", "turn", "doc_id", "round", "size")
        rank = Window.orderBy("time", "turn", F.col("doc_id").asc_nulls_first(), "round", "size")
        last = (
            passes.filter(bin_of(F.col("time")) == crossing["bin"])
            .withColumn("end", F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0)) + start)
            .filter(F.col("end") <= budget)
            .orderBy(F.desc("time"), F.desc("turn"), F.col("doc_id").desc_nulls_last(), F.desc("round"), F.desc("size"))
            .select(*keys)
            .first()
        )
        taken = F.lit(0).cast("long")
        for p in range(repeats):
            time = finish(p)
            within = bin_of(time) < crossing["bin"]
            if last is not None:
                mine = F.struct(time, F.col("turn"), F.col("doc_id"), F.lit(p), F.col("size"))
                edge = F.struct(
                    F.lit(last["time"]),
                    F.lit(last["turn"]),
                    F.lit(last["doc_id"]).cast(timed.schema["doc_id"].dataType),
                    F.lit(last["round"]),
                    F.lit(last["size"]).cast("long"),
                )
                within = within | ((bin_of(time) == crossing["bin"]) & (mine <= edge))
            taken = taken + F.when(within, F.col("size")).otherwise(F.lit(0))
    rows = timed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    return Mix(rows, targets, budget)


def apply_mix(docs: DataFrame, mix: Mix, id_column: str = "doc_id", source_column: str = "source", size=None) -> DataFrame:
    """The mixed table: each document as often as the mix takes it, columns unchanged.

    Documents of size 0 carry nothing to mix and go. Rows that share id, source and size share one decision.
    """
    size = word_count(F.col("text")) if size is None else size
    times = mix.rows.filter("taken > 0").groupBy("doc_id", "source", "size").agg((F.max("taken") / F.col("size")).alias("times"))
    times = times.select("doc_id", "source", "size", F.col("times").cast("int").alias("_times")).alias("m")
    counted = fresh(docs, "_size")
    kept = docs.withColumn(counted, size).alias("d")
    match = f"d.`{id_column}` <=> m.doc_id AND d.`{source_column}` <=> m.source AND d.`{counted}` = m.size"
    turns = F.explode(F.sequence(F.lit(1), F.col("m._times"))).alias(fresh(docs, "_turn"))
    return kept.join(times, F.expr(match)).select(*[F.col(f"d.`{c}`") for c in docs.columns], turns).select(own_columns(docs))
