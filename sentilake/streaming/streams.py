"""Structured Streaming forms of cleaning, deduplication, scoring and progress counts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sentilake.config import CleanConfig
from sentilake.functions.lexicon import Lexicon
from sentilake.operators.cleaning import clean_reviews
from sentilake.operators.models import LinearTextModel
from sentilake.operators.scoring import score_reviews
from sentilake.plans.jobs import newest_model
from sentilake.sources import versions

BATCH_COLUMN = "batch_id"
#: Batches whose changes are kept one by one before they are folded into a snapshot.
SNAPSHOT_EVERY = 10


def read_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    name_filter: str | None = None,
    max_files_per_trigger: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A stream over the files that are or will be in a folder, or over a single file.

    A table may be one file or a folder of files under the same name; a path that names a file is read as its folder with only
    that name, as a stream reads folders. A CSV stream reads typed cells by its ``schema``, for instance that of ``read_raw_csv`` on earlier files.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and files.getFileStatus(target).isFile():
        path, name_filter = target.getParent().toString(), re.sub(r"([\\*?\[\]{}^])", r"\\\1", target.getName())
    reader = spark.readStream.format(file_format).schema(schema)
    if file_format == "csv":
        # As in batch reading, cells may hold quoted line breaks.
        reader = reader.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        reader = reader.option("mode", "FAILFAST")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def clean_stream(
    reviews: DataFrame, out_path: str, checkpoint: str, cfg: CleanConfig = CleanConfig()
) -> StreamingQuery:
    """Clean arriving reviews and append them as Parquet, then stop when the input is used up.

    Cleaning is stateless; deduplication is a stream operator of its own.
    """
    if cfg.deduplicate_on_text:
        raise ValueError("Use dedup_stream for deduplication in a stream.")
    observed = clean_reviews(reviews, cfg).observe("written", F.count(F.lit(1)).alias("rows"))
    return (
        observed.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(reviews: DataFrame, text_column: str, event_time: str, delay: str) -> DataFrame:
    """One row per text among rows whose event times lie within ``delay``.

    State holds a digest per text, not the text, and is dropped once the watermark passes.
    """
    digest = F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)
    return (
        reviews.withColumn("_digest", digest)
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["_digest"])
        .drop("_digest")
    )


def write_batches(
    stream: DataFrame, transform: Callable[[DataFrame, int], DataFrame], out_path: str, checkpoint: str
) -> StreamingQuery:
    """Run a batch job per micro-batch. A replayed batch replaces its own partition.

    The output is partitioned by batch id and dynamic overwrite is used, so a batch that is
    run again after a failure leaves no second copy.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        (
            transform(batch, batch_id)
            .withColumn(BATCH_COLUMN, F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH_COLUMN)
            .parquet(out_path)
        )

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    reviews: DataFrame,
    model: LinearTextModel,
    out_path: str,
    checkpoint: str,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    words: bool = False,
    lemma_table: DataFrame | None = None,
) -> StreamingQuery:
    """Score arriving reviews with the batch scorer; ``words`` adds the per-word list, ``lemma_table`` replaces the default lemmas."""
    return write_batches(
        reviews,
        lambda batch, _: score_reviews(batch, model, lexicon, cfg, words=words, lemma_table=lemma_table),
        out_path,
        checkpoint,
    )


def score_stream_newest(
    reviews: DataFrame,
    workspace: str,
    out_path: str,
    checkpoint: str,
    lexicon: Lexicon = Lexicon(),
    cfg: CleanConfig = CleanConfig(),
    words: bool = False,
    lemma_table: DataFrame | None = None,
) -> StreamingQuery:
    """Like :func:`score_stream`, but every micro-batch uses the newest registered model."""

    def score(batch: DataFrame, _: int) -> DataFrame:
        version, model = newest_model(batch.sparkSession, workspace)
        scored = score_reviews(batch, model, lexicon, cfg, words=words, lemma_table=lemma_table)
        return scored.withColumn("model_version", F.lit(version))

    return write_batches(reviews, score, out_path, checkpoint)


def running_counts(
    rows: DataFrame, group_column: str, out_path: str, checkpoint: str, snapshot_every: int = SNAPSHOT_EVERY
) -> StreamingQuery:
    """Running row counts per group, read with ``read_counts``.

    Each micro-batch writes the groups it changed as a folder of its own and commits it; every ``snapshot_every`` batches the
    committed folders are folded into a snapshot. Nothing that a reader may look at is overwritten, and a batch
    that is replayed commits the same counts under the same number again.
    """
    counts = rows.groupBy(group_column).agg(F.count("*").alias("n"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _commit_counts(batch.withColumn(BATCH_COLUMN, F.lit(batch_id).cast("long")), out_path, 2 * batch_id, "changes")
        if (batch_id + 1) % snapshot_every == 0:
            _commit_counts(_folded(spark, out_path, group_column), out_path, 2 * batch_id + 1, "snapshot")
            _remove_folded(spark, out_path)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _commit_counts(df: DataFrame, path: str, number: int, kind: str) -> None:
    """A folder of (group, n, batch_id). Changes have even numbers, snapshots the odd one after their last batch."""
    folder = f"{path}/{kind}={number}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    versions.append_record(df.sparkSession, path, number, folder, kind)


def _standing(spark: SparkSession, path: str) -> list[versions.Commit]:
    """The newest snapshot and the changes after it, each batch once."""
    found = versions.commits(spark, path)
    base = max((v for v, c in found.items() if c.source_job == "snapshot"), default=-1)
    return [c for v, c in sorted(found.items()) if v >= base]


def _folded(spark: SparkSession, path: str, group_column: str) -> DataFrame:
    folders = [c.folder for c in _standing(spark, path)]
    if not folders:
        raise ValueError(f"No counts are committed at {path}.")
    newest = F.max(F.struct(BATCH_COLUMN, "n")).alias("newest")
    return spark.read.parquet(*folders).groupBy(group_column).agg(newest).select(group_column, "newest.n", f"newest.{BATCH_COLUMN}")


def _remove_folded(spark: SparkSession, path: str) -> None:
    """Remove what the snapshot before the newest one has replaced: readers of the newest and of the one before go on."""
    found = versions.commits(spark, path)
    snapshots = sorted(v for v, c in found.items() if c.source_job == "snapshot")
    for number, record in found.items():
        if len(snapshots) > 1 and number < snapshots[-2]:
            versions.remove_folder(spark, record.folder)


def read_counts(spark: SparkSession, path: str, group_column: str) -> DataFrame:
    """(group, n) as of the newest committed batch; the folders are fixed when this is called, later batches do not show."""
    return _folded(spark, path, group_column).select(group_column, "n")
