"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.llm import ngrams
from sentilake.llm.common import bounded_batches, fresh, own_columns, stored

BUCKETS = 1 << 14
#: Bound of the labelled sample that the target model and the cut are fitted on.
LABELLED = 20_000
SEED = 17
HISTOGRAM = 1 << 12
FEW = 10_000
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of all word and punctuation unigrams and bigrams. A word before itself is one symbol."""
    starts, ends, row = ngrams.spans(data, offsets, ngrams.byte_classes(split_punctuation=True))
    one = ngrams.span_hashes(data, starts, ends)
    two = ngrams.mix(one[:-1] * np.uint64(3) + one[1:])
    two[one[:-1] == one[1:]] = _REPEAT
    inside = row[1:] == row[:-1]
    grams = np.concatenate((one, two[inside])) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate((row, row[1:][inside]))


def gram_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of both models over all rows (text, target): (bucket, raw, target). Each task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in ngrams.chunks(batch.column("text")):
                bucket, row = gram_buckets(data, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[first:end][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"]
        )

    counted = rows.select("text", "target").mapInArrow(count, "bucket int, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass(frozen=True)
class QualityFilter:
    """Log ratios of the two models per bucket, and the key from which a document is taken."""

    ratios: np.ndarray
    cut: float
    seed: int = SEED

    def weight(self, text: Column) -> Column:
        """Log importance weight: the sum of log(target / raw) over the text's n-grams. Null and empty: 0."""
        ratios = self.ratios

        @F.arrow_udf("double")
        def weigh(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts))
            for first, end, data, offsets in ngrams.chunks(texts):
                bucket, row = gram_buckets(data, offsets, len(ratios))
                out[first:end] = np.bincount(row, ratios[bucket], end - first)
            return pa.array(out)

        return weigh(text)

    def key(self, identifier: Column, weight: Column) -> Column:
        """The weight plus Gumbel noise that the id decides, so that reruns agree."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), identifier), 11)
        uniform = (bits + F.lit(0.5)) * F.lit(2.0**-53)
        return weight - F.log(-F.log(uniform))

    def keep(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """The taken documents, columns unchanged; one map-side pass."""
        bounded_batches(docs.sparkSession)
        weight = fresh(docs, "_weight")
        weighed = docs.withColumn(weight, self.weight(F.col(text_column)))
        kept = weighed.filter(self.key(F.col(id_column), F.col(weight)) >= F.lit(self.cut))
        return kept.select(own_columns(docs))


def log_ratios(counts: DataFrame, buckets: int) -> np.ndarray:
    """log(target / raw) per bucket with add-one smoothing; zero where there is no target text."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # one row a bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms that narrow to few rows: no task sorts the column."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    rows = values.filter(F.col(column).isNotNull())
    while n > FEW and low < high:
        width = (high - low) / HISTOGRAM
        if low + width == low:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(HISTOGRAM - 1))
        bins = rows.groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most HISTOGRAM rows
            if k <= row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            k -= row["n"]
        rows = values.filter(F.col(column).between(low, high))
    if low == high:
        return low
    return rows.orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight between the held-out classes with the highest balanced accuracy; in a gap its middle."""
    if good.all() or not good.any():
        return -math.inf if good.any() or not len(good) else math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(float)
    lost = np.concatenate(([0.0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0.0], np.cumsum(1 - g))) / (1 - g).sum()
    edges = np.concatenate(([w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]))
    return float(edges[np.argmax(caught - lost)])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    labelled: int = LABELLED,
    seed: int = SEED,
) -> tuple[QualityFilter, DataFrame]:
    """Fit both n-gram models and the cut; also the weights of all documents: (doc_id, weight, key).

    Raw model: every text of ``docs``. Target model: texts labelled good (quality 1, not toxic) of a sample of ``labelled``
    labels in hash order, of which a quarter is held out. The held-out weights give the best boundary between
    good and all others; the number k of documents above it is the size of the resample, and the k largest of weight plus Gumbel
    noise are taken. Documents that tie at the cut are all taken.

    Contradicting labels count as bad, labels without id are ignored. Null and empty texts weigh 0. Without a good or without a bad
    label nothing can be told apart: all documents are taken if any label is good or there is none, else none.
    """
    bounded_batches(docs.sparkSession)
    sound = F.coalesce(F.col("quality") == 1, F.lit(False))
    good = sound & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    sample = (
        labels.filter(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(good).alias("good"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id")
        .limit(labelled)
        .withColumn("held", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(4)) == 0)
    )
    sample = F.broadcast(stored(sample, "quality-labels"))  # at most ``labelled`` rows
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    marked = rows.join(sample, F.col("doc_id") == F.col("_id"), "left")
    target = F.coalesce(F.col("good") & ~F.col("held"), F.lit(False))
    counts = gram_counts(marked.select("text", target.alias("target")), buckets)
    model = QualityFilter(log_ratios(counts, buckets), -math.inf, seed)
    weighed = marked.select("doc_id", "good", "held", model.weight(F.col("text")).alias("weight"))
    weighed = stored(weighed.withColumn("key", model.key(F.col("doc_id"), F.col("weight"))), "quality-weights")
    # Documents that repeat an id may be more than the labels; which of them count must not change between runs.
    held = weighed.filter("held").orderBy(F.xxhash64("doc_id"), "doc_id", "weight").limit(labelled)
    known = held.select("weight", "good").toPandas()
    boundary = best_cut(known["weight"].to_numpy(float), known["good"].to_numpy(bool))
    taken = weighed.filter(F.col("weight") >= F.lit(boundary)).count()
    fitted = QualityFilter(model.ratios, kth_largest(weighed, "key", taken), seed)
    return fitted, weighed.select("doc_id", "weight", "key")


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that importance resampling takes: (doc_id, weight, key)."""
    fitted, weights = fit_quality(docs, labels, **options)
    return weights.filter(F.col("key") >= F.lit(fitted.cut))
