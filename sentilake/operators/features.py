"""Vocabulary and TF-IDF, in long form and as ``pyspark.ml`` vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentilake.config import FeatureConfig
from sentilake.functions import text
from sentilake.operators import term_arrays
from sentilake.operators.checks import require_columns
from sentilake.session import cut_lineage, remove_written, written

# A vocabulary up to this many rows is broadcast; its size is capped by ``max_features``.
BROADCAST_TERMS = 500_000

#: Parts that the table of all terms is cut into, at least.
PLACES_PER_CORE = 16

EVERY_DOCUMENT = ""


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: (term, idx, df, tf, idf) and the number of training documents."""

    vocabulary: DataFrame
    n_docs: int
    cfg: FeatureConfig
    # Vector stages already built from this vocabulary.
    stages: dict[tuple[str, str], PipelineModel] = field(default_factory=dict, compare=False, repr=False)

    def lookup(self) -> DataFrame:
        """The vocabulary, marked for broadcast only where ``max_features`` proves it small."""
        return F.broadcast(self.vocabulary) if self.cfg.max_features <= BROADCAST_TERMS else self.vocabulary

    def has_stages(self) -> bool:
        """The vocabulary may pass through the driver, and it has a term."""
        return self.cfg.max_features <= BROADCAST_TERMS and bool(self.stages or not self.vocabulary.isEmpty())


def document_terms(tokens: Column, cfg: FeatureConfig) -> Column:
    return text.ngram_terms(tokens, cfg.ngram_min, cfg.ngram_max)


def term_statistics(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """(term, df, tf) over all documents, in one shuffle of pre-combined term counts.

    Tasks count the terms of many documents at a time. Both counts are sums per term, so no
    (document, term) pair is ever shuffled and a term found in every document costs one
    partial row per run of documents. These rows are placed by term as they come: a table of all terms that a
    task meets would grow with its share of the input. The empty term, which no text holds, has the number of documents for its df.
    """
    tokens = df.select(text.text_tokens(F.col(cfg.text_column)).alias("tokens"))
    counted = term_arrays.term_frequencies(tokens, EVERY_DOCUMENT, cfg.ngram_min, cfg.ngram_max)
    spark = df.sparkSession
    # By number, as parts put together again would hold many terms each.
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PLACES_PER_CORE * spark.sparkContext.defaultParallelism)
    return counted.repartition(places, "term").groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("tf"))


def frequency_cuts(stats: DataFrame, n_docs: int, cfg: FeatureConfig) -> DataFrame:
    """Terms found in at least ``min_df`` documents and at most a ``max_df`` share of them."""
    return stats.filter((F.col("df") >= cfg.min_df) & (F.col("df") <= F.lit(float(cfg.max_df)) * F.lit(n_docs)))


def lowest_kept_frequency(stats: DataFrame, k: int) -> int:
    """The corpus frequency of the k-th most frequent term, from a histogram of frequencies."""
    falling = Window.orderBy(F.col("tf").desc())
    histogram = stats.groupBy("tf").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(falling))
    return histogram.filter(F.col("upto") - F.col("n") < k).agg(F.min("tf")).first()[0] or 0


def number_terms(stats: DataFrame, n_docs: int, cfg: FeatureConfig) -> DataFrame:
    """The ``max_features`` most frequent terms, ties by term, with index and smoothed idf."""
    top = stats.orderBy(F.col("tf").desc(), F.col("term")).limit(cfg.max_features)
    # At most max_features rows are left, so numbering them in one task is bounded.
    number = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return top.select("term", number.cast("int").alias("idx"), "df", "tf", idf.alias("idf"))


def fit_tfidf(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> TfidfModel:
    """Fit vocabulary and inverse document frequency on the given (training) rows."""
    require_columns(df, [cfg.text_column])
    is_total = F.col("term") == EVERY_DOCUMENT
    # The table of all n-grams may be large: it is written by columns, and goes when the vocabulary stands.
    counted, path = written(term_statistics(df, cfg).filter((F.col("df") >= cfg.min_df) | is_total), "term-statistics")
    try:
        every = counted.filter(is_total).first()
        n_docs = every["df"] if every else 0
        stats = frequency_cuts(counted.filter(~is_total), n_docs, cfg)
        if stats.count() > cfg.max_features:
            # Only the winners and the ties of the last one reach the final ordering.
            stats = stats.filter(F.col("tf") >= lowest_kept_frequency(stats, cfg.max_features))
        vocabulary = cut_lineage(number_terms(stats, n_docs, cfg))
    finally:
        remove_written(df.sparkSession, path)
    return TfidfModel(vocabulary, n_docs, cfg)


def tfidf_entries(df: DataFrame, model: TfidfModel, *carry: str) -> DataFrame:
    """(id, *carry, idx, count, tfidf) with every document scaled to length one, for a vocabulary that has stages.

    The terms of a document are counted, weighted and scaled within its row: nothing is shuffled, and a task holds
    one document's terms, however many documents it reads.
    """
    cfg = model.cfg
    require_columns(df, [cfg.id_column, cfg.text_column, *carry])
    terms = F.coalesce(document_terms(text.text_tokens(F.col(cfg.text_column)), cfg), F.array().cast("array<string>"))
    rows = vector_pipeline(model, "_terms", "_features").transform(df.select(cfg.id_column, *carry, terms.alias("_terms")))
    counts, scaled = F.unwrap_udt("_tf"), F.unwrap_udt("_features")
    entries = F.arrays_zip(counts["indices"].alias("idx"), counts["values"].alias("count"), scaled["values"].alias("tfidf"))
    found = rows.select(cfg.id_column, *carry, F.inline(entries)).toDF(cfg.id_column, *carry, "idx", "count", "tfidf")
    return found.withColumn("count", F.col("count").cast("bigint"))


def tfidf_long(df: DataFrame, model: TfidfModel, *carry: str) -> DataFrame:
    """(id, *carry, term, idx, count, tfidf) with every document scaled to length one.

    Up to ``BROADCAST_TERMS`` terms without a shuffle. Beyond, documents are placed by id once; counting, weighting and the
    norm then run without another one.
    """
    cfg = model.cfg
    key = cfg.id_column
    require_columns(df, [key, cfg.text_column, *carry])
    if model.has_stages():
        names = F.broadcast(model.vocabulary.select("idx", "term"))
        return tfidf_entries(df, model, *carry).join(names, "idx").select(key, *carry, "term", "idx", "count", "tfidf")
    placed = df.select(key, *carry, cfg.text_column).repartition(key)
    terms = placed.select(
        key, *carry, F.explode(document_terms(text.text_tokens(F.col(cfg.text_column)), cfg)).alias("term")
    )
    counted = (
        terms.join(model.lookup().select("term", "idx", "idf"), "term")
        .groupBy(key, *carry, "idx", "idf", "term")
        .agg(F.count("*").alias("count"))
        .withColumn("weight", F.col("count") * F.col("idf"))
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return counted.select(key, *carry, "term", "idx", "count", (F.col("weight") / norm).alias("tfidf"))


def vector_pipeline(model: TfidfModel, terms_column: str = "terms", output: str = "features") -> PipelineModel:
    """The fitted TF-IDF as ``pyspark.ml`` stages over an array-of-terms column.

    The vocabulary is capped by ``max_features``, so it may pass through the driver up to ``BROADCAST_TERMS``.
    """
    if (terms_column, output) in model.stages:
        return model.stages[terms_column, output]
    if model.cfg.max_features > BROADCAST_TERMS:
        raise ValueError(f"A vocabulary of over {BROADCAST_TERMS} terms has no stages; vectorize() joins it instead.")
    rows = model.vocabulary.orderBy("idx").select("term", "idf").collect()
    if not rows:
        raise ValueError("The vocabulary is empty after the document-frequency cuts.")
    counts = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=terms_column, outputCol="_tf")
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_tf", outputCol="_tfidf"
    )
    stages = PipelineModel([counts, weights, Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)])
    model.stages[terms_column, output] = stages
    return stages


def with_terms(df: DataFrame, cfg: FeatureConfig, output: str = "terms") -> DataFrame:
    return df.withColumn(output, document_terms(text.text_tokens(F.col(cfg.text_column)), cfg))


def vectorize(df: DataFrame, model: TfidfModel, output: str = "features") -> DataFrame:
    """Adds the TF-IDF vector column. Map-only up to ``BROADCAST_TERMS`` terms, beyond it ``vectorize_joined``."""
    if model.cfg.max_features > BROADCAST_TERMS:
        return vectorize_joined(df, model, output)
    stages = vector_pipeline(model, "_terms", output)
    return stages.transform(with_terms(df, model.cfg, "_terms")).drop("_terms", "_tf", "_tfidf")


def vectorize_joined(df: DataFrame, model: TfidfModel, output: str = "features") -> DataFrame:
    """Adds the TF-IDF vector column for a vocabulary of any size.

    Terms meet the vocabulary in a join, and each document's entries, at most as many as it has terms, are put together
    by its id, which must be unique. A document without a known term has the zero vector.
    """
    key = model.cfg.id_column
    if output in df.columns:
        raise ValueError(f"The column {output} is there already.")
    size = model.vocabulary.count()
    if not size:
        raise ValueError("The vocabulary is empty after the document-frequency cuts.")
    entries = (
        tfidf_long(df, model).groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("idx", "tfidf"))).alias("_entries"))
    )

    def sparse(idx: list[int] | None, values: list[float] | None) -> SparseVector:
        return SparseVector(size, idx or [], values or [])

    made = F.udf(sparse, VectorUDT())(F.col("_entries.idx"), F.col("_entries.tfidf"))
    return df.join(entries, key, "left").withColumn(output, made).drop("_entries")
