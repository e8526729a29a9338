"""From raw documents to shards: every stage is one of the pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.llm import decontaminate, mixing, near_dedup, quality, sharding
from sentilake.llm.common import passing_tables, stored
from sentilake.llm.queries import Query

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good text rejects go."""
    fitted, _ = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return fitted.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: each document stands as often as the mix takes it."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its place in it; columns of documents are kept."""
    placed = sharding.assign_shards(docs, "doc_id", SHARDS, "shard", grown="grown_shard")
    return sharding.number_slots(placed.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), "shard", ["doc_id", "text_crc32"])


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's rows are written and read again."""
    docs = _table(spark, sf_dir, "documents")
    with passing_tables(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), f"pipeline-{name}")


#: Importance weights, min-hashes and SimHashes are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
