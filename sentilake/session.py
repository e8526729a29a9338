"""Session and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "sentilake", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    """One process holds driver and executors."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster. Only a local master may do without: it gets a new temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not is_local(spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        configured = tempfile.mkdtemp(prefix="sentilake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write an intermediate table to the shared folder as Parquet; the table read from there, and its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept_once(df: DataFrame, name: str) -> DataFrame:
    """Rows that many passes read: made once, written to the shared folder by columns, or by rows where Parquet cannot hold them."""
    kinds = df.schema.simpleString()
    if "void" in kinds or "interval" in kinds or len({c.lower() for c in df.columns}) < len(df.columns):
        return cut_lineage(df)
    return written(df, name)[0]


def remove_checkpoint(df: DataFrame) -> None:
    """Remove the files behind a table that ``cut_lineage`` made; nothing reads it any more."""
    path = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if path.isDefined():
        remove_written(df.sparkSession, path.get())


def remove_written(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written`` made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
