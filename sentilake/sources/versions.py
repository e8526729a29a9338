"""Versioned datasets with a log of commits: readers see whole versions only, old ones until the new one stands.

A dataset is a folder of ``version=N/attempt=ID`` Parquet folders and a log ``_commits``. Every publish writes a folder of its
own first and then one record to the log; what no record names was never published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "_commits"
STAMPS = ("version", "source_job", "original_path")
TRIES = 100


@dataclass(frozen=True)
class Commit:
    """One record of the log. ``digest`` sums hashes of the rows, so it does not depend on their order."""

    number: int
    version: int
    folder: str
    rows: int
    digest: str
    source_job: str
    original_path: str
    replaces: bool


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _log(spark: SparkSession, path: str) -> list[Commit]:
    """All records in order. A record that is cut short counts as not written."""
    folder, files = _files(spark, f"{path}/{LOG}")
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = files.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode("utf-8")
            stream.close()
            try:
                found.append(Commit(**json.loads(text)))
            except (ValueError, TypeError):
                continue
    return sorted(found, key=lambda c: c.number)


def commits(spark: SparkSession, path: str) -> dict[int, Commit]:
    """The committed versions: of each the last record, without those that a later record replaced."""
    standing: dict[int, Commit] = {}
    for record in _log(spark, path):
        if record.replaces:
            standing = {}
        standing[record.version] = record
    return standing


def newest(spark: SparkSession, path: str) -> Commit:
    """The committed version of highest number. Reads the log, starts no job."""
    standing = commits(spark, path)
    if not standing:
        raise ValueError(f"No version is committed at {path}.")
    return standing[max(standing)]


def _append(spark: SparkSession, path: str, record: Commit) -> Commit:
    """Write the record under the next free number. Numbers that others hold, whole or cut short, are passed over."""
    folder, files = _files(spark, f"{path}/{LOG}")
    for _ in range(TRIES):
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        taken = replace(record, number=1 + max(numbers, default=0))
        target, _ = _files(spark, f"{path}/{LOG}/{taken.number:012d}.json")
        try:
            stream = files.create(target, False)  # fails if another writer was first
        except Py4JJavaError as error:
            if files.exists(target):
                continue
            raise OSError(f"The record {target} could not be written.") from error
        stream.write(bytearray(json.dumps(asdict(taken)).encode("utf-8")))
        stream.close()
        return taken
    raise OSError(f"The log of {path} was busy {TRIES} times.")


def publish_version(
    df: DataFrame, path: str, version: int, source: str, original_path: str, replace_existing: bool = True
) -> Commit:
    """Publish a table as one version of a named dataset.

    ``replace_existing`` leaves this version alone; otherwise it stands beside the others. Publishing a version
    again, as a retry does, replaces its rows and no others. Replaced folders are removed when the new version is
    committed; a publish that fails leaves all earlier versions as they were. Row count and digest come from the write itself.
    """
    spark = df.sparkSession
    folder = f"{path}/version={int(version)}/attempt={uuid.uuid4().hex}"
    seen = Observation()
    digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(digest, F.lit(0).cast("decimal(38,0)")).alias("digest"))
    stamped = observed.withColumns({"source_job": F.lit(source), "original_path": F.lit(original_path)})
    stamped.write.parquet(folder)
    found = seen.get
    return commit_folder(
        spark, path, int(version), folder, int(found["rows"]), str(found["digest"]), source, original_path, replace_existing
    )


def commit_folder(
    spark: SparkSession,
    path: str,
    version: int,
    folder: str,
    rows: int,
    digest: str,
    source: str,
    original_path: str,
    replace_existing: bool = True,
) -> Commit:
    """Make a folder that is written in full the one that readers of this version find."""
    record = _append(spark, path, Commit(0, version, folder, rows, digest, source, original_path, replace_existing))
    remove_replaced(spark, path)
    return record


def remove_replaced(spark: SparkSession, path: str) -> None:
    """Remove the folders of records that do not stand any more. Folders that no record names may still be written to: they stay."""
    standing = {c.folder for c in commits(spark, path).values()}
    for record in _log(spark, path):
        if record.folder not in standing:
            remove_folder(spark, record.folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    target, files = _files(spark, folder)
    files.delete(target, True)


def append_record(spark: SparkSession, path: str, version: int, folder: str, source: str) -> Commit:
    """Commit a folder beside all others, and remove nothing."""
    return _append(spark, path, Commit(0, version, folder, -1, "", source, "", False))


def read_versions(spark: SparkSession, path: str, versions: list[int] | None = None) -> DataFrame:
    """Rows of the committed versions (of all, or of those named) with their version."""
    standing = commits(spark, path)
    wanted = sorted(standing) if versions is None else versions
    missing = [v for v in wanted if v not in standing]
    if missing or not wanted:
        raise ValueError(f"No version {missing or ''} is committed at {path}.")
    rows = spark.read.option("basePath", path).parquet(*[standing[v].folder for v in wanted])
    return rows.drop("attempt")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest committed version; only its folder is listed and read."""
    return read_versions(spark, path, [newest(spark, path).version]).drop(*STAMPS)
