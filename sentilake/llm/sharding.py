"""Jump consistent hashing of stable keys to shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sentilake.llm.common import fresh

#: Fixed values of the published method: the generator's factor and the range of its draws.
FACTOR = 2862933555777941757
RANGE = float(1 << 31)
#: Hex digits of the hash that name a slot cell: 4096 cells a shard.
SLOT_DIGITS = 3


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. A key moves to shard n only when shard n is added."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    to = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        at[open_] = to[open_]
        key[open_] = key[open_] * np.uint64(FACTOR) + np.uint64(1)
        draws = ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to[open_] = ((at[open_] + 1).astype(np.float64) * (RANGE / draws)).astype(np.int64)
        open_ = open_[to[open_] < shards]
    return at.astype(np.int32)


def stable_key(df: DataFrame, column: str) -> Column:
    """Integers are their own key; any other type is hashed. Null keys count as zero."""
    kind = df.schema[column].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(column).cast("long") if whole else F.xxhash64(column), F.lit(0).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return place(key)


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row, and if ``grown`` is named, the shard it would have with one more.

    Map-side only: no shuffle, no ring table. Rows with equal keys share a shard, null keys share the shard
    of key 0; the result columns replace columns of the same name. An empty table stays empty.
    """
    value = stable_key(df, key)
    out = {shard: shard_of(value, shards)}
    if grown:
        out[grown] = shard_of(value, shards + 1)
    return df.withColumns(out)


def number_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot", digits: int = SLOT_DIGITS) -> DataFrame:
    """Number the rows of each shard without a gap, from 0.

    A shard is cut into 16 ** ``digits`` hash cells by the order columns; rows are ranked within a cell and a small
    table of cell counts (shards x cells rows, so it may be broadcast) gives each cell its base, so that no task sorts a whole shard.
    Rows that agree in all order columns are numbered in any order.
    """
    cell, base, n = (fresh(df, name) for name in ("_slot_cell", "_slot_base", "_slot_n"))
    keyed = df.withColumn(cell, F.substring(F.md5(F.concat_ws("|", *order)), 1, digits))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        keyed.groupBy(shard, cell)
        .agg(F.count(F.lit(1)).alias(n))
        .select(shard, cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    )
    within = Window.partitionBy(shard, cell).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        keyed.withColumn(slot, F.row_number().over(within) - 1)
        .join(F.broadcast(bases), [shard, cell])
        .withColumn(slot, F.col(slot) + F.col(base))
        .drop(cell, base)
    )


def write_shards(df: DataFrame, path: str, key: str, shards: int, rows_per_file: int = 1_000_000) -> str:
    """Write the table with one folder a shard; large shards hold several files."""
    assign_shards(df, key, shards).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    return path
