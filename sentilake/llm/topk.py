"""Exact top-k search by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm.common import stored

SCALE = 1024
BLOCK = 128
CELL_BLOCKS = 32
CHUNK = 512
LONG = np.iinfo(np.int64)
_SCHEMA = "part int, region long, dims int, ids array<long>, data array<long>, high array<long>, low array<long>"


def whole_numbers(vector: Column) -> Column:
    """floor(1024 x) of every component, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack sorted rows into blocks of a document range: forward index, and each term's largest and smallest value."""
    part = TaskContext.get().partitionId()
    held: list[tuple[int, np.ndarray]] = []
    made, last = 0, None

    def pack() -> pa.RecordBatch:
        dims = max(len(v) for _, v in held)
        data = np.zeros((len(held), dims), np.int64)
        for row, (_, v) in zip(data, held, strict=True):
            row[: len(v)] = v
        columns = [[part], [made // CELL_BLOCKS], [dims], [[i for i, _ in held]], [data.ravel()], [data.max(0)], [data.min(0)]]
        types = [pa.int32(), pa.int64(), pa.int32()] + [pa.list_(pa.int64())] * 4
        names = ["part", "region", "dims", "ids", "data", "high", "low"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        lists = batch.column("v")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for n, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            if vec_id == last:
                continue
            last = vec_id
            held.append((vec_id, flat[ends[n] : ends[n + 1]].copy()))
            if len(held) == BLOCK:
                yield pack()
                made, held = made + 1, []
    if held:
        yield pack()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product. In doubles where no sum can pass 2 ** 53, else in Python's integers, held to 64 bits."""
    most = a.shape[1] * int(max(a.max(initial=0), -a.min(initial=0))) * int(max(b.max(initial=0), -b.min(initial=0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def _widen(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = row
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == LONG.min else -scores))[:k]
    return ids[order], scores[order]


def search_cell(queries: pa.Table, blocks: pa.Table, k: int) -> tuple[pa.Table, int]:
    """The k best of a cell's blocks for each query, and how many blocks were scored."""
    names = queries.column("query_id").to_pylist()
    vectors = [np.asarray(v, np.int64) for v in queries.column("v").to_pylist()]
    dims = max([*(len(v) for v in vectors), *blocks.column("dims").to_pylist(), 1])
    wanted = _widen(vectors, dims)
    lists = [np.asarray(x, np.int64) for x in blocks.column("ids").to_pylist()]
    packed = [
        _widen(np.asarray(x, np.int64).reshape(len(i), d) if d else [[]] * len(i), dims)
        for x, i, d in zip(blocks.column("data").to_pylist(), lists, blocks.column("dims").to_pylist(), strict=True)
    ]
    high = _widen(blocks.column("high").to_pylist(), dims)
    low = _widen(blocks.column("low").to_pylist(), dims)
    # A term adds at most its maximum times a positive weight, or its minimum times a negative one.
    above, below = _product(np.maximum(wanted, 0), high), _product(np.minimum(wanted, 0), low)
    if max(np.abs(above).max(initial=0), np.abs(below).max(initial=0)) < 1 << 62:
        bounds = above + below
    else:  # held at the limit of 64 bits: no block can be ruled out
        bounds = np.full(above.shape, LONG.max)
    out: list[tuple[int, int, int]] = []
    scored = 0
    for q, name in enumerate(names):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[q], kind="stable"):
            if len(ids) == k and bounds[q, b] < scores[-1]:
                break
            scored += 1
            got = _product(wanted[q : q + 1], packed[b])[0]
            other = lists[b] != name
            ids, scores = _best(np.concatenate((ids, lists[b][other])), np.concatenate((scores, got[other])), k)
        out += zip([name] * len(ids), ids.tolist(), scores.tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table(
        {n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)}
    ), scored


def exact_top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k rows of highest integer inner product for every query row: (query_id, rank, vec_id, score).

    Rows are sorted by id over the cluster and packed into blocks of ``BLOCK`` neighbours; a cell is ``CELL_BLOCKS`` blocks.
    Queries (rows where ``queries`` holds) are dealt to chunks of about ``CHUNK``, and each (chunk, cell) pair is a bounded
    task. It orders the cell's blocks by their summed term bounds per query and scores them through the forward index until
    the next bound is below the k-th score; blocks that tie with it are scored, since ties go to the smaller id. The cells'
    lists meet in one ranking per query.

    Vectors that are null or hold null or non-finite components and rows without id take no part. Rows that repeat an id count once,
    with the smallest vector. A shorter vector counts as ended by zeros. Scores beyond 64 bits are held at the limit.
    """
    rows = vectors.filter(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(
        F.col(id_column).alias("vec_id"), whole_numbers(F.col(vector_column)).alias("v"), queries.alias("asked")
    )
    sorted_ = rows.select("vec_id", "v").repartitionByRange("vec_id").sortWithinPartitions("vec_id", "v")
    blocks = stored(sorted_.mapInArrow(_blocks, _SCHEMA), "topk-blocks")
    asked = rows.filter("asked").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = stored(asked, "topk-queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    # Cells are numbered from the few rows (part, cells of it), so that queries can be dealt to them without a join.
    parts = blocks.groupBy("part").agg((F.max("region") + 1).alias("cells"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("first", F.coalesce(F.sum("cells").over(before), F.lit(0))), "topk-parts")
    cells = parts.agg(F.sum("cells")).first()[0] or 0
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    dealt = blocks.join(parts.select("part", "first"), "part").select(
        (F.col("first") + F.col("region")).alias("cell"), every_chunk, "dims", "ids", "data", "high", "low"
    )
    every_cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(cells, 1) - 1).cast("long"))).alias("cell")
    asking = asked.select(
        every_cell, F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "v"
    )

    def search(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not wanted.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        return search_cell(wanted, held, k)[0]

    found = (
        asking.groupBy("chunk", "cell")
        .cogroup(dealt.groupBy("chunk", "cell"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
