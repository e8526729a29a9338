"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm.common import ascii_lower, bounded_batches, fresh, own_columns, passing_tables, stored, words
from sentilake.llm.components import connected_components

RADIUS = 2
SHINGLE = 3
BUCKET = 32
BYTES = 8
CHUNK = 1 << 15


def shingle_hashes(text: Column, size: int = SHINGLE) -> tuple[Column, str]:
    """The words of a text and SQL for the XXH64 (seed 42) of its word shingles, repeats included."""
    # concat_ws leaves out what stands beyond the end, so a short text is one shingle.
    parts = ", ".join(f"get(_words, i + {k})" for k in range(size))
    shingles = (
        f"if(size(_words) = 0, cast(array() as array<bigint>), "
        f"transform(sequence(0, greatest(size(_words) - {size}, 0)), i -> xxhash64(concat_ws(' ', {parts}))))"
    )
    return words(ascii_lower(text)), shingles


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per run of hashes: bits set in over half of them. An empty run gives zero."""
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    out = np.zeros(len(ends), np.uint64)
    filled = np.flatnonzero(sizes)
    first = 0
    while first < len(filled):
        # Whole documents, about CHUNK hashes at a time; a longer document is summed in pieces.
        last = first + 1
        while last < len(filled) and ends[filled[last]] - starts[filled[first]] <= CHUNK:
            last += 1
        docs = filled[first:last]
        low, high = starts[docs[0]], ends[docs[-1]]
        if len(docs) == 1:
            counts = np.zeros((1, 64), np.int64)
            for at in range(low, high, CHUNK):
                bits = np.unpackbits(hashes[at : min(at + CHUNK, high)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[0] += bits.sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts[docs] - low, axis=0, dtype=np.int32)
        chosen = counts * 2 > sizes[docs][:, None]
        out[docs] = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64).ravel()
        first = last
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("h")
        offsets = lists.offsets.to_numpy()
        hashes = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
        prints = majority_bits(hashes, (offsets[1:] - offsets[0]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """SimHash of every whole text: (doc_id, fp long). Null and blank texts have fingerprint zero.

    Hashes are made by Spark; Python gets arrays of longs only and counts their bits.
    """
    bounded_batches(docs.sparkSession)
    split, shingles = shingle_hashes(F.col(text_column), size)
    hashed = docs.select(F.col(id_column).alias("doc_id"), split.alias("_words"))
    hashed = hashed.select("doc_id", F.expr(shingles).alias("h"))
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def _shared_bytes(a: str, b: str) -> str:
    """How many of the eight positional bytes two fingerprints share."""
    return " + ".join(f"if(((shiftrightunsigned({a} ^ {b}, {8 * p})) & 255) = 0, 1, 0)" for p in range(BYTES))


def linked_pairs(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links that connect all distinct fingerprints within ``RADIUS`` = 2 bits: (node, other).

    ``prints``: distinct (fp, node). Two fingerprints that differ in 2 bits share at least 6 positional bytes. One byte
    is too weak a posting (each would hold a 256th of all rows), so the index is kept by sets of four positional bytes:
    the bytes form four blocks of two, and 2 differing bits leave at least two blocks whole. Pairs
    of a posting are tallied: those that share at least 6 bytes are kept and verified by their differing bits.

    Postings of more than ``bucket`` fingerprints would give pairs in the square of their length. Their members take an exact
    way of linear size instead: each fingerprint is listed under all points within one bit of it. Two fingerprints are
    within 2 bits exactly if a point lists both; a point lists 65 at most, and its members are linked to the smallest.
    """
    with passing_tables(prints.sparkSession) as keep:
        blocks = [f"(shiftrightunsigned(fp, {16 * p}) & 65535)" for p in range(4)]
        keys = [
            f"shiftleft({n}L, 32) | shiftleft({blocks[i]}, 16) | {blocks[j]}" for n, (i, j) in enumerate(combinations(range(4), 2))
        ]
        postings = prints.withColumn("key", F.explode(F.array(*[F.expr(k) for k in keys])))
        sizes = keep(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-postings")
        listed = postings.join(sizes, "key")
        few = keep(listed.filter(f"n <= {bucket}").select("key", "fp", "node"), "simhash-few")
        pairs = (
            few.alias("a").join(few.alias("b"), F.expr("a.key = b.key AND a.node > b.node"))
            .withColumn("shared", F.expr(_shared_bytes("a.fp", "b.fp")))
            .filter(F.expr(f"shared >= {BYTES - RADIUS} AND bit_count(a.fp ^ b.fp) <= {RADIUS}"))
            .select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))
        )
        dense = listed.filter(f"n > {bucket}").select("fp", "node").distinct()
        near = [F.col("fp")] + [F.expr(f"fp ^ shiftleft(1L, {bit})") for bit in range(64)]
        points = dense.withColumn("point", F.explode(F.array(*near)))
        met = points.groupBy("point").agg(F.collect_list(F.struct("node", "fp")).alias("met")).filter("size(met) > 1")
        stars = (
            met.withColumn("least", F.array_min("met")).withColumn("one", F.explode("met"))
            .filter(F.expr("one.node != least.node"))
            .select(F.col("one.node").alias("node"), F.col("least.node").alias("other"))
        )
        return stored(pairs.unionByName(stars).distinct(), "simhash-links")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE,
    bucket: int = BUCKET,
) -> DataFrame:
    """Component of every document under links of at most two differing bits: (doc_id, fp, component_id).

    Exact copies share a fingerprint and meet in one combined grouping; only distinct fingerprints enter the index. Null and blank
    texts have fingerprint zero and link like any other. Rows that repeat an id each keep their fingerprint. A row
    without id gets its fingerprint and a null component. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_column, text_column, size), "simhash")
    nodes = stored(
        prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes"
    )
    links = linked_pairs(nodes, bucket)
    found = connected_components(links, "node", "other")
    # A component is named after the smallest id; an id that repeats with other texts joins its fingerprints.
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    named = stored(named, "simhash-named")
    joined = prints.join(named, "fp", "left")
    return joined.select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, the one with the smallest id; columns unchanged.

    Documents are grouped by ``near_duplicates``; its options are passed on. Rows that repeat an id stand for one document, of which the
    row of smallest text hash stays. Null and blank texts are copies of each other. Rows without an id cannot be
    named and stay. An empty table stays empty.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(id_column)).distinct()
    kept = stored(kept, "simhash-kept")
    named = docs.filter(F.col(id_column).isNotNull()).join(kept, id_column, "left_semi").select(own_columns(docs))
    # The join has placed the rows by id, so the choice among rows that repeat one shuffles nothing.
    rank = fresh(docs, "_rank")
    text = F.coalesce(F.col(text_column), F.lit(""))
    first = F.row_number().over(Window.partitionBy(id_column).orderBy(F.xxhash64(text), text))
    one = named.withColumn(rank, first).filter(F.col(rank) == 1).select(own_columns(docs))
    return one.unionByName(docs.filter(F.col(id_column).isNull()))


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
