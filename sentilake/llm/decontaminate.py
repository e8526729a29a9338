"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake.llm.common import fresh, own_columns, small_side, stored

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 16
BLOCK_RADIUS = 1
#: With 16 blocks that may each differ in one bit, every fingerprint within 31 of 64 bits shares a block.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
ITEM_ROWS = 1_000_000
#: Documents with windows are marked in a map of this many bits, which all tasks get: 16 MB, however many documents there are.
MAP_BITS = 27
PART_BITS = 32768


def normal_words(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case. Null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), "")


def with_shingles(df: DataFrame, text: str, output: str, size: int = SHINGLE) -> DataFrame:
    """Add the hashes of the text's word shingles in order; texts of fewer words have none."""
    parts = ", ".join(f"get(_words, i + {k})" for k in range(size))
    shingles = (
        f"if(size(_words) < {size}, cast(array() as array<bigint>), "
        f"transform(sequence(0, greatest(size(_words) - {size}, 0)), i -> xxhash64({parts})))"
    )
    hashed = df.withColumn("_words", F.transform(normal_words(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(output, F.expr(shingles)).drop("_words")


def simhash(shingles: str) -> str:
    """SQL for the 64-bit SimHash of an array of hashes; repeated shingles weigh as often as they occur."""
    ones = f"size(filter({shingles}, h -> (shiftright(h, b) & 1) = 1))"
    return (
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> if(2 * {ones} > size({shingles}), acc | shiftleft(1L, b), acc))"
    )


def weighted_similarity(a: str, b: str) -> str:
    """SQL for shared over all shingles, each counted as often as it occurs."""
    shared = (
        f"aggregate(array_distinct({b}), 0, (acc, d) -> acc + "
        f"least(size(filter({a}, x -> x = d)), size(filter({b}, x -> x = d))))"
    )
    return f"transform(array({shared}), s -> s / (size({a}) + size({b}) - s))[0]"


def marked_rows(rows: DataFrame, chosen: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is among those of ``chosen``, and a few more: a filter by a bitmap of fixed size.

    The bitmap is a table of parts of 4 KB, at most 2 ** ``MAP_BITS`` / ``PART_BITS`` of them, so its broadcast is bounded. Rows of other keys
    that share a bit pass too; the join that follows drops them. No row of a key in ``chosen`` is lost.
    """
    bit = F.xxhash64(*key).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    parts = chosen.select(bit.alias("bit")).selectExpr(f"bit div {PART_BITS} AS _part", f"bit % {PART_BITS} AS at")
    maps = parts.groupBy("_part").agg(F.bitmap_construct_agg("at").alias("_bits"))
    set_ = "shiftright(cast(conv(hex(substring(_bits, cast(_bit % {0} div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1 = 1"
    met = rows.withColumn("_bit", bit).withColumn("_part", F.expr(f"_bit div {PART_BITS}")).join(F.broadcast(maps), "_part")
    return met.filter(F.expr(set_.format(PART_BITS))).drop("_bit", "_part", "_bits")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Benchmark items that a document holds: (doc_id, body, item_id, start, similarity), the best window of each.

    A window as long as an item holds it if their five-word shingles, counted with repeats, agree to ``similarity``.
    Such a window shares at least that part of the item's shingles, in any order. So shingles of all whole texts first meet
    the items' shingles map-side; only (document, item) pairs get windows, one at every start from which a window holds
    enough shared shingles. A window over a text's border starts where a shared shingle lies in its place in the item. Each window's SimHash is looked up in the multi-index of the
    items' fingerprints (``BLOCKS`` blocks, each allowed one differing bit, which finds all within ``RADIUS``),
    and every candidate is verified by the exact similarity.

    ``body`` is the hash of the text, so rows that repeat an id with other texts stay apart. Null and short texts and items
    of fewer than five words have no shingles and match nothing. Windows at a text's border are cut there. Repeated rows give one result.
    """
    marked = with_shingles(
        items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("_text")), "_text", "ish"
    )
    marked = marked.withColumn("n", F.size("ish")).withColumn("ifp", F.expr(simhash("ish")))
    known = stored(marked.drop("_text"), "benchmark-items").filter("n > 0")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"), F.xxhash64(text_column).alias("body")
    )
    # The outer form: for the inner one the optimizer would put a filter on the array below, and compute it anew there.
    shingled = with_shingles(rows, "_text", "sh").select("doc_id", "body", F.posexplode_outer("sh").alias("p", "h"))
    listed = small_side(known.select("item_id", "n", F.posexplode("ish").alias("j", "h")), ITEM_ROWS)
    met = shingled.join(listed, "h").groupBy("doc_id", "body", "item_id", "n").agg(
        F.array_sort(F.collect_set("p")).alias("at"), F.collect_set(F.col("p") - F.col("j")).alias("aligned")
    )
    met = met.withColumn("least", F.ceil(F.col("n") * similarity - 1e-9).cast("int")).filter("size(at) >= least")
    # From ``at[i] - n + 1`` on and up to a hit, the window holds that hit: ``least`` hits fit if the last one does.
    starts = (
        "flatten(transform(sequence(0, size(at) - least), i -> transform(array(greatest(at[i + least - 1] - n + 1, "
        "if(i = 0, at[i + least - 1] - n + 1, at[i - 1] + 1))), low -> if(low <= at[i], sequence(low, at[i]), array()))[0]))"
    )
    met = stored(met.withColumn("starts", F.expr(starts)), "benchmark-starts")
    windows = (
        met.select("doc_id", "body", "n", "aligned", F.explode("starts").alias("start"))
        .groupBy("doc_id", "body", "n", "start")
        .agg(F.max(F.expr("array_contains(aligned, start)")).alias("aligned"))
        .groupBy("doc_id", "body")
        .agg(F.collect_list(F.struct("start", "n", "aligned")).alias("windows"))
    )
    windows = stored(windows, "benchmark-windows")
    # Only texts with windows, and a few more that share a bit of the map, reach the join, at every size.
    likely = marked_rows(rows, windows, "doc_id", "body")
    held = likely.alias("d").join(windows.alias("w"), F.expr("d.doc_id <=> w.doc_id AND d.body = w.body"))
    held = with_shingles(held.select("d.doc_id", "d.body", "d._text", "w.windows"), "_text", "sh").drop("_text")
    cut = (
        held.withColumn("one", F.explode("windows"))
        .filter("one.aligned OR one.start BETWEEN 0 AND greatest(size(sh) - one.n, 0)")
        .selectExpr(
            "doc_id", "body", "one.start AS start", "one.n AS n",
            "slice(sh, greatest(one.start, 0) + 1, greatest(least(one.start + one.n, size(sh)) - greatest(one.start, 0), 0)) AS wsh",
        )
        .filter("size(wsh) > 0")
        .withColumn("wfp", F.expr(simhash("wsh")))
    )
    cut = stored(cut, "benchmark-prints")

    width = 64 // BLOCKS
    part = "shiftrightunsigned({0}, {1} * block) & {2}".format("{0}", width, (1 << width) - 1)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    wanted = cut.withColumn("block", blocks).withColumn("value", F.expr(part.format("wfp")))
    flips = F.array(F.lit(0), *[F.lit(1 << bit) for bit in range(width)])
    index = (
        known.withColumn("block", blocks)
        .withColumn("flip", F.explode(flips))
        .withColumn("value", F.expr(f"({part.format('ifp')}) ^ flip"))
        .select("item_id", "ish", "ifp", "n", "block", "value")
    )
    pairs = wanted.join(small_side(index, ITEM_ROWS), ["n", "block", "value"])
    # A pair is taken at the first block that lets it through, so that it is taken once.
    earlier = (
        f"exists(sequence(0, {BLOCKS - 1}), b -> b < block AND "
        f"bit_count(shiftrightunsigned(wfp ^ ifp, {width} * b) & {(1 << width) - 1}) <= {BLOCK_RADIUS})"
    )
    verified = (
        pairs.filter(F.expr(f"NOT {earlier} AND bit_count(wfp ^ ifp) <= {RADIUS}"))
        .withColumn("similarity", F.expr(weighted_similarity("wsh", "ish")))
        .filter(F.col("similarity") >= similarity)
    )
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back")))
    found = verified.groupBy("doc_id", "body", "item_id").agg(best.alias("best"))
    return found.select(
        "doc_id", "body", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents without a benchmark item; columns unchanged. Rows of equal id and text go or stay together."""
    found = contaminated(docs, items, id_column, text_column).select("doc_id", "body").distinct()
    found = stored(found, "benchmark-found")
    body = fresh(docs, "_body")
    marked = docs.withColumn(body, F.xxhash64(text_column)).alias("d")
    match = F.expr(f"d.`{id_column}` <=> f.doc_id AND d.`{body}` = f.body")
    return marked.join(found.alias("f"), match, "left_anti").select(own_columns(docs))
