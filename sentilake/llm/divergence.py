"""How far the sources of a language differ in their terms: joint walks over quadtrees of the group-term matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm.common import bounded_batches, passing_tables, small_side, stored
from sentilake.llm.word_spans import byte_kinds, words_of

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000

#: A tile of the matrix holds this many groups, and about this many terms.
ROWS, COLUMNS = 32, 1024
#: Groups are broadcast up to this count, about 10 MB; beyond it the joins shuffle.
GROUP_LIMIT = 100_000
#: (group, term) rows that a task gathers before it hands them on.
GATHERED = 1 << 20

# Terms are runs of ASCII letters and of all code points beyond ASCII.
_KINDS = byte_kinds("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
_CELLS = ["lang", "source", "term"]


def _summed(tables: list[pa.Table]) -> pa.Table:
    return (
        pa.concat_tables(tables)
        .group_by(_CELLS, use_threads=False)
        .aggregate([("n", "sum"), ("docs", "sum")])
        .rename_columns([*_CELLS, "n", "docs"])
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        lang_of, source_of = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        group_of = lang_of * len(sources.dictionary) + source_of
        for w in words_of(batch.column("text"), _KINDS):
            # Per document first, as a document counts once for a term; then per group.
            row = pa.array(w.rows, pa.int64())
            of_doc = pa.table([row, pa.array(w.codes)], names=["row", "code"]).group_by(["row", "code"], use_threads=False)
            of_doc = of_doc.aggregate([([], "count_all")])
            group = pa.array(group_of[w.first + of_doc["row"].to_numpy()])
            cells = pa.table([group, of_doc["code"], of_doc["count_all"]], names=["group", "code", "n"])
            cells = cells.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            groups = cells["group"].to_numpy()
            waiting.append(
                pa.table(
                    [
                        langs.dictionary.take(pa.array(groups // max(len(sources.dictionary), 1))),
                        sources.dictionary.take(pa.array(groups % max(len(sources.dictionary), 1))),
                        w.terms.take(cells["code"]),
                        cells["n_sum"],
                        cells["n_count"],
                    ],
                    names=[*_CELLS, "n", "docs"],
                )
            )
            held += len(groups)
            if held >= GATHERED:
                waiting = [_summed(waiting)]
                held = len(waiting[0])
                if held >= GATHERED // 2:
                    yield from waiting[0].to_batches(max_chunksize=1 << 16)
                    waiting, held = [], 0
    if waiting:
        yield from _summed(waiting).to_batches(max_chunksize=1 << 16)


def _share(count: str, total: str, terms: str) -> Column:
    """p = 1 + floor(10^9 (count + 1) / (total + terms)), exact beyond 64 bits."""
    return F.expr(
        f"1L + cast(cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) "
        f"div cast(greatest({total} + {terms}, 1) as decimal(20,0)) as bigint)"
    )


def _distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q). Shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def kept_terms(texts: DataFrame, least: int) -> DataFrame:
    """Cells of the terms kept: (lang, source, term, n, total, first).

    ``total`` is the term's count in the language, ``first`` marks one row of each term. Counts are summed within
    tasks first; all cells of a term then meet once, by (lang, term), for both sums.
    """
    raw = texts.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    cells = raw.repartition("lang", "term").groupBy(*_CELLS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        cells.withColumn("total", F.sum("n").over(of_term))
        .withColumn("df", F.sum("docs").over(of_term))
        .withColumn("first", F.col("source") == F.min("source").over(of_term))
        .filter(F.col("df") >= least)
        .select(*_CELLS, "n", "total", "first")
    )


def group_table(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """All groups, also those without terms: (lang, source, g, groups, n, lang_n, terms, p0).

    ``g`` numbers a language's groups, ``p0`` is a group's share of any term that it does not hold.
    """
    sums = cells.groupBy("lang", "source").agg(
        F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("terms")
    )
    every = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    every = every.fillna(0, ["n", "terms"])
    whole = Window.partitionBy("lang")
    return (
        every.withColumn("lang_n", F.sum("n").over(whole))
        .withColumn("terms", F.sum("terms").over(whole))
        .withColumn("groups", F.count(F.lit(1)).over(whole))
        .withColumn("g", (F.row_number().over(whole.orderBy("source")) - 1).cast("long"))
        .withColumn("p0", _share("0", "n", "terms"))
    )


def _pyramid(nonzero: np.ndarray) -> list[np.ndarray]:
    """A quadtree as one bit matrix per level, leaves first: a node is set if any cell under it is."""
    levels = [nonzero]
    while max(levels[-1].shape) > 1:
        below = levels[-1]
        rows, columns = below.shape
        even = np.zeros((rows + rows % 2, columns + columns % 2), bool)
        even[:rows, :columns] = below
        levels.append(even[0::2, 0::2] | even[0::2, 1::2] | even[1::2, 0::2] | even[1::2, 1::2])
    return levels


def joint_leaves(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells at which a pair of groups is not zero on both sides: (group of a, group of b, term).

    ``a`` and ``b`` are bit matrices of groups by terms of equal shape. Both quadtrees are walked together from their roots; a
    pair of quadrants without a bit on either side is left, with all pairs of groups under it. With ``same``, pairs are a < b.
    """
    trees = _pyramid(a), _pyramid(b)
    i = j = k = np.zeros(1, np.int64)
    if not (trees[0][-1][0, 0] or trees[1][-1][0, 0]):
        i = j = k = np.zeros(0, np.int64)
    for level in range(len(trees[0]) - 2, -1, -1):
        x, y = trees[0][level], trees[1][level]
        steps = np.array(np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij")).reshape(3, 8)
        i, j, k = ((2 * at[:, None] + step[None, :]).ravel() for at, step in zip((i, j, k), steps, strict=True))
        inside = (i < x.shape[0]) & (j < y.shape[0]) & (k < x.shape[1])
        if same:
            inside &= (i <= j) if level else (i < j)
        i, j, k = i[inside], j[inside], k[inside]
        live = x[i, k] | y[j, k]
        i, j, k = i[live], j[live], k[live]
    if same and len(trees[0]) == 1:
        i = j = k = np.zeros(0, np.int64)
    return i, j, k


def _tile_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of one tile, or of a pair of tiles of the same terms, for each pair of groups."""
    lang, _, first, second = (x.as_py() for x in key)
    terms = rows["term"].combine_chunks().dictionary_encode()
    codes = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False)
    g, p = rows["g"].to_numpy(), rows["p"].to_numpy()
    width = max(len(terms.dictionary), 1)
    shares, bits, numbers = [], [], []
    for tile in (first, second):
        mine = g // ROWS == tile
        heads = mine & (codes < 0)
        numbers.append(np.sort(g[heads]))
        share = np.ones((ROWS, width), np.int64)
        share[g[heads] - tile * ROWS] = p[heads][:, None]
        bit = np.zeros((ROWS, width), bool)
        cells = mine & (codes >= 0)
        at = g[cells] - tile * ROWS, codes[cells]
        share[at], bit[at] = p[cells], True
        shares.append(share)
        bits.append(bit)
    i, j, k = joint_leaves(bits[0], bits[1], first == second)
    p, q = shares[0][i, k], shares[1][j, k]
    square = (p - q) * (p - q)
    pair = i * ROWS + j
    sums = np.zeros((3, ROWS * ROWS), np.int64)
    for out, values in zip(sums, (np.ones(len(pair), np.int64), square // q, square // p), strict=True):
        np.add.at(out, pair, values)
    a, b = (x.ravel() for x in np.meshgrid(numbers[0], numbers[1], indexing="ij"))
    a, b = (a[a < b], b[a < b]) if first == second else (a, b)
    at = (a - first * ROWS) * ROWS + (b - second * ROWS)
    names = ["lang", "a", "b", "leaves", "ab", "ba"]
    return pa.table([pa.array([lang] * len(a), pa.string()), a, b, *[s[at] for s in sums]], names=names)


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of groups of a language: (lang, source, item, value).

    The matrix is cut into tiles of ``ROWS`` groups and about ``COLUMNS`` terms (by hash); a task walks the quadtrees
    of one tile or of two tiles of the same terms. Terms that neither group holds are never visited: they all add the
    same value, so their number is priced at the end.
    """
    small = small_side(groups, GROUP_LIMIT)
    tiles = F.greatest(F.ceil(F.col("terms") / COLUMNS), F.lit(1))
    chosen = ["lang", "g", "groups", F.lit(None).cast("string").alias("term")]
    heads = groups.select(*chosen, F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    held = cells.join(small.withColumnRenamed("n", "group_n"), ["lang", "source"]).select(
        "lang", "g", "groups", "term", _share("n", "group_n", "terms").alias("p"),
        F.pmod(F.xxhash64("term"), tiles).alias("tile"),
    )
    mine, others = F.expr(f"g div {ROWS}"), F.expr(f"(groups - 1) div {ROWS}")
    dealt = (
        held.unionByName(heads)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others)))
        .select("lang", "tile", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), "g", "term", "p")
    )
    sums = dealt.groupBy("lang", "tile", "low", "high").applyInArrow(
        _tile_sums, "lang string, a long, b long, leaves long, ab long, ba long"
    )
    exact = "decimal(38,0)"
    pairs = sums.groupBy("lang", "a", "b").agg(
        F.sum("leaves").alias("leaves"), F.sum(F.col("ab").cast(exact)).alias("ab"), F.sum(F.col("ba").cast(exact)).alias("ba")
    )
    for side in ("a", "b"):
        named = [F.col(was).alias(name) for was, name in (("g", side), ("source", f"{side}_source"), ("p0", f"{side}_p"))]
        pairs = pairs.join(small.select("lang", *named, *(["terms"] if side == "a" else [])), ["lang", side])
    zeros = F.expr("cast(terms - leaves as decimal(20,0))")

    def ordered(one: str, two: str) -> Column:
        value = F.col(f"{one}{two}") + zeros * _distance(f"{one}_p", f"{two}_p").cast("decimal(20,0)")
        return F.struct(
            F.col(f"{one}_source").alias("source"), F.col(f"{two}_source").alias("item"), value.cast("long").alias("value")
        )

    return pairs.select("lang", F.inline(F.array(ordered("a", "b"), ordered("b", "a"))))


def term_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms that a group uses more than its language: (lang, source, item, value)."""
    small = small_side(groups, GROUP_LIMIT).select("lang", "source", F.col("n").alias("group_n"), "lang_n", "terms")
    shares = cells.join(small, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "group_n", "terms").alias("p"), _share("total", "lang_n", "terms").alias("q")
    )
    return shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))


def audit_sources(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """Divergence of each (lang, source) group from all others of its language, and the terms that set it apart.

    Returns (lang, source, part, item, value, rank). Part ``pair``: item is another source of the language, all ranks.
    Part ``term``: item is a term that the group uses more than its language does, ranks to ``top``. Terms count if
    ``least`` documents (rows) of the language hold them. Null text, language and source are read as ''. Ties in value go by
    item in byte order. Repeated rows count as often as they stand there, an empty table gives no row, other columns
    do not matter. A language with one source has no pair; one without terms has pairs of value 0.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    with passing_tables(docs.sparkSession) as keep:
        cells = keep(kept_terms(texts, least), "divergence-cells")
        groups = keep(group_table(texts, cells), "divergence-groups")
        ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
        columns = ["lang", "source", "part", "item", "value", F.row_number().over(ranked).alias("rank")]
        pairs = pair_values(cells, groups).withColumn("part", F.lit("pair")).select(*columns)
        terms = term_values(cells, groups).withColumn("part", F.lit("term")).select(*columns).filter(F.col("rank") <= top)
        return stored(pairs.unionByName(terms), "divergence")
