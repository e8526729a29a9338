"""Phrase collocations by top-order marginalisation: padded longest windows, summed by ROLLUP."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentilake.llm import ngrams
from sentilake.llm.common import bounded_batches, passing_tables, stored
from sentilake.llm.word_spans import Words, byte_kinds, words_of

ORDER = 4
LEAST = 30
COVERED = 80
TOP = 2000
NO_LANGUAGE = "und"
SCALE = 2_000_000

#: N-grams are first counted by slots, bits of their hash: BUCKET_BITS name the bucket that a slot is dealt by, SLOT_BITS the
#: slot within it. A map of the frequent ones has 2 ** MAP_BITS bits (4 MB).
BUCKET_BITS, SLOT_BITS = 12, 32
MAP_BITS = 25
#: Slots that a task gathers before it hands them on.
GATHERED = 1 << 22
#: Rows of one bitmap part, as ``bitmap_construct_agg`` makes them.
PART_BITS = 32768
SALTS = 16

_KINDS = byte_kinds("\x20\x09", ".,;:!?\x0a\x0b\x0c\x0d")
_NAMES = [f"w{n}" for n in range(1, ORDER + 1)]


def _term_hashes(terms: pa.Array) -> np.ndarray:
    _, where, body = terms.buffers()
    offsets = np.frombuffer(where, np.int32, len(terms) + 1, terms.offset * 4).astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return ngrams.span_hashes(data, offsets[:-1], offsets[1:])


def _grow(hashes: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are one word longer."""
    return ngrams.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + follower)


class _Run:
    """Words of a run of whole texts, with the n-grams that start at each."""

    def __init__(self, langs: pa.DictionaryArray, w: Words):
        self.languages, self.terms, self.codes = langs.dictionary, w.terms, w.codes
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[w.first + w.rows]
        self._pieces = w.pieces
        self._words = _term_hashes(w.terms)[w.codes]
        self._langs = _term_hashes(langs.dictionary.cast(pa.string()))[self.lang]

    def within(self, size: int) -> np.ndarray:
        """Does the n-gram that starts here end within the piece?"""
        out = np.zeros(len(self.codes), bool)
        left = max(len(self.codes) - size + 1, 0)
        out[:left] = self._pieces[size - 1 :] == self._pieces[:left]
        return out

    def slots(self, size: int) -> np.ndarray:
        """Bits of a hash of language and words of the n-gram that starts here (of nothing, where none does)."""
        hashes = _grow(self._langs, self._words)
        for k in range(1, size):
            follower = np.zeros_like(self._words)
            follower[: max(len(follower) - k, 0)] = self._words[k:]
            hashes = _grow(hashes, follower)
        return hashes >> np.uint64(64 - BUCKET_BITS - SLOT_BITS)

    def frequent(self, size: int, maps: list[bytes]) -> np.ndarray:
        """Can the n-gram that starts here be frequent?"""
        bits = np.frombuffer(maps[size - 1], np.uint8)
        at = (self.slots(size) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        return self.within(size) & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _both(parts: np.ndarray) -> np.ndarray:
    """The part that starts here and the one that starts at the next word."""
    return parts & np.append(parts[1:], False)


def _runs(batch: pa.RecordBatch) -> Iterator[_Run]:
    langs = batch.column("lang").dictionary_encode()
    for w in words_of(batch.column("text"), _KINDS):
        if len(w.codes):
            yield _Run(langs, w)


def _merged(found: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots ascending with their counts. Counts stop at ``least``: only whether a sum reaches it matters."""
    slots, at = np.unique(np.concatenate([s for s, _ in found]), return_inverse=True)
    return slots, np.minimum(np.bincount(at, np.concatenate([n for _, n in found])), least).astype(np.int64)


def _packed(slots: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """One row for each bucket: its slots and their counts as short arrays."""
    bucket = (slots >> np.uint64(SLOT_BITS)).astype(np.int32)
    names, firsts = np.unique(bucket, return_index=True)
    offsets = pa.array(np.append(firsts, len(slots)), pa.int32())
    low = (slots & np.uint64((1 << SLOT_BITS) - 1)).astype(np.uint32).view(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((low, pa.int32()), (counts, kind))]
    return pa.RecordBatch.from_arrays([pa.array(names), *lists], ["bucket", "slot", "n"])


def _slot_batches(
    size: int, least: int, maps: Broadcast[list[bytes]], kind: pa.DataType
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for words in _runs(batch):
                chosen = words.within(size)
                if size > 1:
                    # An n-gram can only be frequent if both n-grams in it that are a word shorter are.
                    chosen &= _both(words.frequent(size - 1, maps.value))
                found.append(np.unique(words.slots(size)[chosen], return_counts=True))
                held += len(found[-1][0])
                if held >= GATHERED:
                    found = [_merged(found, least)]
                    held = len(found[0][0])
                    if held >= GATHERED // 2:
                        yield _packed(*found[0], kind)
                        found, held = [], 0
        if found:
            yield _packed(*_merged(found, least), kind)

    return run


def _window_batches(maps: Broadcast[list[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _runs(batch):
                columns = {"lang": pa.array(words.lang)}
                alive = np.ones(len(words.codes), bool)
                for k, name in enumerate(_NAMES):
                    # The k-th lead column: null from where the n-gram up to it leaves the piece or cannot be frequent.
                    if k < len(maps.value):
                        alive = alive & words.frequent(k + 1, maps.value)
                    else:
                        alive = alive & _both(words.frequent(k, maps.value))
                    lead = np.zeros(len(alive), words.codes.dtype)
                    lead[: max(len(alive) - k, 0)] = words.codes[k:]
                    columns[name] = pa.array(lead, mask=~alive)
                counted = pa.table(columns).group_by(["lang", *_NAMES], use_threads=False).aggregate([([], "count_all")])
                arrays = [words.languages.take(counted["lang"]), *[words.terms.take(counted[name]) for name in _NAMES]]
                out = pa.table([*arrays, counted["count_all"]], names=["lang", *_NAMES, "n"])
                yield from out.to_batches(max_chunksize=1 << 16)

    return run


def _frequent_map(texts: DataFrame, size: int, least: int, maps: Broadcast[list[bytes]]) -> bytes:
    """A bitmap of fixed length that holds every n-gram of ``size`` words that occurs ``least`` times or more.

    N-grams of one slot are counted together and slots share bits, so a rare one may be in it; a frequent one is never missing.
    Slots are summed within a task, and travel as arrays by bucket, as one row each would take twice the room.
    """
    count, kind = ("tinyint", pa.int8()) if least < 128 else ("int", pa.int32())
    schema = f"bucket int, slot array<int>, n array<{count}>"
    packed = texts.mapInArrow(_slot_batches(size, least, maps, kind), schema).repartition("bucket")
    slots = packed.select("bucket", F.inline(F.arrays_zip("slot", "n")))
    bit = F.expr(f"slot & {(1 << MAP_BITS) - 1}")
    parts = (
        slots.groupBy("bucket", "slot")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
        .select((bit / PART_BITS).cast("int").alias("part"), (bit % PART_BITS).cast("long").alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = bytearray(1 << (MAP_BITS - 3))
    for row in parts.toLocalIterator():  # at most 2 ** MAP_BITS / PART_BITS rows of 4 KB
        out[row.part * PART_BITS // 8 : (row.part + 1) * PART_BITS // 8] = row.bits
    return bytes(out)


def longest_windows(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """Every word position as a window of itself and its three leads, counted: (lang, w1 .. w4, n).

    A lead is null from where the piece ends or the n-gram up to it cannot be frequent; a word that cannot be frequent
    is null itself and only adds to the language's number of words. Which words, pairs of such words and triples of such
    pairs can be frequent, three passes of hash counts find before.
    """
    if least < 1:
        raise ValueError("least must be positive")
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text"))
    maps = context.broadcast([])
    for size in range(1, ORDER):
        maps = context.broadcast([*maps.value, _frequent_map(texts, size, least, maps)])
    columns = ", ".join(f"{name} string" for name in ["lang", *_NAMES])
    windows = texts.mapInArrow(_window_batches(maps), f"{columns}, n long")
    return windows.groupBy("lang", *_NAMES).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int = LEAST) -> DataFrame:
    """Occurrences of words and phrases: (lang, size, w1 .. w4, f).

    Size 0 counts all words of a language, size 1 to 4 those words and phrases that occur ``least`` times or more.
    ROLLUP sums the longest windows to all their prefixes; sums that end in padding are no phrase and go.
    """
    summed = windows.rollup("lang", *_NAMES).agg(F.sum("n").alias("f"), F.grouping_id().alias("_rolled"))
    # n rolled columns are the lowest n bits of the grouping id.
    size = (F.lit(ORDER) - F.bit_count("_rolled")).cast("int")
    last = F.coalesce(*[F.when(size == k, F.col(f"w{k}")) for k in range(1, ORDER + 1)])
    kept = ((size == 0) | (last.isNotNull() & (F.col("f") >= least))) & (size >= 0)
    return summed.filter(kept).select("lang", size.alias("size"), *_NAMES, "f")


def _part(first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("ws", first, length), " ")


def candidates(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest cut: (lang, phrase, a, l, r, score).

    A cut leaves a first part and a rest. Both are at least as frequent as the phrase, so both are in ``counts``.
    Frequent single words begin or end many phrases; their rows are copied ``SALTS`` times and met by a part of the phrases each.
    """
    known = counts.filter("size > 0").select("lang", "size", "f", F.array_compact(F.array(*_NAMES)).alias("ws"))
    known = known.withColumn("phrase", F.array_join("ws", " "))
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = known.select("lang", F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = (
        known.filter("size > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .select(
            "lang", "phrase", F.col("f").alias("a"), "k",
            _part(1, F.col("k")).alias("left"), F.when(F.col("k") == 1, salt).otherwise(0).alias("left_salt"),
            _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
            F.when(F.col("size") - F.col("k") == 1, salt).otherwise(0).alias("rest_salt"),
        )
    )
    left = parts.select("lang", F.col("part").alias("left"), F.col("salt").alias("left_salt"), F.col("f").alias("l"))
    rest = parts.select("lang", F.col("part").alias("rest"), F.col("salt").alias("rest_salt"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "left", "left_salt"]).join(rest, ["lang", "rest", "rest_salt"])
    # Decimals of 38 digits: the product passes 64 bits on large tables.
    score = F.expr(f"cast(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0)) as bigint)")
    return (
        met.groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def covered_phrases(counts: DataFrame, covered: int) -> DataFrame:
    """Per phrase, the most that a longer frequent phrase around it occurs: (lang, phrase, longer)."""
    longer = counts.filter("size > 2").select("lang", "size", "f", F.array_compact(F.array(*_NAMES)).alias("ws"))
    inner = []
    for size in range(3, ORDER + 1):
        for length in range(2, size):
            inner += [F.when(F.col("size") == size, _part(first, length)) for first in range(1, size - length + 2)]
    parts = longer.select("lang", "f", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
) -> DataFrame:
    """The best phrases of two to four words per language: (lang, rank, phrase, a, l, r, n, score).

    A-Z in lower case; pieces end at ``. , ; : ! ?`` and line breaks, words at space and tab. A null text is
    empty, a null language is ``und``. A phrase takes part with ``a`` >= ``least`` occurrences. Its score is the lowest
    floor(2000000 a / (l + r)) over its cuts into two parts. Phrases go that stand in a longer one with
    ``covered`` per cent of their occurrences or more. Ranks: score, then ``a``, then the phrase in byte order.
    Repeated rows count as often as they stand there; an empty table has no phrase; other columns do not matter.
    """
    with passing_tables(docs.sparkSession) as keep:
        windows = keep(longest_windows(docs, text, lang, least), "phrase-windows")
        counts = keep(phrase_counts(windows, least), "phrase-counts")
        names = ["lang", "phrase"]
        found = candidates(counts).join(covered_phrases(counts, covered), names, "left")
        free = F.col("longer").isNull() | F.expr(
            f"cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(covered)}"
        )
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
        # One language may hold nearly all phrases: its best are found in salted parts first.
        part = F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS))
        best = (
            found.filter(free)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
            .filter(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= top)
        )
        sizes = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
        out = best.join(sizes, "lang").select("lang", F.col("rank").cast("int"), "phrase", "a", "l", "r", "n", "score")
        return stored(out, "phrases")
