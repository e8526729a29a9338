"""Terms of token arrays, looked up and counted within a row: no row per term, no grouping of a partition's terms."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tasks' functions travel by value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that a task looks at in one go; more where counts are combined.
CHUNK, COMBINED = 1 << 18, 1 << 20
WORD_TYPE = "array<struct<position:int,word:string,predicted_label:string,positive:double,negative:double>>"


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of lists with at most so many elements; a longer list is a run of its own."""
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
        yield start, end
        start = end


def _kept_tokens(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(list, token) of all tokens of two and more characters."""
    owner = np.repeat(np.arange(len(lists)), _sizes(lists))
    tokens = lists.flatten()
    long = pc.fill_null(pc.greater_equal(pc.utf8_length(tokens), 2), False)
    return owner[long.to_numpy(zero_copy_only=False)], tokens.filter(long)


# ---- class scores ----------------------------------------------------------------------------


def _term_index(terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, single, pairs, at): the place of a term by its whole text, and by each pair of texts that a space of it parts."""
    texts = terms.to_pylist()
    parted = [(t[:i], t[i + 1 :], n) for n, t in enumerate(texts) for i, c in enumerate(t) if c == " "]
    words = sorted({*texts, *(x[0] for x in parted), *(x[1] for x in parted)})
    number = {w: i for i, w in enumerate(words)}
    single = np.full(len(words) + 1, -1, np.int64)
    single[[number[t] for t in texts]] = np.arange(len(texts))
    pairs = np.array([number[a] * len(words) + number[b] for a, b, _ in parted], np.int64)
    order = np.argsort(pairs)
    return pa.array(words, pa.string()), single, pairs[order], np.array([n for *_, n in parted], np.int64)[order]


def _known_terms(index: tuple, lists: pa.Array, ngram_max: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, place of the term) of every occurrence of a known term."""
    words, single, pairs, at = index
    owner, tokens = _kept_tokens(lists)
    # An unknown word has the last number, which stands for no term.
    number = pc.fill_null(pc.index_in(tokens, value_set=words), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
    found = single[number]
    owners, places = [owner[found >= 0]], [found[found >= 0]]
    if ngram_max > 1 and len(pairs):
        beside = (owner[:-1] == owner[1:]) & (number[:-1] < len(words)) & (number[1:] < len(words))
        key = number[:-1][beside] * len(words) + number[1:][beside]
        where = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = pairs[where] == key
        owners.append(owner[:-1][beside][hit])
        places.append(at[where[hit]])
    return np.concatenate(owners), np.concatenate(places)


def _class_scores(state: Broadcast, ngram_max: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, idf, weights, intercepts = state.value
        for rows in batches:
            units = rows.flatten()
            out = np.tile(intercepts, (len(units), 1))
            for start, end in _chunks(_sizes(units)):
                owner, place = _known_terms(index, units.slice(start, end - start), ngram_max)
                if not len(owner):
                    continue
                entry, count = np.unique(owner * len(idf) + place, return_counts=True)
                owner, place = entry // len(idf), entry % len(idf)
                x = count * idf[place]
                norm = np.sqrt(np.bincount(owner, x * x, end - start))
                some = norm > 0
                for c in range(weights.shape[1]):
                    out[start:end, c][some] += np.bincount(owner, x * weights[place, c], end - start)[some] / norm[some]
            each = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))
            ends = np.concatenate([[0], np.cumsum(_sizes(rows))]).astype(np.int32)
            yield pa.ListArray.from_arrays(ends, each)

    return run


def class_scores(
    context: SparkContext, token_lists: Column, weights: DataFrame, intercepts: tuple[float, ...], ngram_max: int = 2
) -> Column:
    """Class scores of every token list of a row: array<array<string>> to array<array<double>>.

    ``weights`` is (term, idf, w) and must be small: it goes to every task. A list without a known term has the intercepts.
    """
    table = weights.select("term", "idf", "w").toArrow()
    terms = table["term"].combine_chunks()
    matrix = table["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), len(intercepts))
    idf = table["idf"].to_numpy().astype(float)
    state = context.broadcast((_term_index(terms), idf, matrix, np.array(intercepts, float)))
    return F.arrow_udf(_class_scores(state, ngram_max), "array<array<double>>")(token_lists)


# ---- document and corpus frequency ---------------------------------------------------------------


def _counted(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, lists that hold it, occurrences) of each number."""
    names, place, tf = np.unique(number, return_inverse=True, return_counts=True)
    held = np.unique(owner * max(len(names), 1) + place) % max(len(names), 1)
    return names, np.bincount(held, minlength=len(names)), tf


def _frequencies(
    every: str, ngram_min: int, ngram_max: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(terms: pa.Array, df: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        counts = [pa.array(x.astype(np.int64)) for x in (df, tf)]
        return pa.RecordBatch.from_arrays([terms.cast(pa.string()), *counts], ["term", "d", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            yield made(pa.array([every]), np.array([len(lists) - lists.null_count]), np.zeros(1))
            for start, end in _chunks(_sizes(lists), COMBINED):
                owner, tokens = _kept_tokens(lists.slice(start, end - start))
                coded = tokens.dictionary_encode()
                words, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if ngram_min == 1 and len(number):
                    names, df, tf = _counted(owner, number)
                    yield made(words.take(pa.array(names)), df, tf)
                if ngram_max == 2 and len(number) > 1:
                    beside = owner[:-1] == owner[1:]
                    pairs = number[:-1][beside] * len(words) + number[1:][beside]
                    names, df, tf = _counted(owner[:-1][beside], pairs)
                    first, second = (words.take(pa.array(x)) for x in (names // len(words), names % len(words)))
                    yield made(pc.binary_join_element_wise(first, second, " "), df, tf)

    return run


def term_frequencies(tokens: DataFrame, every: str, ngram_min: int, ngram_max: int) -> DataFrame:
    """(term, d, c): lists that hold a term and its occurrences, combined within a task as far as it reads at once.

    ``tokens`` has one column of token lists. The number of lists stands beside the term ``every``.
    """
    return tokens.mapInArrow(_frequencies(every, ngram_min, ngram_max), "term string, d long, c long")


# ---- words -----------------------------------------------------------------------------------


def _word_entries(state: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, seen = state.value
        for rows in batches:
            sizes, tokens = _sizes(rows), rows.flatten()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            position = np.arange(len(tokens)) - np.repeat(ends[:-1], sizes)
            at = pc.fill_null(pc.index_in(tokens, value_set=words), len(words))
            fields = {"position": pa.array(position.astype(np.int32)), "word": tokens} | {c: v.take(at) for c, v in seen.items()}
            yield pa.ListArray.from_arrays(ends.astype(np.int32), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return run


def word_entries(context: SparkContext, tokens: Column, words: DataFrame) -> Column:
    """What a small table (term, predicted_label, positive, negative) says of each token of an array, as ``WORD_TYPE``.

    The one row without a term holds for unknown words.
    """
    table = words.orderBy(F.col("term").asc_nulls_last()).toArrow()
    seen = {c: table[c].combine_chunks() for c in ("predicted_label", "positive", "negative")}
    state = context.broadcast((table["term"].combine_chunks().drop_null(), seen))
    return F.arrow_udf(_word_entries(state), WORD_TYPE)(tokens)
