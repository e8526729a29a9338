"""Words of Arrow text columns as exact dictionary codes, a bounded run of whole texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sentilake.llm import ngrams

#: Bytes of text that are taken together; a longer text is taken alone.
CHUNK_BYTES = 8 << 20


@dataclass(frozen=True)
class Words:
    """The words of a run of rows, in order.

    ``rows`` and ``pieces`` say where each word stands, ``codes`` index the distinct words in ``terms``.
    """

    first: int
    end: int
    rows: np.ndarray
    pieces: np.ndarray
    codes: np.ndarray
    terms: pa.Array


def byte_kinds(blank: str, breaks: str = "") -> np.ndarray:
    """Class of every byte: ``blank`` separates words, ``breaks`` (ASCII) pieces too, all else stands in words."""
    kinds = np.full(256, ngrams.WORD, np.uint8)
    kinds[[ord(c) for c in blank]] = ngrams.SPACE
    kinds[[ord(c) for c in breaks]] = ngrams.PUNCTUATION
    return kinds


def words_of(texts: pa.Array, kinds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of whole texts with A-Z in lower case. Null counts as empty.

    The distinct words are found by Arrow's dictionary encoding, so equal codes mean equal words, never equal hashes.
    """
    fold = ngrams.ascii_folding()
    for first, end, raw, offsets in ngrams.chunks(texts, limit):
        starts, ends, rows = ngrams.spans(raw, offsets, kinds)
        if len(starts):
            of_word = kinds[raw[starts]] == ngrams.WORD
        else:
            of_word = np.zeros(0, bool)
        # A break span or another row begins a new piece.
        pieces = np.cumsum(~of_word)[of_word] + rows[of_word]
        starts, ends, rows = starts[of_word], ends[of_word], rows[of_word]
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        body = fold[raw[kinds[raw] == ngrams.WORD]]
        plain = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
        encoded = plain.dictionary_encode()
        yield Words(first, end, rows, pieces, encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.cast(pa.string()))
