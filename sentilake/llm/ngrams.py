"""Vectorised words and word n-gram hashes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []

SPACE, PUNCTUATION, WORD = 0, 1, 2


def byte_classes(split_punctuation: bool) -> np.ndarray:
    """Class of each UTF-8 byte. Space, tab to return, and if asked for, ASCII punctuation as a class of its own."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    if split_punctuation:
        kinds[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = PUNCTUATION
    return kinds


def ascii_folding() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts, about ``limit`` bytes at a time: first row, end row, bytes, offsets. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one class, white space left out: start, end, row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = kinds[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    inner = offsets[:-1]
    change[inner[inner < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    kept = kind[starts] != SPACE
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of one running polynomial sum."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])
