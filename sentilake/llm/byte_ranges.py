"""Coalesced byte-range reads of index entries, on any file system that Arrow opens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """``file:/x`` and bare paths as well as full addresses."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def coalesced(entries: Iterator[tuple], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[list[tuple]]:
    """Group sorted entries (path, offset, length, ...) to reads of at most ``most`` bytes; a longer one is read alone."""
    held: list[tuple] = []
    end = 0
    for entry in entries:
        path, offset, length = entry[:3]
        if held and (path != held[0][0] or offset - end > gap or offset + length - held[0][1] > most):
            yield held
            held = []
        end = max(end, offset + length) if held else offset + length
        held.append(entry)
    if held:
        yield held


def read_entries(entries: Iterator[tuple], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[list[tuple]]:
    """Each read's entries with their bytes: lists of (entry, bytes)."""
    opened, file = None, None
    try:
        for held in coalesced(entries, gap, most):
            if held[0][0] != opened:
                if file is not None:
                    file.close()
                system, inner = file_system(held[0][0])
                opened, file = held[0][0], system.open_input_file(inner)
            start = held[0][1]
            data = file.read_at(max(e[1] + e[2] for e in held) - start, start)
            yield [(e, data[e[1] - start : e[1] - start + e[2]]) for e in held]
    finally:
        if file is not None:
            file.close()


def by_region(entries: DataFrame, columns: list[str], region_bytes: int = 2 * READ_BYTES) -> DataFrame:
    """Deal index entries to tasks by file and byte region, sorted by offset. Tasks follow the bytes to read, not the entries."""
    total = entries.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(1, -(-total // region_bytes)) + 7, 100_000)
    region = F.floor(F.col("offset") / region_bytes)
    dealt = entries.withColumn("_region", region).repartition(int(tasks), "path", "_region")
    return dealt.sortWithinPartitions("path", "offset").select(*columns)
