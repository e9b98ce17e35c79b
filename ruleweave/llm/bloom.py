"""Bloom filters of bounded size, folded by tasks and merged in segments.

Two bit arrays are folded: positions that were set ("seen"), and that were set twice ("again"). A key
that occurs twice has all its positions in "again"; others may have by chance, so a filter beyond its
load passes more keys but never misses one. A task sends a segment as its set positions or as bits,
whichever is shorter: 6 bytes a key at most. Segments of many tasks are merged in two steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_tasks, partition

#: Bits a key, and the most bits of a filter (32 MiB), which bounds the broadcast at every input size.
BITS_PER_KEY, MAX_BITS = 16, 1 << 28
#: Filters are merged in segments of so many bytes, whose positions are 16-bit numbers.
SEGMENT = 1 << 13
SCHEMA = "segment long, part int, seen binary, again binary"

#: From a batch, one row of bit positions for each key.
Positions = Callable[[pa.RecordBatch, int], np.ndarray]


def bits_for(keys: int, most: int | None = None) -> int:
    bits = 1 << 13
    while bits < min(most or MAX_BITS, BITS_PER_KEY * keys):
        bits <<= 1
    return bits


def held(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each key whether all its positions are set."""
    return ((array[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def packed(part: np.ndarray) -> bytes:
    """A segment: its set positions if they are shorter than its bits."""
    at = np.flatnonzero(np.unpackbits(part, bitorder="little"))
    return at.astype(np.uint16).tobytes() if 2 * len(at) < len(part) else part.tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8)
    out, at = np.zeros(size, np.uint8), np.frombuffer(data, np.uint16)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def _fold(positions: Positions, bits: int, parts: int, twice: bool):
    def run(batches):
        seen, again = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3 if twice else 0, np.uint8)
        for batch in batches:
            for at in positions(batch, bits).T:
                at, n = np.unique(at, return_counts=True)
                mask = (1 << (at & 7)).astype(np.uint8)
                if twice:
                    both = (n > 1) | ((seen[at >> 3] & mask) > 0)
                    np.bitwise_or.at(again, at[both] >> 3, mask[both])
                np.bitwise_or.at(seen, at >> 3, mask)
        step, part = min(SEGMENT, len(seen)), partition() % parts
        full = np.flatnonzero(seen.reshape(-1, step).any(axis=1))
        for some in np.array_split(full, -(-len(full) // 256)) if len(full) else ():
            cut = lambda x: pa.array([packed(x[i * step : (i + 1) * step]) for i in some], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([part] * len(some), pa.int32()), cut(seen), cut(again) if twice else pa.nulls(len(some), pa.binary())], ["segment", "part", "seen", "again"])

    return run


def _merge(bits: int):
    size = min(SEGMENT, bits >> 3)

    def run(table: pa.Table) -> pa.Table:
        seen, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        twice = table["again"].null_count == 0
        for a, b in zip(table["seen"], table["again"]):
            a = unpacked(a.as_py(), size)
            if twice:
                again |= unpacked(b.as_py(), size) | (seen & a)
            seen |= a
        return pa.table({"segment": table["segment"][:1], "part": pa.array([0], pa.int32()), "seen": pa.array([packed(seen)], pa.binary()), "again": pa.array([packed(again) if twice else None], pa.binary())})

    return run


def fold(df: DataFrame, positions: Positions, bits: int, which: str) -> np.ndarray:
    """The "seen" or "again" array over all keys of df."""
    parts = max(1, bits >> 22)  # groups that a segment is merged in at first
    merged = in_tasks(df, _fold(positions, bits, parts, which == "again"), SCHEMA)
    for by in [["segment", "part"], ["segment"]][parts == 1 :]:
        merged = merged.groupBy(*by).applyInArrow(_merge(bits), SCHEMA)
    out, size = np.zeros(bits >> 3, np.uint8), min(SEGMENT, bits >> 3)
    for row in merged.select("segment", which).collect():  # MAX_BITS in all
        out[row["segment"] * size :][:size] = unpacked(row[which], size)
    return out
