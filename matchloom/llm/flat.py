"""Vectorised work on the bytes and words of a batch of texts.

A batch of Arrow strings is one byte array and offsets. Hashes of all words, and of all
windows of words or bytes, come from prefix polynomial hashes modulo 2**64: with
``P[i] = sum of value[j] * BASE**j, j < i`` the stretch from ``a`` to ``b`` has the hash
``(P[b] - P[a]) * BASE**-a``, wherever it lies.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
# The bytes [\x20\x09-\x0D] that separate words.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
# Bytes of text, at least, that are cut in words at a time.
PART_BYTES = 1 << 18

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Give freed memory back to the system, where the C library has ``malloc_trim``.

    Python workers stay for later tasks and stages, most of the time idle. Without this they
    hold what lies free between small blocks in use.
    """
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)
    pa.default_memory_pool().release_unused()


def released(task: Task) -> Task:
    """``task`` over batches, with its freed memory given back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        trim()

    return whole


def released_group(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group's rows."""

    def whole(table: pa.Table) -> pa.Table:
        result = task(table)
        trim()
        return result

    return whole


def released_pair(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two tables' rows of one group."""

    def whole(table: pa.Table, notes: pa.Table) -> pa.Table:
        result = task(table, notes)
        trim()
        return result

    return whole


_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n; kept for the next batch."""
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, 2 * len(known)), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    upper = (data - np.uint8(65)) < 26
    return data + upper.view(np.uint8) * np.uint8(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits, one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes, one more than there are values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal stretches have equal hashes."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hashes(values)
    return mix((prefix[width:] - prefix[:n]) * powers(INVERSE, n))


@dataclass
class Texts:
    """Bytes of all texts, with where each text begins; nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray | pa.Array, lower: bool = False) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        if n == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, where, data = column.buffers()
        offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        return cls(lowered(data) if lower else data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def parts(self, size: int) -> Iterator[tuple[int, Texts]]:
        """Whole texts of about ``size`` bytes at a time, with the number of bytes before them."""
        marks = np.searchsorted(self.offsets, np.arange(0, self.offsets[-1] + 1, size))
        cuts = np.unique(np.concatenate([[0], marks, [len(self)]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = self.offsets[a : b + 1]
            yield int(own[0]), Texts(self.data[own[0] : own[-1]], own - own[0])


@dataclass
class Words:
    """Starts, ends and hashes of all words; ``first[i]`` is where text i's words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Words:
        """Words of all texts, by parts: a part's arrays are many times as large as its bytes."""
        none = np.zeros(0, np.int64)
        starts, ends, hashes = [none], [none], [none.astype(np.uint64)]
        for before, part in texts.parts(PART_BYTES):
            start, end, found = cls._of_part(part)
            starts.append(start + before)
            ends.append(end + before)
            hashes.append(found)
        start = np.concatenate(starts)
        first = np.searchsorted(start, texts.offsets)
        return cls(start, np.concatenate(ends), first, np.concatenate(hashes))

    @staticmethod
    def _of_part(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = texts.data, texts.offsets
        # Blanks by comparison; less than 9 wraps around.
        solid = (data != 32) & ((data - np.uint8(9)) > 4)
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[offsets[offsets < len(data)]] = False
        after[offsets[offsets > 0] - 1] = False
        start = np.flatnonzero(solid & ~before)
        end = np.flatnonzero(solid & ~after) + 1
        prefix = prefix_hashes(np.add(data, 1, dtype=np.uint64))
        return start, end, mix(stretch_hashes(prefix, start, end))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows inside one text, and their hashes."""
        hashes = window_hashes(self.hashes, width)
        inside = np.ones(len(hashes), bool)
        for back in range(1, width):  # windows that would cross into the next text
            at = self.first[1:-1] - back
            at = at[(at >= 0) & (at < len(hashes))]
            inside[at] = False
        at = np.flatnonzero(inside)
        return at, hashes[at]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    change = np.bincount(starts, minlength=n + 1)
    change -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0
