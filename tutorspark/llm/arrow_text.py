"""Texts of an Arrow batch as one byte array, and its words, for the kernels that Spark runs on batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; a longer single text is taken whole.
SLICE_BYTES = 4 << 20

# The white space of the word pattern [^\x20\x09-\x0D]+.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, in order; a NULL text counts as empty."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them (one more than texts)."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run does not go on into the next text."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(inside)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def first_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first run, with the number of runs at the end."""
    return np.searchsorted(starts, offsets, side="left")


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each run of bytes: a sum of bytes times a factor by position, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    values = data[at + np.repeat(starts, length)].astype(np.uint64) + np.uint64(1)
    values *= random_words(int(length.max()), seed)[at]
    return mix64(np.add.reduceat(values, first))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged ranges of the given lengths: the range of each element, and its place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
