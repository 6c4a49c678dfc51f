"""Vectorised scans of Arrow text columns: words as 64-bit hashes, and hashes of word runs.

A batch is worked off in slices of bounded size, always in whole texts, so the
memory of a task follows the slice (or the longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, np.uint64(_BASE | 1))
        down = np.full(n, np.uint64(pow(_BASE | 1, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES
    while size < n:
        size *= 2
    return _grown(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of any runs of a sequence, from prefix sums of its weighted items."""

    def __init__(self, items: np.ndarray):
        up, self.down = _powers(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of the texts ``first`` to ``first + len(counts)`` of a batch, in order."""

    first: int
    counts: np.ndarray  # words of each text
    hashes: np.ndarray  # of each word

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text boundaries of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or of one text that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_slices(texts: pa.Array, lower: bool) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+``; with ``lower``, A-Z count as a-z."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if lo == hi:
            yield Words(a, np.zeros(b - a, dtype=np.int64), np.empty(0, np.uint64))
            continue
        part, cuts = data[lo:hi], offsets[a : b + 1] - lo
        black = ~_SPACE[part]
        begins = np.empty(len(part) + 1, dtype=bool)  # at i: a text starts or ends here
        begins[:] = False
        begins[cuts] = True
        before = np.concatenate([[False], black[:-1]])
        starts = np.flatnonzero(black & (~before | begins[:-1]))
        after = np.concatenate([black[1:], [False]])
        ends = np.flatnonzero(black & (~after | begins[1:])) + 1
        codes = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        hashes = Runs(codes).hashes(starts, ends)
        counts = np.diff(np.searchsorted(starts, cuts))
        yield Words(a, counts, hashes)
