"""Benchmark passages in documents: shared q-grams in diagonal bands, then banded alignment.

By the q-gram lemma a text region within ``k`` edits of an item of ``m``
characters shares at least ``m - q + 1 - k * q`` q-grams with it, on diagonals
that span at most ``k``. Hits are counted in overlapping bands of ``2 * (k + 1)``
diagonals, two of which hold any such span; bands that reach the bound go on to
the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.tables import id_and_text, settled

Q = 12
EDITS = 0.05
#: Characters of benchmark text that one pass over the documents compares with.
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 1 << 17
_FILTER_BITS = 21


def plain(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, q: int = Q, rate: float = EDITS) -> int:
    """Edits allowed for an item: its share, but no more than keep a bound of one shared q-gram."""
    return max(0, min(int(length * rate), (length - q) // q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` codes, put together from runs of powers of two."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    run, width, factor = codes.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    out, done, n = np.zeros(len(codes) - q + 1, np.uint64), 0, len(codes) - q + 1
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                out *= factor
                out += run[done : done + n]
                done += width
            if done == q:
                return out * np.uint64(0xD6E8FEB86659FD93)
            run = run[:-width] * factor + run[width:]
            width *= 2
            factor = factor * factor


class Items:
    """A block of benchmark items, ready to be looked up by q-gram."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.keys = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.edits = np.array([budget(len(c), q, rate) for c in self.codes], dtype=np.int64)
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        grams = [_grams(c, q) for c in self.codes]
        all_grams = np.concatenate([np.empty(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(all_grams, kind="stable")
        self.grams, first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and place in the item of every shared q-gram."""
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        found = np.searchsorted(self.grams, grams[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == grams[at] if len(self.grams) else np.zeros(len(at), bool)
        at, found = at[same], found[same]
        times = self.first[found + 1] - self.first[found] if len(found) else found
        slot = np.repeat(self.first[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(at, times), self.owner[slot], self.place[slot]


def align(item: np.ndarray, region: np.ndarray, lowest: int, width: int, most: int) -> tuple[int, int] | None:
    """Edits and end of the best place of the whole item in the region, within a band of diagonals.

    Cell ``j`` of row ``i`` stands for region position ``i + lowest + j``. Leaving
    out the region before and after is free. None if it takes over ``most`` edits.
    """
    far = most + 1
    shift = np.arange(width)
    row = np.where((lowest + shift >= 0) & (lowest + shift <= len(region)), 0, far)
    for i in range(1, len(item) + 1):
        at = i + lowest + shift
        inside = (at >= 1) & (at <= len(region))
        other = np.ones(width, dtype=np.int64)
        other[inside] = region[at[inside] - 1] != item[i - 1]
        best = np.where(inside, row + other, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(at < 0) | (at > len(region))] = far
        row = np.minimum(np.minimum.accumulate(best - shift) + shift, far)
        if row.min() >= far:
            return None
    j = int(row.argmin())
    return (int(row[j]), len(item) + lowest + j) if row[j] <= most else None


def regions(items: Items, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(item, edits, end)`` of every band that passes the count and the alignment."""
    pos, item, place = items.hits(codes)
    if not len(pos):
        return
    diagonal = pos - place
    half = items.edits[item] + 1
    band = np.floor_divide(diagonal, half)
    base = int(band.min()) - 1
    span = int(band.max()) - base + 1
    keys = item * span + (band - base)
    # Every hit counts in its band and the one below: bands overlap by half.
    keys, counts = np.unique(np.concatenate([keys, keys - 1]), return_counts=True)
    owner, band = keys // span, keys % span + base
    bound = np.maximum(1, items.sizes[owner] - items.q + 1 - items.edits[owner] * items.q)
    for t, b in zip(owner[counts >= bound].tolist(), band[counts >= bound].tolist()):
        k = int(items.edits[t])
        lowest, width = b * (k + 1) - k, 4 * k + 2
        start = max(0, lowest)
        region = codes[start : max(start, lowest + width + int(items.sizes[t]))]
        found = align(items.codes[t], region, lowest - start, width, k)
        if found:
            yield t, found[0], start + found[1]


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDITS) -> DataFrame:
    """``doc_id, item_id, edits, end``: the best place of each benchmark item found in each document.

    Takes ``docs(doc_id, text)`` and ``benchmark(item_id, text)``. An item counts
    as found when its whole text lies in the document within ``rate`` of its
    length in edits (fewer for items so short that no q-gram would have to be
    shared), case and white space aside; ``end`` counts characters of the text so
    simplified. Items of under ``q`` characters would match almost anything and
    take no part, nor do null items or texts. The benchmark goes to the tasks in
    blocks of ``BLOCK_CHARS`` characters, one pass over the documents for each.
    Repeated rows give repeated results; equal places go to the smaller end.
    """
    spark = docs.sparkSession
    block: list[tuple[int, str]] = []
    size, passes = 0, []

    def search(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value, q, rate)
            for batch in batches:
                out: dict[tuple[int, int], tuple[int, int]] = {}
                for row, text in enumerate(batch.column(1)):
                    codes = _codes(plain(text.as_py()))
                    # Slices overlap by the longest item and its edits.
                    over = int((own.sizes + 6 * own.edits + 6).max())
                    for start in range(0, max(1, len(codes)), SLICE_CHARS):
                        for t, edits, end in regions(own, codes[start : start + SLICE_CHARS + over]):
                            best = (edits, start + end)
                            out[row, t] = min(out.get((row, t), best), best)
                rows = pa.array([r for r, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        pa.array([own.keys[t] for _, t in out], pa.int64()),
                        pa.array([e for e, _ in out.values()], pa.int32()),
                        pa.array([e for _, e in out.values()], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "end"],
                )

        return docs.mapInArrow(scan, "doc_id long, item_id long, edits int, end long")

    wanted = benchmark.where("item_id is not null and text is not null")
    for item in wanted.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = plain(item["text"])
        if len(text) >= q:
            if block and size + len(text) > BLOCK_CHARS:
                passes.append(search(block))
                block, size = [], 0
            block.append((item["item_id"], text))
            size += len(text)
    if block:
        passes.append(search(block))
    if not passes:
        return spark.createDataFrame([], "doc_id long, item_id long, edits int, end long")
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``matches`` for tables of any further columns."""
    return matches(id_and_text(docs, id_col, text_col), benchmark.select("item_id", "text"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found; columns as they came.

    Rows are judged by their text, so those of a null or repeated id are too;
    null texts hold nothing and stay.
    """
    texts = docs.select(F.xxhash64("text").alias("_leak"), "text")
    found = settled(find_leaks(texts, benchmark, "_leak").select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.withColumn("_leak", F.xxhash64("text")).join(found, "_leak", "left_anti").select(*docs.columns)
