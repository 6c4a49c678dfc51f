"""Centroid clustering over a VA-file: few-bit cells decide most vectors, the rest are fetched in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.tables import settled

#: Vectors that the cell marks and page limits are taken from; the cells' outer limits come from all vectors.
SAMPLE = 20_000
BITS = 8
PAGES = 16
#: Components from here on are left out: their squared distances need not fit a long.
LIMIT = 131_072.0
ROWS = 4_096

_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of vectors of exactly ``dims`` usable components."""
    v = F.col("v")
    usable = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False)))
    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return taken.where(v.isNotNull() & usable).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def exact(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers."""
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)


@dataclass
class VaFile:
    """Cell limits of every dimension: cell ``k`` of dimension ``j`` holds ``low[j, k]`` to ``high[j, k]``."""

    marks: np.ndarray  # inner limits, dims x (cells - 1)
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int) -> VaFile:
        shares = np.linspace(0, 1, 2**bits + 1)[1:-1]
        marks = np.ceil(np.quantile(sample, shares, axis=0)).astype(np.int64).T
        return cls(marks, np.column_stack([least, marks]), np.column_stack([marks - 1, most]))

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, rows[:, j], side="right") for j, m in enumerate(self.marks)], axis=1).astype(np.uint8)

    def intervals(self, centres: np.ndarray) -> np.ndarray:
        """Lookup table, dims x cells x (2 * centroids): least squared difference to each centroid, then the most."""
        to_low = (self.low[:, :, None] - centres.T[:, None, :]) ** 2
        to_high = (self.high[:, :, None] - centres.T[:, None, :]) ** 2
        within = (self.low[:, :, None] <= centres.T[:, None, :]) & (centres.T[:, None, :] <= self.high[:, :, None])
        return np.concatenate([np.where(within, 0, np.minimum(to_low, to_high)), np.maximum(to_low, to_high)], axis=2)

    def decide(self, cells: np.ndarray, centres: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The nearest centroid where the cells alone prove it, else -1; ties go to the smaller number."""
        k = len(centres)
        bounds = np.zeros((len(cells), 2 * k), dtype=np.int64)
        for j in range(cells.shape[1]):
            bounds += table[j][cells[:, j]]
        low, high = bounds[:, :k], bounds[:, k:]
        nearest = (low + high).argmin(axis=1)
        # An interval that ends below all others decides at once; where intervals
        # overlap, the difference of two distances has a tighter interval, as
        # both are taken at the same point of the cell.
        open_ = (low <= high.min(axis=1, keepdims=True)).sum(axis=1) > 1
        out = np.where(open_, -1, nearest)
        dims = np.arange(cells.shape[1])
        for b in range(k):
            at = np.flatnonzero(open_ & (nearest == b))
            if not len(at):
                continue
            gap = 2 * (centres - centres[b]).T  # dims x centroids
            own, far = self.low[dims, cells[at]], self.high[dims, cells[at]]
            behind = far @ np.maximum(gap, 0) + own @ np.minimum(gap, 0) + (centres[b] ** 2).sum() - (centres**2).sum(axis=1)
            # The most by which b can be farther than each other centroid.
            lost = np.where(np.arange(k) < b, behind >= 0, behind > 0)
            lost[:, b] = False
            out[at[~lost.any(axis=1)]] = b
        return out


@dataclass
class Assigner:
    file: VaFile
    centres: np.ndarray

    def __post_init__(self) -> None:
        self.table = self.file.intervals(self.centres)

    def known(self, cells: np.ndarray) -> np.ndarray:
        return self.file.decide(cells, self.centres, self.table)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _unpacked(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _limits(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component of each dimension over all vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = most = None
        for block in _blocks(batches):
            rows = matrix(block.column(0))
            least = rows.min(axis=0) if least is None else np.minimum(least, rows.min(axis=0))
            most = rows.max(axis=0) if most is None else np.maximum(most, rows.max(axis=0))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least)), pa.int32()), pa.array(least), pa.array(most)], ["j", "least", "most"])

    found = kept.select("v").mapInArrow(scan, "j int, least long, most long")
    rows = sorted(found.groupBy("j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect())
    return np.array([r.least for r in rows]), np.array([r.most for r in rows])


def _pages_to_fetch(paged: DataFrame, old: Assigner | None, new: Assigner) -> list[int]:
    """Pages with a vector that the cells don't settle or that leaves its cluster; reads cells only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: set[int] = set()
        for block in _blocks(batches):
            page = block.column(0).to_numpy(zero_copy_only=False)
            if old is None:
                wanted.update(np.unique(page).tolist())
                continue
            cells = _unpacked(block.column(1))
            now = new.known(cells)
            wanted.update(np.unique(page[(now < 0) | (now != old.known(cells))]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(wanted), pa.int32())], ["page"])

    return [r.page for r in paged.select("page", "cells").mapInArrow(scan, "page int").distinct().collect()]


def _moves(paged: DataFrame, old: Assigner | None, new: Assigner, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums and counts of the clusters gain and lose between two sets of centroids."""
    k = len(new.centres)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for block in _blocks(batches):
            cells = _unpacked(block.column(0))
            now = new.known(cells)
            before = old.known(cells) if old is not None else None
            fetch = np.arange(len(cells)) if old is None else np.flatnonzero((now < 0) | (now != before))
            if not len(fetch):
                continue
            rows = matrix(block.column(1).take(pa.array(fetch)))
            for assigner, known, sign in ((new, now, 1), (old, before, -1)):
                if assigner is None:
                    continue
                own = known[fetch]
                unsure = np.flatnonzero(own < 0)
                if len(unsure):
                    own[unsure] = exact(rows[unsure], assigner.centres).argmin(axis=1)
                for c in range(k):
                    sums[c] += sign * rows[own == c].sum(axis=0)
                count += sign * np.bincount(own, minlength=k)
        changed = np.flatnonzero(sums.any(axis=1) | (count != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(changed, pa.int32()), pa.array(count[changed]), pa.array(list(sums[changed]), pa.list_(pa.int64()))], ["c", "n", "sums"]
        )

    parts = paged.select("cells", "v").mapInArrow(scan, "c int, n long, sums array<long>")
    sums, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    spread = parts.select("c", "n", F.posexplode("sums").alias("j", "x"))
    for r in spread.groupBy("c", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        sums[r.c, r.j], count[r.c] = r.x, r.n
    return sums, count


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).try_cast(kind) for v in values]), F.col("cluster") + 1)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", bits: int = BITS,
    pages: int = PAGES, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector, in whole numbers.

    Components become ``floor(scale * x)``. The ``k`` vectors with the smallest
    sha256 of ``<salt>:<vec_id>`` start as centroids (of rows that repeat an id,
    the one with the smaller components first); every round assigns each vector
    to its nearest centroid, ties to the smaller number, and moves the centroids
    to the floored means, empty ones staying. Then all are assigned once more.

    Vectors are written once with their cells, ``bits`` bits a dimension (8 at
    most), in ``pages`` folders by how clearly the first centroids tell them
    apart. A round looks the cells up in tables of distance intervals; only
    pages with a vector whose intervals overlap, or that changes cluster, are
    read in full, and only such vectors are decoded. Sums are carried on by what
    moves, so a vector that stays where it was is never fetched. A task adds up
    its moves before anything is shuffled. The driver holds the centroids, their
    sums and at most ``sample`` vectors (those of the smallest id hash) from
    which cells and pages are cut; the result doesn't depend on either.

    Vectors that are null, of another length, or hold a null, a non-finite
    component or one of 131,072 or more (their distances need not fit a long)
    take no part. Rows that repeat an id are vectors of their own; a null id is
    kept but never starts a centroid unless no other vector is left. With fewer
    vectors than ``k``, each starts one. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kept = settled(whole_vectors(vectors, id_col, vector_col, dims, scale), "whole-vectors")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], _RESULT)
    centres = np.array([r.v for r in starts], dtype=np.int64)
    k = len(centres)
    drawn = matrix(kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks())
    file = VaFile.fit(drawn, *_limits(kept), bits)

    def lead(rows: np.ndarray, first: np.ndarray = centres) -> np.ndarray:
        """How much farther the second centroid is than the nearest."""
        if len(first) == 1:
            return np.zeros(len(rows), dtype=np.int64)
        two = np.partition(exact(rows, first), 1, axis=1)
        return two[:, 1] - two[:, 0]

    cuts = np.quantile(lead(drawn), np.linspace(0, 1, pages + 1)[1:-1])

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            rows = matrix(block.column(1))
            packed = pa.array([r.tobytes() for r in file.cells(rows)], pa.binary())
            page = pa.array(np.searchsorted(cuts, lead(rows), side="right"), pa.int32())
            yield pa.RecordBatch.from_arrays([*block.columns, packed, page], ["vec_id", "v", "cells", "page"])

    paged = settled(kept.mapInArrow(approximate, "vec_id long, v array<int>, cells binary, page int"), "va-pages", by="page")
    old: Assigner | None = None
    sums, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for _ in range(rounds):
        new = Assigner(file, centres)
        fetch = _pages_to_fetch(paged, old, new)
        if fetch:
            more, n = _moves(paged.where(F.col("page").isin(fetch)), old, new, dims)
            sums, count = sums + more, count + n
        old = new
        centres = centres.copy()
        held = count > 0
        centres[held] = sums[held] // count[held, None]
        if (centres == old.centres).all():
            break  # every later round would repeat this one
    last = Assigner(file, centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            own, rows = last.known(_unpacked(block.column(1))), matrix(block.column(2))
            unsure = np.flatnonzero(own < 0)
            if len(unsure):
                own[unsure] = exact(rows[unsure], last.centres).argmin(axis=1)
            distance = ((rows - last.centres[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = settled(paged.select("vec_id", "cells", "v").mapInArrow(place, "vec_id long, cluster int, distance long"), "va-placed")
    total = dict(placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return placed.withColumns(
        {
            "cluster_inertia": _by_cluster([total.get(c, 0) for c in range(k)], "long"),
            "inertia": F.lit(sum(total.values())).try_cast("long"),
            "centroid_sha256": _by_cluster(names, "string"),
        }
    )
