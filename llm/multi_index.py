"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.tables import settled

CENTROIDS = 64
SAMPLE = 20_000
#: Entries that a query visits: so many, and this share of the index.
LEAST_VISITED, SHARE_VISITED = 2_000, 0.45
PAGE = 8_192


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors without null or non-finite components, not zero, as doubles."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & F.col("vec_id").isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    )


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat / np.linalg.norm(flat / np.abs(flat).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(flat).max(axis=1, keepdims=True)


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    order = np.random.default_rng(7).permutation(len(points))
    centres = points[order[: min(k, len(points))]].copy()
    for _ in range(rounds):
        nearest = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1))


def traverse(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by growing sum of the two half distances, until their entries reach ``wanted``.

    A heap holds the frontier: the pair after a pair in either order of
    centroids enters only when the pair leaves.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, total = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]), int(two[j])
        if held[cell]:
            out.append(cell)
            total += held[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))
    return out


def search(
    vectors: DataFrame, queries: DataFrame, neighbours: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = CENTROIDS, sample: int = SAMPLE, least: int = LEAST_VISITED, share: float = SHARE_VISITED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest vectors found for each query, by largest cosine.

    Unit vectors are cut into halves, and each half is quantised by ``centroids``
    centroids fitted on at most ``sample`` vectors (those of the smallest id
    hash). Every vector is indexed by its pair of centroids. A query walks the
    pairs by summed distance with a heap until it has met ``least`` entries plus
    ``share`` of the index, and these are ranked by cosine on the original
    vectors, ties to the smaller id. Vectors without direction in space show no
    cells worth skipping, hence the large share; lower it for clustered ones.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; neither do vectors of another length than the most frequent one (ties: the longer). A query is no candidate of its
    own id; other equal vectors are. Repeated rows of an id are candidates once
    each; of query rows that repeat an id, the one with the smallest components asks. The driver sees the centroids and the entries per pair of centroids,
    both of fixed size. Index rows of a centroid are cut into pages of about
    ``PAGE`` rows, so a task holds one page and the queries that reach it.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usual = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    of_length = F.size("v") == usual.n
    index = settled(usable(vectors, id_col, vector_col).where(of_length), "vectors")
    fitted = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    points = _units(fitted)
    half = points.shape[1] // 2
    centres = k_means(points[:, :half], centroids), k_means(points[:, half:], centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _units(batch.column(1))
                cells = [distances(unit[:, :half], centres[0]), distances(unit[:, half:], centres[1])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *[pa.array(c.argmin(axis=1).astype(np.int32)) for c in cells]], ["vec_id", "v", "c1", "c2"]
                )

    placed = settled(index.mapInArrow(place, "vec_id long, v array<double>, c1 int, c2 int"), "placed")
    held = np.zeros((len(centres[0]), len(centres[1])), dtype=np.int64)
    for c1, c2, n in placed.groupBy("c1", "c2").count().collect():
        held[c1, c2] = n
    wanted = least + share * held.sum()
    pages = np.maximum(1, -(-held.sum(axis=1) // PAGE)).tolist()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch.column(1))
            first, second = distances(unit[:, :half], centres[0]), distances(unit[:, half:], centres[1])
            rows, c1s, page, reach = [], [], [], []
            for i in range(len(unit)):
                lists: dict[int, list[int]] = {}
                for a, b in traverse(first[i], second[i], held, wanted):
                    lists.setdefault(a, []).append(b)
                for a, cells in lists.items():
                    for p in range(pages[a]):
                        rows.append(i)
                        c1s.append(a)
                        page.append(p)
                        reach.append(cells)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(c1s, pa.int32()), pa.array(page, pa.int32()), pa.array(reach, pa.list_(pa.int32()))],
                ["query_id", "q", "c1", "page", "cells"],
            )

    asked = usable(queries, id_col, vector_col).where(of_length).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(route, "query_id long, q array<double>, c1 int, page int, cells array<int>")
    count = F.element_at(F.array(*[F.lit(p) for p in pages]), F.col("c1") + 1)
    paged = placed.withColumn("page", F.pmod(F.xxhash64("vec_id"), count).cast("int"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["c2", "vec_id"], kind="stable")
            ids, c2, v = right["vec_id"].to_numpy(), right["c2"].to_numpy(), np.stack(right["v"].to_list())
            norms = np.sqrt((v * v).sum(axis=1))
            for query, q, cells in zip(left["query_id"], left["q"], left["cells"]):
                at = np.flatnonzero(np.isin(c2, cells) & (ids != query))
                score = (v[at] * q).sum(axis=1) / (norms[at] * np.sqrt((q * q).sum()))
                best = np.lexsort((ids[at], -score))[:neighbours]
                out += [(query, int(ids[at[b]]), float(score[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    near = asked.groupBy("c1", "page").cogroup(paged.groupBy("c1", "page")).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, neighbours)
    ranked = near.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "n"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "n.vec_id", (-F.col("n.s")).alias("score"))
