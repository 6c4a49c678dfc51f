"""Document quality on an ordered scale: cumulative-link regression over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.tables import id_and_text
from llm.textscan import _LOWER, _SPACE, Runs, buffers, mix, slices

BITS = 18
#: Standard errors by which a feature must differ between grades to get a weight.
TELLING = 5.0
_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 letter, digit or beyond ASCII, 2 other
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: first text, and for every feature present its text (from the first) and its bucket, sorted.

    Features are the distinct lower-cased word and symbol runs, the share of
    repeated runs and the share of symbol runs in eighths, and a constant.
    """
    data, offsets = buffers(texts)
    mask = np.uint64((1 << BITS) - 1)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part, cuts, n = data[lo:hi], offsets[a : b + 1] - lo, b - a
        kind = _KIND[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[cuts] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        kept = kind[starts] > 0 if len(starts) else np.empty(0, bool)
        starts, ends = starts[kept], ends[kept]
        owner = np.searchsorted(cuts, starts, side="right") - 1
        hashes = Runs(_LOWER[part].astype(np.uint64) + np.uint64(1)).hashes(starts, ends)
        runs = np.bincount(owner, minlength=n)
        symbols = np.bincount(owner[kind[starts] == 2], minlength=n)
        keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (hashes & mask))
        distinct = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=n)
        every = np.arange(n, dtype=np.uint64)
        eighths = [np.minimum(8 * x // np.maximum(runs, 1), 8).astype(np.uint64) for x in (runs - distinct, symbols)]
        extra = [mix(np.uint64(1000 * (i + 1)) + e) & mask for i, e in enumerate(eighths)] + [np.zeros(n, np.uint64)]
        keys = np.unique(np.concatenate([keys, *[(every << np.uint64(BITS)) | x for x in extra]]))
        yield a, (keys >> np.uint64(BITS)).astype(np.int64), (keys & mask).astype(np.int64)


@dataclass
class CumulativeLink:
    """P(grade <= j) = sigmoid(threshold_j - score), one weight vector for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[buckets], n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for every j but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -60, 60)))


def evidence(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """For each feature the largest difference, in standard errors, of its share in one grade and in the rest."""
    n, size = len(grades), 1 << BITS
    total, best = np.bincount(buckets, minlength=size).astype(float), np.zeros(size)
    p = total / n
    for grade in range(levels):
        own = int((grades == grade).sum())
        if 0 < own < n:
            held = np.bincount(buckets[grades[rows] == grade], minlength=size)
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / own + 1 / (n - own)))
            best = np.maximum(best, np.abs(held / own - (total - held) / (n - own)) / error)
    return best


def fit(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, levels: int, rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> CumulativeLink:
    """Full-batch Adam on the ordinal likelihood; grades count from 0, rare ones weigh more by the root of their rarity.

    Weights are given to telling features only; the noise of the others would
    add up over a long text.
    """
    n = len(grades)
    telling = evidence(rows, buckets, grades, levels) >= TELLING
    telling[0] = True
    rows, buckets = rows[telling[buckets]], buckets[telling[buckets]]
    count = np.bincount(grades, minlength=levels).astype(float)
    share = np.sqrt(1 / count[grades])
    share *= n / share.sum()
    below = np.clip(np.cumsum(count)[:-1] / n, 0.01, 0.99)
    model = CumulativeLink(np.zeros(1 << BITS), np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(levels - 1)))
    moments = [np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(levels - 1), np.zeros(levels - 1)]
    for step in range(1, rounds + 1):
        above = model.tails(model.scores(rows, buckets, n))
        upper = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        row = np.arange(n)
        p = np.maximum(upper[row, grades] - upper[row, grades + 1], 1e-9)
        slope = upper * (1 - upper)
        d_low, d_high = slope[row, grades] / p * share, slope[row, grades + 1] / p * share
        gradient = np.bincount(buckets, (d_low - d_high)[rows], 1 << BITS) / n - decay * model.weights
        shift = np.zeros(levels + 1)
        np.add.at(shift, grades, -d_low)
        np.add.at(shift, grades + 1, d_high)
        for k, (value, g) in enumerate(((model.weights, gradient), (model.thresholds, shift[1:-1] / n))):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        model.thresholds[:] = np.maximum.accumulate(model.thresholds)
    return model


def train(docs: DataFrame, ratings: DataFrame, levels: int, max_rows: int = 10_000) -> CumulativeLink:
    """Fit on at most ``max_rows`` rated documents, those of the smallest id hash.

    Takes ``docs(doc_id, text)`` and ``ratings(doc_id, grade)``. Only the hashed
    features of this sample reach the driver. Without ratings every document
    keeps the top grade.
    """
    chosen = ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, buckets in features(batch.column(1)):
                n = int(rows[-1]) + 1 if len(rows) else 0
                cuts = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(2).slice(first, n), lists], ["doc_id", "grade", "f"])

    held = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("int").alias("grade"))
    sample = sorted(tuple(r) for r in held.mapInArrow(scan, "doc_id long, grade int, f array<int>").collect())
    if not sample:
        return CumulativeLink(np.zeros(1 << BITS), np.full(levels - 1, -10.0))
    grades = np.array([g for _, g, _ in sample])
    rows = np.repeat(np.arange(len(sample)), [len(f) for *_, f in sample])
    return fit(rows, np.concatenate([np.array(f) for *_, f in sample]), grades, levels)


def grade_documents(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", least_tail: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, p_top, keep`` of every whole text.

    ``expected_grade`` is the mean grade, ``p_top`` the probability of the top
    grade, and ``keep`` whether that reaches ``least_tail``. Null and empty texts
    are scored by the constant and the empty shares alone. One row for each
    input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, rows, buckets in features(batch.column(1)):
                n = int(rows[-1]) + 1 if len(rows) else 0
                tails = own.tails(own.scores(rows, buckets, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)],
                    ["doc_id", "expected_grade", "p_top", "keep"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, expected_grade double, p_top double, keep boolean")


def keep_good(docs: DataFrame, model: CumulativeLink, text_col: str = "text", least_tail: float = 0.5) -> DataFrame:
    """The documents whose ``p_top`` reaches ``least_tail``; columns as they came, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for first, rows, buckets in features(batch.column(at)):
                n = int(rows[-1]) + 1 if len(rows) else 0
                keep[first : first + n] = own.tails(own.scores(rows, buckets, n))[:, -1] >= least_tail
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
