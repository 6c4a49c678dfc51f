"""Repeated passages across documents: winnowed seeds, extended both ways, kept when long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.tables import id_and_text, settled
from llm.textscan import Runs, Words, word_slices

SEED_WORDS = 20
_LOW = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def seeds_of(part: Words, length: int, seed: int) -> dict[str, np.ndarray]:
    """Per run of windows that choose the same seed: text, first and last window start, seed hash, context hash.

    A window is ``length`` consecutive words of one text; it chooses the
    smallest hash among its ``seed``-word runs, the last one on a tie. The
    choice depends on the window's words alone, so equal windows of two
    documents always meet at an equal seed. The context of an occurrence
    reaches from the first to the last window that chose it.
    """
    bounds, n = part.bounds, len(part.hashes)
    if n < length:
        empty = np.empty(0, np.int64)
        return {"text": empty, "first": empty, "last": empty, "seed": empty.view(np.uint64), "context": empty.view(np.uint64)}
    runs = Runs(part.hashes)
    at = np.arange(n - seed + 1)
    hashes = runs.hashes(at, at + seed)
    # Ranked by the upper hash bits, then by the larger position.
    least = _sliding_least((hashes & ~_LOW) | (_LOW - (at.astype(np.uint64) & _LOW)), length - seed + 1)
    window = np.arange(n - length + 1)
    text = np.searchsorted(bounds, window, side="right") - 1
    inside = window + length <= bounds[text + 1]
    window, text = window[inside], text[inside]
    spot = (_LOW - (least[window] & _LOW)).astype(np.int64)
    spot += (window - spot + ((1 << 24) - 1)) >> 24 << 24  # positions beyond 2^24 words
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (spot[1:] != spot[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    end = np.concatenate([begin[1:], [len(window)]]) - 1 if len(begin) else begin
    first, last, chosen = window[begin], window[end], spot[begin]
    owner = text[begin]
    context = runs.hashes(first, last + length) ^ ((chosen - first).astype(np.uint64) << np.uint64(32))
    return {"text": owner, "first": first - bounds[owner], "last": last - bounds[owner], "seed": hashes[chosen], "context": context}


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch.column(1), lower=False):
                found = seeds_of(part, length, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(part.first, len(part.counts)).take(pa.array(found["text"])) for c in (0, 2)],
                        pa.array(found["first"].astype(np.int32)),
                        pa.array(found["last"].astype(np.int32)),
                        pa.array(found["seed"].view(np.int64)),
                        pa.array(found["context"].view(np.int64)),
                    ],
                    ["doc_id", "t", "first", "last", "seed", "context"],
                )

    return docs.mapInArrow(scan, "doc_id long, t long, first int, last int, seed long, context long")


def _windows(held: DataFrame, length: int) -> DataFrame:
    """Hash of every window in the listed spans of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for part in word_slices(batch.column(1), lower=False):
                runs, bounds = Runs(part.hashes), part.bounds
                rows, starts = [], []
                for t in range(len(part.counts)):
                    for span in spans[part.first + t].as_py():
                        own = np.arange(span["first"], span["last"] + 1)
                        rows.append(np.full(len(own), part.first + t))
                        starts.append(own + bounds[t])
                if rows:
                    row, start = np.concatenate(rows), np.concatenate(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(pa.array(row)) for c in (0, 3)],
                            pa.array((start - bounds[row - part.first]).astype(np.int32)),
                            pa.array(runs.hashes(start, start + length).view(np.int64)),
                        ],
                        ["doc_id", "t", "start", "hash"],
                    )

    return held.mapInArrow(scan, "doc_id long, t long, start int, hash long")


def repeats(docs: DataFrame, length: int = 50, seed: int = SEED_WORDS) -> DataFrame:
    """``doc_id, t, first, last``: spans of window starts whose windows also start in a document of a smaller id.

    Takes ``docs(doc_id, text, t)``, ``t`` a hash of the text that tells rows of
    one id apart; joins on both. First, seeds that
    lie in two documents or more are kept. Then whole contexts extend each seed
    as far as its windows reach: all but the smallest document of a context
    repeat it in full. The remaining occurrences, one for each context of a seed
    with several, are compared window by window. Minima are pre-aggregated and
    the joins read written tables, so a passage held by a third of the documents
    is split over tasks.
    """
    found = settled(_seeds(docs.where("doc_id is not null"), length, seed), "seeds")
    shared = found.groupBy("seed").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("h")).where("l < h").select("seed")
    common = settled(found.join(settled(shared, "shared"), "seed", "left_semi"), "common")
    least = settled(common.groupBy("seed", "context").agg(F.min("doc_id").alias("source")), "least")
    several = settled(least.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "several")
    extended = settled(common.join(least, ["seed", "context"]), "extended")
    whole = extended.where("source < doc_id").select("doc_id", "t", "first", "last")
    edges = extended.where("source = doc_id").join(several, "seed", "left_semi")
    spans = edges.groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    windows = _windows(docs.join(spans, ["doc_id", "t"]).select("doc_id", "text", "spans", "t"), length)
    windows = settled(windows, "windows")
    sources = settled(windows.groupBy("hash").agg(F.min("doc_id").alias("source")), "sources")
    partly = windows.join(sources, "hash").where("source < doc_id").select("doc_id", "t", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(partly)


def _told_apart(docs: DataFrame) -> DataFrame:
    return docs.withColumn("t", F.xxhash64("text"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``doc_id, start, end``: maximal word spans (end exclusive) that repeat passages of smaller documents, of each text of an id."""
    spans = repeats(_told_apart(id_and_text(docs, id_col, text_col)), length)
    starts = spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("s"))
    joined = F.aggregate(
        "s",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["first"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["start"].alias("start"),
                        F.greatest(F.element_at(out, -1)["end"], x["last"] + length).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(x["first"].alias("start"), (x["last"] + length).alias("end"))))),
    )
    return starts.select("doc_id", F.explode(joined).alias("r")).select("doc_id", "r.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: every text without the words that repeat a smaller document.

    A word goes when a window of ``length`` words covers it whose words also
    start in a document of a smaller id; repeats within one document stay.
    Windows are judged on the input. ``kept`` joins the remaining words by one
    space. Null and empty texts have no words; texts under ``length`` words lose
    none; a null id neither loses words nor lends them. Rows that repeat an id
    are one document of several texts: a row loses what a smaller document has
    and nothing to another row of its own id.
    """
    docs = _told_apart(id_and_text(docs, id_col, text_col))
    spans = repeats(docs, length).groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            spans = batch.column(2)
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                totals.append(len(words))
                if spans[row].is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    own = spans[row].values
                    np.add.at(edge, np.minimum(own.field("first").to_numpy(), len(words)), 1)
                    np.add.at(edge, np.minimum(own.field("last").to_numpy() + length, len(words)), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = docs.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")

