"""Near-duplicate documents by b-bit MinHash: bands propose, low bits estimate, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType
import pandas as pd

from llm.graph import components
from llm.tables import id_and_text, settled
from llm.textscan import Runs, mix, word_slices

BANDS, ROWS, BITS = 30, 6, 2
HASHES = BANDS * ROWS
PER_LONG = 64 // BITS
LONGS = -(-HASHES // PER_LONG)
#: Standard deviations that an estimate may lie below the threshold before a candidate is given up.
SLACK = 6.0
#: Rows of a bucket that are compared with each other at once.
BLOCK = 512

_RANDOM = np.random.default_rng(20240601)
_FACTORS = _RANDOM.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)

SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, packed array<long>"


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: first text, set size of each text, and the sorted distinct shingle hashes text after text.

    A text of fewer than ``words`` words has its whole word sequence as its one
    shingle; a text without words (or null) has none.
    """
    for part in word_slices(texts, lower=True):
        bounds, n = part.bounds, part.counts
        shingles = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        owner = np.repeat(np.arange(len(n)), shingles)
        ahead = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        starts = bounds[:-1][owner] + ahead
        hashes = Runs(part.hashes).hashes(starts, starts + np.minimum(n, words)[owner])
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield part.first, np.bincount(owner[fresh], minlength=len(n)), hashes[fresh]


def _minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row per non-empty set: the minima of all hash functions."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(low * _FACTORS[k] + _SHIFTS[k], starts)
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.empty((len(minima), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(minima), np.uint64(band + 1))
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key ^ minima[:, k].astype(np.uint64)) + np.uint64(k)
        keys[:, band] = key
    return keys


def _packed(minima: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits of every (remixed) minimum, side by side in longs."""
    bits = (mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint64)
    out = np.zeros((len(minima), LONGS), dtype=np.uint64)
    for k in range(HASHES):
        out[:, k // PER_LONG] |= bits[:, k] << np.uint64(BITS * (k % PER_LONG))
    return out


def _lists(rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(keep, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Set size, two set fingerprints, band keys and packed low bits of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, sets in shingle_sets(batch.column(1), words):
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                minima = np.empty((0, HASHES), np.uint32)
                if len(starts):
                    f1[full] = np.add.reduceat(mix(sets), starts)
                    f2[full] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    minima = _minima(sets, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        _lists(_band_keys(minima), full),
                        _lists(_packed(minima), full),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "packed"],
                )

    return docs.mapInArrow(scan, SIGNATURES)


def _estimate(a: str, b: str):
    """Similarity from equal low bits, corrected for those equal by chance."""
    odd = F.lit(0)
    low = (1 << 64) // 3  # the lower bit of every pair of bits
    for i in range(LONGS):
        x = F.col(f"{a}.packed")[i].bitwiseXOR(F.col(f"{b}.packed")[i])
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        odd = odd + F.bit_count(either.bitwiseAND(F.lit(low).cast("long")))
    chance = 1.0 / (1 << BITS)
    return (F.lit(1.0) - odd / F.lit(float(HASHES)) - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    """The lowest estimate that a pair at the threshold may show, ``SLACK`` deviations below."""
    chance, s = 1.0 / (1 << BITS), percent / 100
    p = s + (1 - s) * chance
    return s - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, sets in shingle_sets(batch.column(1), words):
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        pa.array([sets[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    ["doc_id", "shingles"],
                )

    chosen = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    # Rows that repeat an id have one text in a sound table; any one of them stands for it.
    return chosen.mapInArrow(scan, "doc_id long, shingles binary").dropDuplicates(["doc_id"])


@pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(a, b)],
        dtype="int64",
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").withColumn("both", _shared("sa", "sb"))
    union = (F.length("sa") + F.length("sb")) / 8 - F.col("both")
    return sized.where(F.col("both") * 100 >= union * percent).select("a", "b")


def _shared_count(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _links_across(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, floor: float) -> DataFrame:
    """Confirmed links between different components of a bucket; candidate pairs never leave the task.

    A bucket is cut into blocks of about ``BLOCK`` rows and worked off block
    against block, so a task holds two blocks whatever the bucket's size. A pair
    is looked at in the first band it shares, and only while its ends are not
    yet connected.
    """
    sized = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = rows.join(settled(sized, "sized"), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    full = dealt.join(classes.select("id", "bands"), "id").join(sets.withColumnRenamed("doc_id", "id"), "id")

    def link(block: pd.DataFrame) -> pd.DataFrame:
        ids, own, c = block["id"].to_numpy(), block["own"].to_numpy(), block["c"].to_numpy()
        within = bool((block["i"] == block["j"]).iloc[0])
        packed = np.stack(block["packed"].to_list()).view(np.uint64)
        bands = np.stack(block["bands"].to_list())
        here = int(np.argmax(bands[0] == block["key"].iloc[0]))
        shingles = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
        parent = {v: v for v in c.tolist()}

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        most_odd = HASHES * (1 - 1 / (1 << BITS)) * (1 - floor) + 1e-9
        low = np.uint64((1 << 64) // 3)
        out = []
        for p in range(len(ids)):
            rest = np.arange(p + 1, len(ids)) if within else np.flatnonzero(own > own[p])
            rest = rest[c[rest] != c[p]]
            differ = packed[rest] ^ packed[p]
            odd = np.bitwise_count((differ | (differ >> np.uint64(1))) & low).sum(axis=1)
            rest = rest[odd <= most_odd]
            rest = rest[(bands[rest, :here] != bands[p, :here]).all(axis=1)]
            for q in rest.tolist():
                x, y = root(int(c[p])), root(int(c[q]))
                if x != y:
                    both = _shared_count(shingles[p], shingles[q])
                    if both * 100 >= percent * (len(shingles[p]) + len(shingles[q]) - both):
                        parent[max(x, y)] = min(x, y)
                        out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.groupBy("key", "i", "j").applyInPandas(link, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their
    distinct ``words``-word shingles (A-Z lower-cased); ``component_id`` is the
    smallest id that links reach, and ``kept`` marks the document that has it.

    Equal sets collapse to their smallest id first. Among these representatives
    30 bands of 6 minima propose candidates (a pair at 0.85 is missed with
    probability 7e-7); two low bits of 180 minima, corrected for chance, drop
    candidates six deviations below the threshold, and full sets confirm the
    rest. There are two rounds, so that n near copies give about n pairs: every
    member of a bucket first meets the bucket's smallest and largest id; then
    members whose components still differ are compared in blocks, which return
    links only.

    Null or empty texts, and texts without words, have an empty set and no
    links. A null id cannot be linked: its component is null and it is kept.
    Repeated rows of one id all get the verdict of the id. An empty table gives
    an empty result.
    """
    docs = id_and_text(docs, id_col, text_col)
    floor = floor_of(percent)
    signed = settled(signatures(docs, words), "signed")
    classes = settled(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("packed").alias("packed")),
        "classes",
    )
    banded = classes.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = settled(banded.join(settled(buckets, "buckets"), "key"), "members")
    bits = classes.select("id", "packed")

    def near(pairs: DataFrame) -> DataFrame:
        held = pairs.join(bits.select(F.col("id").alias("a"), F.struct("packed").alias("x")), "a")
        held = held.join(bits.select(F.col("id").alias("b"), F.struct("packed").alias("y")), "b")
        return held.where(_estimate("x", "y") >= floor).select("a", "b")

    stars = members.select("id", F.explode(F.array("lo", "hi")).alias("end")).where("id <> end")
    first = settled(
        near(stars.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()), "pairs"
    )

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select("a").union(pairs.select("b")).select(F.col("a").alias("id")).distinct()

    known = settled(ends(first), "ends")
    sets = settled(_set_table(docs, known, words), "sets")
    links = settled(_confirmed(first, sets, percent), "confirmed")
    reached = settled(components(links), "reached")

    # Second round: within buckets that still hold several components, between these.
    placed = members.join(reached, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = settled(placed.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l < h"), "mixed")
    open_rows = settled(placed.join(mixed.select("key"), "key", "left_semi").join(bits, "id"), "open")
    x = open_rows.select("key", F.struct("id", "c", "packed").alias("x"))
    y = open_rows.select("key", F.struct("c", "packed").alias("y"))
    hopeful = x.join(
        y, (x["key"] == y["key"]) & (F.col("x.c") != F.col("y.c")) & (_estimate("x", "y") >= floor), "left_semi"
    )
    hopeful = settled(hopeful.select("key", "x.*"), "hopeful")
    more = settled(hopeful.select("id").distinct().join(known, "id", "left_anti"), "ends")
    all_sets = sets.unionByName(settled(_set_table(docs, more, words), "sets"))
    links = settled(links.unionByName(_links_across(hopeful, classes, all_sets, percent, floor)), "confirmed")
    reached = settled(components(links), "reached")

    named = settled(
        classes.select("f1", "f2", "n_shingles", "id")
        .join(reached, "id", "left")
        .select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("c")),
        "named",
    )
    found = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without all but one of each near-duplicate group; columns as they came."""
    kept = near_duplicates(docs, percent=percent).where("not kept").select("doc_id").distinct()
    return docs.join(settled(kept, "dropped"), "doc_id", "left_anti").select(*docs.columns)
