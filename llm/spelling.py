"""Spelling variants: words one edit apart, found through blocked Bloom filters of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.tables import id_and_text, settled
from llm.textscan import _powers, mix

LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.int64)
_RUN, _BREAK = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
PIECE, DISTINCT, ROWS = 1 << 18, 200_000, 1 << 14

LANES = 8
#: Blocks of 64 bytes in one broadcast page of the filters: 16 MB, whatever the vocabulary.
PAGE_BLOCKS = 1 << 18
#: Words of this length or more share a shard; there each word gets a block of its own.
LONGEST = 32
BITS, LONG_BITS = 16, 512
WORDS_CHARS, EDIT_CHARS = 1 << 13, 1 << 11

_SECOND = np.uint64(0xA0761D6478BD642F)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def corpus_words(docs: DataFrame, least_chars: int = 5, drop_every: int = 97) -> DataFrame:
    """``word, n``: lower-cased letter runs of all texts, with the seeded deletions, of ``least_chars`` code points or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            held = iter(total.items())
            while part := list(islice(held, ROWS)):
                words, counts = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                raw = value.as_py()
                if not raw:
                    continue
                text = raw.lower().decode("utf-8", "replace")  # of bytes: A-Z only
                doc = key.as_py()
                head = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                own: Counter[str] = Counter()
                at = 0
                while at < len(text):
                    cut = _BREAK.search(text, at + PIECE)
                    end = cut.start() if cut else len(text)
                    own.update(_RUN.findall(text, at, end))
                    at = end
                for run, n in own.items():
                    if len(run) < least_chars:
                        continue
                    h = zlib.crc32(run.encode(), head)
                    if h % drop_every == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least_chars:
                            continue
                    total[run] += n
                if len(total) >= DISTINCT:
                    yield from flush()
        yield from flush()

    counted = docs.mapInArrow(scan, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class WordHashes:
    """Polynomial hashes of words, and of every string one deletion or replacement away, without building the strings."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.codes)) - self.starts[self.owner]
        up, down = _powers(int(self.lengths.max()) + 1)
        self.up, self.inverse = up, down[1]
        self.weighted = self.codes.astype(np.uint64) * up[self.at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.weighted, dtype=np.uint64)])
        self.whole = sums[self.starts[1:]] - sums[self.starts[:-1]]
        self.before = sums[:-1] - sums[self.starts[self.owner]]

    @staticmethod
    def _final(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(raw + length.astype(np.uint64) * _LENGTH)

    def own(self) -> np.ndarray:
        return self._final(self.whole, self.lengths)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Position in the joined codes, hash; of equal neighbours only the last is deleted, as all give the same string."""
        last = np.ones(len(self.codes), dtype=bool)
        last[:-1] = (self.codes[1:] != self.codes[:-1]) | (self.owner[1:] != self.owner[:-1])
        i = np.flatnonzero(last)
        after = self.whole[self.owner[i]] - self.before[i] - self.weighted[i]
        return i, self._final(self.before[i] + after * self.inverse, self.lengths[self.owner[i]] - 1)

    def replacements(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position, letter, hash, in bounded pieces; only by larger letters, the smaller ones being the other word's edits."""
        for a in range(0, len(self.codes), EDIT_CHARS):
            i, c = np.nonzero(self.codes[a : a + EDIT_CHARS, None] < LETTERS)
            i += a
            raw = self.whole[self.owner[i]] + (LETTERS[c] - self.codes[i]).astype(np.uint64) * self.up[self.at[i]]
            yield i, LETTERS[c], self._final(raw, self.lengths[self.owner[i]])


def word_slices(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of bounded total length, or of one longer word."""
    start = chars = 0
    for i, w in enumerate(words):
        if i > start and chars + len(w) > WORDS_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(w)
    if words:
        yield start, len(words)


class Shards:
    """Where each length's filter lies in the row of blocks."""

    def __init__(self, held: dict[int, int]):
        self.blocks = np.zeros(LONGEST + 1, dtype=np.uint64)
        for shard, words in held.items():
            self.blocks[shard] = -(-words * (BITS if shard < LONGEST else LONG_BITS) // (64 * LANES))
        self.first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.blocks)[:-1]])
        self.total = int(self.blocks.sum())

    def place(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and whether words of its length exist at all."""
        shard = np.minimum(lengths, LONGEST)
        n = self.blocks[shard]
        return (self.first[shard] + ((hashes >> np.uint64(32)) * n >> np.uint64(32))).astype(np.int64), n > 0


def _bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    return np.uint64(1) << ((hashes >> np.uint64(6 * lane)) & np.uint64(63))


def _filled(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """``block, l0 .. l7``: the blocked filters as rows; a word sets one bit in each lane of one block."""
    names = ["block", *[f"l{i}" for i in range(LANES)]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for a, b in word_slices(words):
                own = WordHashes(words[a:b])
                hashes = own.own()
                second = mix(hashes ^ _SECOND)
                lanes = [pa.array(_bits(second, i).view(np.int64)) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(shards.place(hashes, own.lengths)[0]), *lanes], names)

    rows = vocabulary.select("word").mapInArrow(scan, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names[1:]])


def _positives(vocabulary: DataFrame, shards: Shards, page: np.ndarray, first: int) -> DataFrame:
    """``word, n, other``: edits that the filters of one page, blocks ``first`` and on, may hold."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(page)

    def probe(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        block, known = shards.place(hashes, lengths)
        block -= first
        at = np.flatnonzero(known & (block >= 0) & (block < len(shared.value)))
        block, second = block[at], mix(hashes[at] ^ _SECOND)
        for lane in range(LANES):
            hit = np.flatnonzero(shared.value[block, lane] & _bits(second, lane))
            at, block, second = at[hit], block[hit], second[hit]
        return at

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for a, b in word_slices(words):
                own = WordHashes(words[a:b])

                def found(spots: np.ndarray, letters: list[str], a: int = a, own: WordHashes = own) -> pa.RecordBatch:
                    rows = own.owner[spots]
                    others = [own.words[r][:k] + c + own.words[r][k + 1 :] for r, k, c in zip(rows.tolist(), own.at[spots].tolist(), letters)]
                    held = batch.take(pa.array(rows + a))
                    return pa.RecordBatch.from_arrays([*held.columns, pa.array(others, pa.string())], ["word", "n", "other"])

                i, hashes = own.deletions()
                i = i[probe(hashes, own.lengths[own.owner[i]] - 1)]
                yield found(i, [""] * len(i))
                for i, letters, hashes in own.replacements():
                    hit = probe(hashes, own.lengths[own.owner[i]])
                    yield found(i[hit], [chr(c) for c in letters[hit].tolist()])

    return vocabulary.select("word", "n").mapInArrow(scan, "word string, n long, other string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: each pair of words of ``vocabulary(word, n)`` one edit apart, once.

    Every word's deletions and replacements are probed against Bloom filters
    sharded by length (the insertions are the other word's deletions); only
    positives are shuffled, to a join with the vocabulary that decides. Filters
    are broadcast in pages of 16 MB, one after another, so no broadcast grows
    with the vocabulary.
    """
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST))
    shards = Shards(dict(vocabulary.groupBy(shard.alias("s")).count().collect()))
    filled = settled(_filled(vocabulary, shards), "bloom")
    found = []
    for first in range(0, shards.total, PAGE_BLOCKS):
        page = np.zeros((min(PAGE_BLOCKS, shards.total - first), LANES), dtype=np.uint64)
        rows = filled.where(F.col("block").between(first, first + len(page) - 1)).toArrow()
        at = rows.column("block").to_numpy() - first
        for lane in range(LANES):
            page[at, lane] = rows.column(f"l{lane}").to_numpy().view(np.uint64)
        found.append(settled(_positives(vocabulary, shards, page, first), "edits"))
    if not found:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return reduce(DataFrame.unionByName, found).join(known, "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the end of each chain of forms, each round doubling the step."""
    ends = settled(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settled(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(
    docs: DataFrame, least_chars: int = 5, least_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``least_chars`` code points and ``least_count`` occurrences or more.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where 97 divides
    the crc32 of ``<doc_id>:<run>``, the run loses one code point; a null id is
    hashed as an empty one. Near words differ by exactly one inserted, deleted or
    replaced code point. The form is the near word of largest count, ties to the
    smallest in code-point order, if it occurs ``ratio`` times as often; else null.
    The root is the last word of the chain of forms, the word itself without one.

    Null and empty texts have no words; a table without words gives an empty
    result. Rows that repeat an id count as often as they appear. Texts are read
    in pieces and counts are added up within a task before the shuffle, so
    neither a long text nor a frequent word gathers in one place. A word has at
    most as many near words as edits.
    """
    words = corpus_words(id_and_text(docs, id_col, text_col), least_chars)
    vocabulary = settled(words.where(F.col("n") >= least_count), "vocabulary")
    pairs = settled(near_pairs(vocabulary), "near")
    both = pairs.unionByName(
        pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.minus")
    held = form_n >= ratio * F.col("n")
    table = settled(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(held, F.col("best.form")).alias("form"), F.when(held, form_n).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
