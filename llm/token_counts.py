"""Exact token counts at every prefix of a text, for counting, truncation and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.bpe import MEMORY, ByteLevel, TrieWalk, segments, vocabulary
from llm.tables import id_and_text

TEXTS = 1024
_SPACES = regex.compile(r"\s+")
_CONTRACTED = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


class PrefixCounts:
    """Token counts of all character prefixes, put together from the counts inside words.

    The words of a prefix are those of the text up to its last word, which may
    be cut short. A cut word is encoded as one word again, but for a cut
    contraction, which falls into its apostrophe and letters, and white space,
    whose run is one word when nothing follows it.
    """

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.walk = TrieWalk(self.vocab)
        self.specials = {s.encode(): (1,) for s in self.vocab.special}
        self.known: dict[str | bytes, tuple[int, ...]] = dict(self.specials)

    def trim(self) -> None:
        """Forget the words learnt when there are too many; between batches only."""
        if len(self.known) > MEMORY:
            self.known = dict(self.specials)

    def learn(self, words: set[str]) -> None:
        for word, _, _, counts in self.walk.words([w for w in words if w not in self.known]):
            if word.isascii():
                own = tuple(counts[1:])
            else:
                ends, at = [], 0
                for char in word:
                    at += len(char.encode("utf-8", "replace"))
                    ends.append(counts[at])
                own = tuple(ends)
            self.known[word] = own

    def split(self, texts: list[str]) -> list[list[str | bytes]]:
        """Words of each text; a special string, which is one token, is given as bytes."""
        out = []
        for text in texts:
            words: list[str | bytes] = []
            for part, own in segments(text, self.vocab.special):
                words += [part.encode()] if own else ByteLevel.split(part)
            out.append(words)
        self.learn(set().union(*out) - self.specials.keys())
        return out

    def total(self, words: list[str | bytes]) -> int:
        known = self.known
        return sum([known[w][-1] for w in words])

    def _inside(self, part: str) -> list[int]:
        """Counts of the non-empty prefixes of a part without special strings."""
        words = ByteLevel.split(part)
        runs = list(_SPACES.finditer(part))
        self.learn({*words, *(m.group() for m in runs), "'", *(w[1] for w in words if w in _CONTRACTED)})
        out, before = [], 0
        for word in words:
            own = self.known[word]
            if word in _CONTRACTED:
                cut = self.known["'"][-1]
                own = (cut, cut + self.known[word[1]][-1])[: len(word) - 1] + own[-1:]
            out += [before + c for c in own]
            before += own[-1]
        for m in runs:
            start = m.start()
            before = out[start - 1] if start else 0
            out[start : m.end()] = [before + c for c in self.known[m.group()]]
        return out

    def counts(self, text: str) -> list[int]:
        """The token count of ``text[:i]``, encoded by itself, for i from 0 to the text's length."""
        out, before, head = [0], 0, ""
        for part, own in segments(text, self.vocab.special):
            if own:
                # A special string that is cut short is ordinary text after what stands before it.
                start = before - (self.total(self.split([head])[0]) if head else 0)
                out += [start + self.total(self.split([head + part[:i]])[0]) for i in range(1, len(part))]
                before, head = before + 1, ""
                out.append(before)
            else:
                inside = self._inside(part)
                out += [before + c for c in inside]
                before, head = before + inside[-1], part
        return out

    def longest_within(self, words: list[str | bytes], text: str, budget: int) -> int:
        """Characters of the longest prefix of ``text``, split into ``words``, of at most ``budget`` tokens.

        Prefixes beyond the first word that ends over the budget cannot return
        under it, unless the word is white space, which a longer run may merge.
        Before it, counts at word ends only grow, so the prefixes from the last
        word end but one that keeps the budget decide.
        """
        used = at = 0
        ends = [(0, 0), (0, 0)]
        for word in words:
            plain = type(word) is str
            used += self.known[word][-1]
            at += len(word) if plain else len(word.decode())
            if not (plain and word.isspace()):
                if used > budget:
                    break
                ends = [ends[1], (at, used)]
        start, before = ends[0]
        counts = self.counts(text[start:at])
        return start + max(i for i, c in enumerate(counts) if before + c <= budget)


_COUNTERS: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """One per worker process, so that words remembered in one task serve the next."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounts(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chars_within`` of every whole text.

    ``n_chars_within`` is the length of the longest prefix that takes at most
    ``limit`` tokens. Null and empty texts have no bytes and no tokens. One row
    for each input row, repeated ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                own.trim()
                part = batch.slice(at, TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                split = own.split(texts)
                totals = [own.total(words) for words in split]
                within = [
                    own.longest_within(words, text, limit) if total > limit else len(text)
                    for words, text, total in zip(split, texts, totals)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([t > limit for t in totals]),
                        pa.array(within, pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars_within"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long"
    )
