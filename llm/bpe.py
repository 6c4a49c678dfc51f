"""Byte-pair encoding over the public vocabularies by last-token states.

A token sequence is the encoding of its text exactly when every two neighbours
are the encoding of theirs. So the encoding of a prefix is that of a shorter
prefix and one last token, and one last token only fits. A prefix thus needs no
more state than its last token and its token count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import regex

#: A token's final unit, where it closes a word, moves to this private plane, so that every unit is one character.
_CLOSED = 0xF0000
_NEVER = 1 << 60
#: Remembered words; the memory starts anew beyond, which costs time only.
MEMORY = 200_000
#: Remembered answers to whether one token may follow another, likewise.
_PAIRS = 1_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


_BYTES = byte_characters()


class Vocabulary:
    """Tokens as strings of units, their ids, and which token may follow which."""

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        model = data["model"]
        self.closing = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = {self._units(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.token = {i: t for t, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self._units(a), self._units(b)): r for r, (a, b) in enumerate(pairs)}
        self.known_pairs: dict[int, bool] = {}
        self._link()

    def _link(self) -> None:
        """An automaton over the tokens: its state after some units names every token that ends there."""
        self.step: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        for token, i in self.ids.items():
            at = 0
            for unit in token:
                to = self.step[at].get(unit)
                if to is None:
                    to = self.step[at][unit] = len(self.step)
                    self.step.append({})
                    ends.append([])
                at = to
            ends[at].append((i, len(token)))
        self.back = [0] * len(self.step)
        queue = list(self.step[0].values())
        for at in queue:  # breadth first: the list grows while it is read
            for unit, to in self.step[at].items():
                queue.append(to)
                low = self.back[at]
                while low and unit not in self.step[low]:
                    low = self.back[low]
                self.back[to] = self.step[low].get(unit, 0)
            ends[at] += ends[self.back[at]]
        self.ends = ends

    def _units(self, token: str) -> str:
        if self.closing and token.endswith(self.closing):
            token = token[: -len(self.closing)]
            return token[:-1] + chr(_CLOSED + ord(token[-1]))
        return token

    def units(self, word: str) -> str:
        """A word as units: its bytes, the last one closing where the vocabulary has word ends."""
        out = "".join([_BYTES[b] for b in word.encode("utf-8", "replace")])
        return out[:-1] + chr(_CLOSED + ord(out[-1])) if self.closing else out

    def merged(self, units: str) -> list[str]:
        """Plain merging, lowest rank first, then leftmost; for short strings."""
        parts = list(units)
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, _NEVER) for pair in zip(parts, parts[1:])]
            rank = min(ranks)
            at = ranks.index(rank)
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` is itself when encoded after ``before`` (-1: at the start of a word)."""
        if len(self.known_pairs) > _PAIRS:
            self.known_pairs.clear()
        own = [self.token[i] for i in (before, token) if i >= 0]
        fit = self.known_pairs[(before << 20) + token] = self.merged("".join(own)) == own
        return fit


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TrieWalk:
    """Depth-first walk over the trie of a set of words.

    In sorted order the next word shares its longest common prefix with the
    path to the word before it; states of that prefix stay on the stack and
    only the nodes below it are worked out. The trie is never built.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def words(self, words: Iterable[str]) -> Iterator[tuple[str, str, list[str], list[int]]]:
        """``(word, units, last, counts)``: last token and token count at every prefix; the lists are reused."""
        vocab = self.vocab
        step, back, ends, follows, known = vocab.step, vocab.back, vocab.ends, vocab.follows, vocab.known_pairs
        last, counts, states, path = [-1], [0], [0], ""
        for units, word in sorted([(vocab.units(w), w) for w in words]):
            shared, most = 0, min(len(path), len(units))
            while shared < most and path[shared] == units[shared]:
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(units) + 1):
                unit = units[end - 1]
                while state and unit not in step[state]:
                    state = back[state]
                state = step[state].get(unit, 0)
                options = ends[state]
                for option in options:
                    token, length = option
                    start = end - length
                    key = (last[start] << 20) + token
                    if known[key] if key in known else follows(last[start], token):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        states.append(state)
                        if option is not options[0]:  # what fitted last is tried first next time
                            options.remove(option)
                            options.insert(0, option)
                        break
                else:
                    raise ValueError(f"no token ends at unit {end} of {word!r}")
            path = units
            yield word, units, last, counts

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        token = self.vocab.token
        for word, units, last, _ in self.words(words):
            out, at = [], len(units)
            while at:
                out.append(last[at])
                at -= len(token[last[at]])
            yield word, out[::-1]


class WordEnds:
    """Text to words for the vocabulary with word ends: composed, lower case, white space dropped."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    @classmethod
    def split(cls, text: str) -> list[str]:
        # Lower-casing goes by single characters: no final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return cls.pattern.findall(text)


class ByteLevel:
    """Text to words for the byte-level vocabulary: a word takes the space before it along."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    @classmethod
    def split(cls, text: str) -> list[str]:
        return cls.pattern.findall(text)


def segments(text: str, special: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """The text cut at special strings: ``(part, is_special)``."""
    if not any(s in text for s in special):
        if text:
            yield text, False
        return
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
    for i, part in enumerate(cut.split(text)):
        if part:
            yield part, i % 2 == 1
