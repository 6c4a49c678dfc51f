"""Secrets in texts: fixed shapes by pattern, anything else by sliding-window entropy."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.tables import id_and_text

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")


@dataclass(frozen=True)
class CharacterClass:
    """A window of ``window`` characters is suspect at ``bits`` of entropy per character or more.

    A shorter candidate is one window, its bits scaled as the largest entropy of so many characters.
    """

    name: str
    pattern: re.Pattern
    window: int
    bits: float

    def suspects(self, text: str) -> list[tuple[int, int]]:
        window = min(self.window, len(text))
        bits = self.bits if window == self.window else self.bits * math.log2(window) / math.log2(self.window)
        return suspect_windows(text, window, bits)


#: The narrowest class that holds the whole candidate decides.
CLASSES = (
    CharacterClass("hexadecimal", re.compile(r"[0-9A-Fa-f]+"), 20, 3.0),
    CharacterClass("letters and digits", re.compile(r"[A-Za-z0-9]+"), 20, 3.6),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.9),
)
#: Candidates, or their parts between ``=``, that hold one of these are documentation, not secrets.
ALLOWED = ("example", "sample", "placeholder", "xxxxxx", "0123456789", "abcdefghij")


def suspect_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose Shannon entropy reaches ``bits``, from counts kept up to date.

    With counts c of a window of w characters the entropy is
    log2(w) - sum(c * log2(c)) / w; sliding by one changes two counts only.
    """
    if len(text) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    limit = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for end, char in enumerate(text, 1):
        if end > window:
            gone = text[end - window - 1]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
        c = counts.get(char, 0)
        total += term[c + 1] - term[c]
        counts[char] = c + 1
        if end >= window and total <= limit:
            start = end - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def _parts(run: str, allowed: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    """The whole candidate, or where it holds an allowed word, its parts between ``=`` that hold none; with their starts."""
    if not any(a in run.lower() for a in allowed):
        yield 0, run
        return
    for m in PART.finditer(run):
        if not any(a in m.group().lower() for a in allowed):
            yield m.start(), m.group()


def entropy_spans(text: str, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[int, int]]:
    """Suspect spans of the candidates that mix letters and digits and are not on the allow-list."""
    found = []
    for m in CANDIDATE.finditer(text):
        for at, own in _parts(m.group(), allowed):
            if own.isalpha() or own.isdigit() or not any(c.isdigit() for c in own) or not any(c.isalpha() for c in own):
                continue
            kind = next(k for k in CLASSES if k.pattern.fullmatch(own))
            found += [(m.start() + at + a, m.start() + at + b) for a, b in kind.suspects(own)]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by start, then kind; code points, end exclusive."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and entropy spans that no base span holds already."""
    base = base_spans(text)
    starts = [s for _, s, _ in base]
    reach = [0, *accumulate((e for *_, e in base), max)]  # how far the spans that start so early reach
    more = [("entropy", a, b) for a, b in entropy_spans(text) if b > reach[bisect_right(starts, a)]]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: per row the secrets of the whole text as ``kind, start, end``, by start, then kind.

    Null and empty texts have no spans; every row gives one row, repeated ids too.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced by ``mask``; null texts stay null."""

    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, mask) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def masked(text: str, mask: str) -> str:
    parts, at = [], 0
    for _, start, end in secret_spans(text):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]
