"""Encoding and decoding of whole texts with the word-end vocabulary, prefix states shared in a trie."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.bpe import MEMORY, TrieWalk, WordEnds, segments, vocabulary
from llm.tables import id_and_text

TEXTS = 1024


class Encoder:
    """Encodes batches of texts; distinct new words go through the trie together and are remembered."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.walk = TrieWalk(self.vocab)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parted = [
            [(p, None) if own else (None, WordEnds.split(p)) for p, own in segments(t, self.vocab.special)] for t in texts
        ]
        fresh = {w for parts in parted for _, words in parts if words for w in words}
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        for word, ids in self.walk.encode([w for w in fresh if w not in known]):
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for parts in parted:
            raw = b"".join(
                self.vocab.special[s].to_bytes(4, "little") if s is not None else b"".join([known[w] for w in words])
                for s, words in parts
            )
            out.append(np.frombuffer(raw, dtype="<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces: the vocabulary names no decoder."""
        names = self.vocab.names
        return " ".join([names[i] for i in ids.tolist()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that words remembered in one task serve the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray], Encoder]]:
    own = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part.column(0), own.encode([t or "" for t in part.column(1).to_pylist()]), own


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text; null and empty texts have none.

    ``path`` names a vocabulary file that every executor has. One row for each
    input row, repeated ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, encoded, _ in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, as ``encode_texts`` encodes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, encoded, own in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in encoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
