"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a piece of text ends in exactly one token, and a token t may
follow the encoding of a shorter prefix if and only if the last token of that prefix and t
stay as they are when both are encoded together. So one table, the last token of each
prefix, holds the encodings of all prefixes: appending bytes extends the table and changes
nothing before, and after an edit only the entries behind it are made anew.

Text is first split into pieces by the tokenizer's pattern, as usual; no token spans two of
them. Pieces repeat, so each task keeps the encodings it has made, up to a bound.

Defined results: null and empty texts have the empty list of ids. Lone surrogates can't
occur in Spark strings. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches

#: Where the vocabulary files lie; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The pattern that splits text into pieces (fixed values of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES, KEPT_PAIRS = 200_000, 1_000_000
KEPT_LENGTH = 64


class Vocabulary:
    """Ranks of a byte-level vocabulary, and which tokens may follow which."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self.lengths = sorted({len(b) for b in ranks})
        self.suffix_lengths: dict[int, list[int]] = {}
        by_end: dict[int, set[int]] = {}
        for b in ranks:
            by_end.setdefault(b[-1], set()).add(len(b))
        self.suffix_lengths = {e: sorted(n, reverse=True) for e, n in by_end.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                two = self._merge(b, i)
                if len(two) == 2:
                    self.parts[i] = (two[0], two[1])
                    self.merged[two[0], two[1]] = i

    def _merge(self, b: bytes, below: int) -> list[int]:
        """Plain merging of b by the tokens of a rank under below."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their bytes are encoded together.

        Undoes the merges of both, latest first, along the border; if at any time the two
        tokens at the border have a merge that ranks before the merge undone last, they
        would have been merged with each other.
        """
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.token)
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                if a not in self.parts:
                    if b not in self.parts:
                        return True
                    limit, b = b + 1, self.parts[b][0]
                else:
                    a = self.parts[a][1]
            else:
                if b not in self.parts:
                    if a not in self.parts:
                        return True
                    limit, a = a, self.parts[a][1]
                else:
                    limit, b = b + 1, self.parts[b][0]


class Prefixes:
    """The last token of every prefix of a piece of bytes, in which bytes can be appended or replaced."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.v = vocabulary
        self.bytes = bytearray()
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.bytes)
        self.bytes += more
        text, last, v = bytes(self.bytes), self.last, self.v
        ranks, compatible = v.ranks, v.compatible
        for end in range(start + 1, len(text) + 1):
            for n in v.suffix_lengths[text[end - 1]]:
                if n > end:
                    continue
                t = ranks.get(text[end - n : end])
                if t is not None and (n == end or compatible(last[end - n - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace bytes[start:stop]; the table before start is kept."""
        tail = bytes(self.bytes[stop:])
        del self.bytes[start:], self.last[start:]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= len(self.v.token[t])
        return out[::-1]


@functools.lru_cache(4)
def vocabulary(file: bytes) -> Vocabulary:
    """The vocabulary of the contents of its file."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in file.splitlines() if x.strip())})


class Encoder:
    def __init__(self, file: bytes) -> None:
        self.v = vocabulary(file)
        self.pieces = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def piece(self, p: str) -> list[int]:
        b = p.encode()
        t = self.v.ranks.get(b)
        ids = [t] if t is not None else Prefixes(self.v, b).ids()
        if len(p) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[p] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            kept, piece, extend = self.kept.get, self.piece, out.extend
            for p in self.pieces(text):
                extend(kept(p) or piece(p))
        return out


@functools.lru_cache(4)
def encoder(file: bytes) -> Encoder:
    return Encoder(file)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The file of a vocabulary, read by the driver and sent with the job; a megabyte or so."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): one row for each row of documents, in no order; no shuffle."""
    file = shipped(documents.sparkSession, vocabulary_path(name, folder))
    src = documents.select(key, text)

    def make():  # noqa: ANN202
        enc = encoder(file.value).encode

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [enc(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

        return batch

    return map_batches(src, make, f"{key} {src.schema[key].dataType.simpleString()}, ids array<int>")


def sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): the number of ids of each text; the ids don't leave the Python worker."""
    file = shipped(documents.sparkSession, vocabulary_path(name, folder))
    src = documents.select(key, text)

    def make():  # noqa: ANN202
        enc = encoder(file.value).encode

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([len(enc(t)) for t in b.column(1).to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), n], names=[key, "n_tokens"])

        return batch

    return map_batches(src, make, f"{key} {src.schema[key].dataType.simpleString()}, n_tokens long")


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(documents, same), one row: the texts, and those whose ids give their bytes back; null counts as empty."""
    file = shipped(documents.sparkSession, vocabulary_path(name, folder))

    def make():  # noqa: ANN202
        enc = encoder(file.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            same = [b"".join(map(enc.v.token.__getitem__, enc.encode(t))) == (t or "").encode() for t in b.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(same)], names=["same"])

        return batch

    rows = map_batches(documents.select(text), make, "same boolean")
    return rows.agg(F.count("*").alias("documents"), F.count_if("same").alias("same"))
