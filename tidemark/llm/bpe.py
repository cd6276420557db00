"""Byte-level BPE encoding and decoding, the vocabulary given as a rank file (one base64 token and its rank a line)."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import SPACE_BEFORE_SPACE, Cache, alone, portions, texts

NONE = 1 << 62
#: Bytes of remembered chunks. Longer ones made of a remembered word and a mark aren't.
REMEMBERED = 256 << 20
SHORT = 6
#: A line break between non-spaces, which no match of the pattern reaches over.
LONE_BREAK = re.compile(r"\n(?<=\S\n)(?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token. A segment tree over its byte positions stores, for each range, the smallest rank of a
    pair that starts there and the leftmost place of it; a merge changes two pairs and removes one, each a logarithmic
    point update."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    low = (1 << shift) - 1
    get = ranks.get
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part before it starts
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while tree[1] != NONE:
        left = tree[1] & low
        right = after[left]
        end = after[left] = after[right]
        tree[size + right] = value = NONE
        if end < n:
            before[end] = left
            rank = get(piece[left : after[end]])
            if rank is not None:
                value = rank << shift | left
        tree[size + left] = value
        first = before[left]
        if first >= 0:
            rank = get(piece[first:end])
            tree[size + first] = NONE if rank is None else rank << shift | first
        for k in (right, left, first) if first >= 0 else (right, left):
            k = size + k >> 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Chunks(Cache):
    """Ids, as little-endian unsigned 32-bit numbers, of chunks."""

    def __init__(self, encode, marks: str):
        super().__init__(encode, REMEMBERED)
        self.marks = {x: encode(x) for x in marks}

    def __missing__(self, chunk: str) -> bytes:
        core, mark = chunk[:-1], chunk[-1:]
        if mark in ".," and core[-1:].isalpha():
            ids = self[core] + self.marks[mark]
            if len(chunk) > SHORT:
                return ids
            self[chunk] = ids
            return ids
        parts = LONE_BREAK.split(chunk)
        if len(parts) > 1:
            return self.marks["\n"].join([self[x] for x in parts])
        return super().__missing__(chunk)


class Encoder:
    """Encodes texts and decodes ids. A space that a non-space follows always begins a match of the pattern when no
    white space follows a space, so such texts are cut there and the ids of each chunk are remembered."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.chunks = Chunks(self._encode, ".,\n")

    def _encode(self, chunk: str) -> bytes:
        ids = [x for piece in self.find(chunk) for x in merge(piece.encode(), self.ranks)]
        return np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if SPACE_BEFORE_SPACE.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.pieces(text))), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids. A null or empty text has no ids; rows that repeat, or lack a doc_id, each give a row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        alone(own.chunks)
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.encode(x) for x in texts(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: the bytes of the ids as UTF-8, what isn't valid replaced by U+FFFD; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        alone(own.chunks)
        for batch in portions(batches):
            out = [own.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded again, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        alone(own.chunks)
        for batch in portions(batches):
            counts, codes, back = [], [], []
            for text in texts(batch):
                ids = own.encode(text)
                counts.append(len(ids))
                codes.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
