"""Problem 8: encoding a whole corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. Every text of more than ``LEAF`` code points (a few word pieces) is halved
until a part has at most so many; leaves are encoded alone, and neighbours are joined by re-encoding a
window around the cut. The window starts at the left side's last word piece that the cut may have changed
and grows (doubling) until it has a piece boundary that the right side has too.

Why that is exact: pieces are matched from left to right without looking back, so what follows a piece
boundary depends only on the text after it; and a match looks at most ``MARGIN`` characters past its
end. A boundary in the window that lies ``MARGIN`` before the window's end is therefore a boundary of
the whole text, and from a boundary the right side shares, its ids are those of the whole text.
Decoding halves the ids and concatenates bytes up the tree; a character's bytes may lie in two leaves,
so they are read as text at the root only.

Defined results: null and empty texts give an empty list, and an empty or null list the empty text; white
space is text like any other; strings that look like special tokens are ordinary text; repeated rows are
encoded each. The vocabulary file is a parameter and must be readable on every executor.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published word-piece pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
MARGIN = 3
CACHE = 200_000


class Node:
    """``text[start:end]`` encoded alone: the place of each word piece and its ids."""

    __slots__ = ("end", "ids", "starts")

    def __init__(self, starts: list[int], end: int, ids: list[list[int]]):
        self.starts, self.end, self.ids = starts, end, ids


class Encoder:
    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.leaf = leaf
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        got = self.known.get(text)
        if got is None:
            got = self.plain.encode_ordinary(text)
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(text) <= 64:
                self.known[text] = got
        return got

    def node(self, text: str, a: int, b: int) -> Node:
        starts, ids, at = [], [], a
        for p in self.pieces.findall(text[a:b]):  # the pattern leaves nothing out
            starts.append(at)
            ids.append(self.piece(p))
            at += len(p)
        return Node(starts, b, ids)

    def join(self, text: str, left: Node, right: Node) -> Node:
        ends = left.starts[1:]
        k = bisect_right(ends, left.end - MARGIN)  # pieces that end early enough
        at = left.starts[k]
        first = right.starts[0]
        width = 16
        while True:
            stop = min(first + width, right.end)
            mid = self.node(text, at, stop)
            for n in range(bisect_left(mid.starts, first), bisect_right(mid.starts, stop - MARGIN)):
                r = bisect_left(right.starts, mid.starts[n])
                if r < len(right.starts) and right.starts[r] == mid.starts[n]:
                    return Node(left.starts[:k] + mid.starts[:n] + right.starts[r:], right.end, left.ids[:k] + mid.ids[:n] + right.ids[r:])
            if stop == right.end:
                return Node(left.starts[:k] + mid.starts, right.end, left.ids[:k] + mid.ids)
            width *= 2

    def tree(self, text: str, a: int, b: int) -> Node:
        if b - a <= self.leaf:
            return self.node(text, a, b)
        mid = (a + b) // 2
        return self.join(text, self.tree(text, a, mid), self.tree(text, mid, b))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.tree(text, 0, len(text)).ids)) if text else []

    def bytes_of(self, ids: list[int], a: int, b: int) -> bytes:
        if b - a <= self.leaf:
            return self.plain.decode_bytes(ids[a:b])
        mid = (a + b) // 2
        return self.bytes_of(ids, a, mid) + self.bytes_of(ids, mid, b)

    def decode(self, ids: list[int] | None) -> str:
        return self.bytes_of(ids, 0, len(ids)).decode("utf-8", "replace") if ids else ""


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str = VOCABULARY, leaf: int = LEAF) -> Encoder:
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = Encoder(path, leaf)
    return _encoders[path, leaf]


def _encode(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [e.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    return run


def encode_corpus(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, ids)`` of every row; a narrow job without a shuffle."""
    ship(df.sparkSession)
    source = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_encode(path, leaf), f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", doc_id)


def _decode(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.record_batch([part.column("id"), pa.array([e.decode(x) for x in part.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return run


def decode_corpus(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, text)`` of every row of ids; a narrow job without a shuffle."""
    ship(encoded.sparkSession)
    source = encoded.select(F.col(doc_id).alias("id"), F.col(ids).alias("ids"))
    return source.mapInArrow(_decode(path, leaf), f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", doc_id)
