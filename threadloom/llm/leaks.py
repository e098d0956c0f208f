"""Problem 9: evaluation texts leaking into training text.

Method: a broadcast hash set of the items' normalised ``n``-word windows; training texts are scanned
window by window with rolling hashes, each hit is verified word by word, and leaked spans or documents
can be removed. The set is held as a few arrays (about 100 bytes a window) and broadcast only while it has
at most ``MAX_WINDOWS`` windows (checked by a count), 50 MB; beyond that the windows are joined through a
shuffle, with the same result.

Defined results: null, empty and short texts match nothing; items of fewer than ``n`` words match
nothing; repeated items and documents give one row per pair of ids; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import arrays as A
from threadloom.session import ship

WORDS = 12
MAX_WINDOWS = 500_000
DDL = "doc_id long, item_id long, first_char long, last_char long"


def _word_list(f: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, n: int) -> list[bytes]:
    return [f[start[k] : end[k]].tobytes() for k in range(a, a + n)]


def windows(t: A.Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, folded) of the words, and (first word, hash) of the ``n``-word windows."""
    row, start, end, f = A.words(t)
    h = A.spans_hash(f, start, end)
    first = np.arange(max(len(row) - n + 1, 0))
    first = first[row[first] == row[first + n - 1]]
    return row, start, end, f, first, A.spans_hash(h, first, first + n, 3)


class Items:
    """The items' windows by hash, for the broadcast: one array of characters, word places and window starts."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        t = A.texts_of(pa.array(texts, pa.large_string()))
        row, self.start, self.end, self.chars, first, h = windows(t, n)
        order = np.argsort(h, kind="stable")
        self.n, self.hash, self.first = n, h[order], first[order]
        self.item = np.array(ids, np.int64)[row[self.first]] if len(first) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hash)

    def same(self, x: int, f: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> bool:
        """Whether window ``x`` has the words of a text from its word ``k`` on."""
        return _word_list(self.chars, self.start, self.end, int(self.first[x]), self.n) == _word_list(f, start, end, k, self.n)


def _scan(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                t = A.texts_of(text)
                row, start, end, f, first, h = windows(t, items.n)
                lo, hi = np.searchsorted(items.hash, h, "left"), np.searchsorted(items.hash, h, "right")
                ids = batch.column("doc_id").slice(i, j - i).to_numpy(zero_copy_only=False)
                out = []
                for w in np.flatnonzero(hi > lo):
                    k = int(first[w])
                    out += [(ids[row[k]], items.item[x], start[k] - t.start[row[k]], end[k + items.n - 1] - t.start[row[k]]) for x in range(lo[w], hi[w]) if items.same(x, f, start, end, k)]
                if out:
                    yield pa.record_batch([pa.array(np.array(c, np.int64)) for c in zip(*out)], names=["doc_id", "item_id", "first_char", "last_char"])

    return run


def _spell(n: int):
    """Every window as (id, hash, its words), for the shuffle join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                t = A.texts_of(text)
                row, start, end, f, first, h = windows(t, n)
                ids = batch.column("id").slice(i, j - i).to_numpy(zero_copy_only=False)
                spelled = [b"\x00\x00\x00\x00".join(_word_list(f, start, end, int(k), n)) for k in first]
                yield pa.record_batch(
                    [pa.array(ids[row[first]]), pa.array(A.signed(h)), pa.array(spelled, pa.binary()), pa.array(start[first] - t.start[row[first]]), pa.array(end[first + n - 1] - t.start[row[first]])],
                    names=["id", "h", "w", "first_char", "last_char"],
                )

    return run


def leak_windows(docs: DataFrame, items: DataFrame, n: int = WORDS, max_windows: int = MAX_WINDOWS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc_id, item_id, first_char, last_char)`` of every leaked window."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    # A text has no more windows than half its characters.
    bound = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 2
    if bound <= max_windows:
        rows = items.collect()
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], n))
        return docs.mapInArrow(_scan(shared), DDL)
    ddl = "id long, h long, w binary, first_char long, last_char long"
    left = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_spell(n), ddl).withColumnRenamed("id", "doc_id")
    right = items.select(F.col("item_id").alias("id"), "text").mapInArrow(_spell(n), ddl).select(F.col("id").alias("item_id"), "h", "w").distinct()
    return left.join(right, ["h", "w"]).select("doc_id", "item_id", "first_char", "last_char")


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id)``: the document holds at least ``n`` consecutive words of the item."""
    return leak_windows(docs, items, **options).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per leaked item the number of documents that hold part of it."""
    return leaks(docs, items, **options).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def _cut(text: str, spans: list) -> str:
    out, at = [], 0
    for a, b in sorted((s["first_char"], s["last_char"]) for s in spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [t if s is None or t is None else _cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string()), batch.column("n_leaked")], names=["doc_id", "text", "n_leaked"])


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(doc_id, text, n_leaked)``: every document with its leaked spans cut out."""
    spans = leak_windows(docs, items, **options).groupBy("doc_id").agg(F.collect_set(F.struct("first_char", "last_char")).alias("spans"), F.countDistinct("item_id").alias("n_leaked"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans", F.coalesce("n_leaked", F.lit(0)).alias("n_leaked"))
    return joined.mapInArrow(_remove, "doc_id long, text string, n_leaked long")
