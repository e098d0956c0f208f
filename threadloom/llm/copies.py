"""Problem 2: duplicates hidden by formatting differences.

Method: the code points of a batch stream through the skip-and-fold table into rolling polynomial
hashes (``arrays.content_hashes``), so no canonical string is ever built. Rows with one hash are then
verified against their record's first row by a two-pointer comparison that skips what the table skips.

A text made wholly of three or more ``name: value`` fields, set apart by ``;``, ``|`` or line breaks,
gets a second key, the sum of its fields' hashes, which does not depend on their order. Rows joined
by either key are one record, also through a third row.

Defined results: null texts and texts without letter or digit belong to no record and are not
reported; ``row_id`` ties (repeated rows) count as copies but are reported once; other columns of the
input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import arrays as A
from threadloom.llm.groups import components, salt, salts_for, slots
from threadloom.llm.near import texts_near_nodes
from threadloom.session import Scratch, ship

_BREAK = re.compile(r"[;|\r\n\u2028\u2029\x85]")
_FIELD = re.compile(r"\s*[^\W_][^:]*:(?=.*[^\W_])", re.S)


def fields_of(text: str) -> list[str] | None:
    """The fields of a text made wholly of three or more ``name: value`` fields, else None."""
    parts = [p for p in _BREAK.split(text) if p.strip()]
    if len(parts) >= 3 and all(_FIELD.match(p) for p in parts):
        return parts
    return None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, text in A.chunks(batch.column("text")):
            t = A.texts_of(text)
            h, kept = A.content_hashes(t)
            # Only a text with two breaks and three colons can be a record.
            colons = np.concatenate([[0], np.cumsum(t.cps == 58)])[t.start]
            maybe = np.flatnonzero((np.diff(colons) >= 3) & (kept > 0))
            order_free = np.zeros(len(h), np.uint64)
            is_record = np.zeros(len(h), bool)
            for r in maybe:
                parts = fields_of(text[int(r)].as_py())
                if parts:
                    ph, pk = A.content_hashes(A.texts_of(pa.array(parts, pa.large_string())))
                    order_free[r] = A.mix(np.sum(A.mix(ph[pk > 0], 11), dtype=np.uint64), int(3))
                    is_record[r] = True
            ids = batch.column("row_id").slice(i, j - i)
            keep = kept > 0
            yield pa.record_batch(
                [ids.filter(pa.array(keep)), pa.array(A.signed(h)[keep]), pa.array(A.signed(order_free)[keep], mask=~is_record[keep])],
                names=["row_id", "k", "free"],
            )


def same_content(a: str, b: str) -> bool:
    """Whether two texts have the same folded letters and digits: two pointers, both skipping."""
    fold = A.fold_table()
    if "Σ" in a or "Σ" in b:
        a, b = a.lower(), b.lower()
    i = j = 0
    while True:
        while i < len(a) and not fold[ord(a[i])]:
            i += 1
        while j < len(b) and not fold[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if fold[ord(a[i])] != fold[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def _equal_rows(x: A.Texts, y: A.Texts) -> np.ndarray:
    """``same_content`` for each pair of rows: both sides' pointers run over kept characters only."""
    fold = A.fold_table()
    fx, fy = fold[x.cps], fold[y.cps]
    nx = np.concatenate([[0], np.cumsum(fx != 0)])[x.start]
    ny = np.concatenate([[0], np.cumsum(fy != 0)])[y.start]
    same = np.diff(nx) == np.diff(ny)
    px, py = np.flatnonzero(fx), np.flatnonzero(fy)
    rows = np.flatnonzero(same)
    n = np.diff(nx)[rows]
    at = np.repeat(np.cumsum(n) - n, n)
    step = np.arange(n.sum()) - at
    differ = fx[px[np.repeat(nx[rows], n) + step]] != fy[py[np.repeat(ny[rows], n) + step]]
    bad = np.zeros(len(same), bool)
    bad[np.repeat(rows, n)[differ]] = True
    return same & ~bad


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, text in A.chunks(batch.column("text")):
            first = batch.column("first_text").slice(i, j - i)
            ok = _equal_rows(A.texts_of(text), A.texts_of(first))
            for r in np.flatnonzero(~ok):  # records may differ in the order of their fields
                a, b = fields_of(text[int(r)].as_py() or ""), fields_of(first[int(r)].as_py() or "")
                if a and b and len(a) == len(b):
                    left = list(b)
                    for x in a:
                        hit = next((y for y in left if same_content(x, y)), None)
                        if hit is None:
                            break
                        left.remove(hit)
                    ok[r] = not left
            yield pa.record_batch([batch.column("row_id").slice(i, j - i), batch.column("first_id").slice(i, j - i), pa.array(ok)], names=["row_id", "first_id", "ok"])


def _content(text: str) -> str:
    fold = A.fold_table()
    return "".join(chr(c) for c in (fold[ord(x)] for x in (text.lower() if "Σ" in text else text)) if c)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact ordered content of each row and, of records, the sorted contents of its fields."""
    for batch in batches:
        for i, j, text in A.chunks(batch.column("text")):
            texts = text.to_pylist()
            fields = [fields_of(t) for t in texts]
            free = ["|" + "|".join(sorted(filter(None, map(_content, f)))) if f else None for f in fields]
            yield pa.record_batch([batch.column("row_id").slice(i, j - i), pa.array([_content(t) for t in texts], pa.string()), pa.array(free, pa.string())], names=["row_id", "c", "f"])


def record_keys(df: DataFrame, text: str, row_id: str = "row_id") -> DataFrame:
    """``(row_id, k, free)``: the ordered key of each row with content and, of records, the order-free one."""
    ship(df.sparkSession)
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(_keys, "row_id long, k long, free long")


def copies(df: DataFrame, text: str, row_id: str = "row_id") -> DataFrame:
    """``(row_id, first_id)`` for every row with content; ``first_id`` is its record's smallest id."""
    spark = df.sparkSession
    scratch = Scratch(spark, "copies")
    source = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    keyed = scratch.save(record_keys(df, text, row_id))
    salts = salts_for(keyed)
    # Ordered and order-free keys that meet in a record are one key; few rows are records.
    pairs = keyed.where("free is not null").select(F.col("k").alias("a"), F.col("free").alias("b")).distinct()
    roots = components(pairs, scratch)
    # The map covers records' keys only; rows without an entry keep their own key.
    keyed = keyed.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("row_id", F.coalesce("root", "k").alias("k")).withColumn("salt", salt("row_id", salts))
    found = slots(keyed, ["k"]).where("copies > 1")
    members = scratch.save(keyed.join(found, ["k", "salt"]).select("row_id", "salt", "first_id"))
    # Texts of rows without a copy stay where they are: a bitmap of fixed size drops most of them.
    numbered = source.select(F.col("row_id").alias("node"), "text").where("node is not null")
    source = texts_near_nodes(numbered, members.select(F.col("row_id").alias("node"))).withColumnRenamed("node", "row_id")
    firsts = members.select("first_id", "salt").distinct()
    texts = firsts.join(source.withColumnRenamed("row_id", "first_id"), "first_id").select("first_id", "salt", F.col("text").alias("first_text")).dropDuplicates(["first_id", "salt"])
    # A hot record is spread over its salts: each slot meets its own copy of the first row's text.
    checked = scratch.save(members.join(source, "row_id").join(texts, ["first_id", "salt"]).select("row_id", "first_id", "text", "first_text").mapInArrow(_verify, "row_id long, first_id long, ok boolean"))
    # A record with a row that is not its first row's copy (colliding hashes, or rows joined through a third
    # one) is taken apart by exact contents: ordered ones and order-free ones that meet are one record again.
    mixed = checked.where("not ok").select("first_id").distinct()
    good = checked.join(mixed, "first_id", "left_anti").select("row_id", "first_id")
    again = checked.join(mixed, "first_id", "left_semi").select("row_id").distinct().join(source, "row_id")
    exact = scratch.save(again.mapInArrow(_contents, "row_id long, c string, f string"))
    meet = components(exact.where("f is not null").select(F.col("c").alias("a"), F.col("f").alias("b")).distinct(), scratch)
    spare = exact.join(meet.select(F.col("node").alias("c"), "root"), "c", "left").select("row_id", F.coalesce("root", "c").alias("c"))
    low = spare.groupBy("c").agg(F.min("row_id").alias("first_id"))
    alone = keyed.join(members, "row_id", "left_anti").select("row_id", F.col("row_id").alias("first_id"))
    return good.union(spare.join(low, "c").select("row_id", "first_id")).union(alone)


def copies_found(df: DataFrame, text: str, row_id: str = "row_id") -> DataFrame:
    """``(first_row_id, row_id)`` for every row but the first of its record."""
    return copies(df, text, row_id).where("row_id <> first_id").select(F.col("first_id").alias("first_row_id"), "row_id").distinct()


def records(df: DataFrame, text: str, row_id: str = "row_id") -> DataFrame:
    """One row per record: ``first_row_id`` and its number of copies, the first included."""
    return copies(df, text, row_id).groupBy(F.col("first_id").alias("first_row_id")).agg(F.count(F.lit(1)).alias("n_copies"))
