"""Grouping rows by a key that may be hot, and connected components.

``slots`` never brings the rows of a key together: rows are spread over ``salts`` slots per key,
each slot is reduced by a combining aggregate, and only the at most ``salts`` slot rows of a key meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

SALTS = 32  # slots of a key at least
SLOT = 1_000_000  # rows of a slot, were one key to hold the whole table


def salt(id_col: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")


def salts_for(rows: DataFrame) -> int:
    """The number of slots for a written table: its counted rows decide how many tasks a hot key may need."""
    return max(SALTS, -(-rows.count() // SLOT))


def slots(keyed: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """``(keys, salt) -> first_id, copies`` for a frame with ``keys``, ``salt`` and ``id_col``.

    ``first_id`` is the smallest id of the whole key and ``copies`` its number of rows.
    """
    local = keyed.groupBy(*keys, "salt").agg(F.min(id_col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = local.groupBy(*keys).agg(F.min("_m").alias("first_id"), F.sum("_n").alias("copies"), F.collect_list("salt").alias("_salts"))
    return whole.select(*keys, F.explode("_salts").alias("salt"), "first_id", "copies")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge list ``(a, b)``; the root is the smallest node.

    Alternating large-star and small-star rounds: after each the edges point to smaller nodes, and
    the rounds needed grow with the logarithm of the longest path. Self-loops are ignored and an
    empty edge list gives an empty result. Every round is written to the shared folder.
    """
    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(e)
    for _ in range(max_rounds if before[0] else 0):
        # Large star: every larger neighbour is linked to the smallest of the neighbourhood.
        near = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small)
        scratch.drop(e)
        e, old = after, before
        before = state(e)
        if before == old:
            break
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
