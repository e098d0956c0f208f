"""Problem 10: long exact spans shared between records.

Method: prefix-partitioned suffix trees. Suffixes are split into memory-sized groups by prefixes of
variable length, and the deep internal nodes of each group's subtree give the repeats.

Only suffixes that start at *anchors* enter the trees: an anchor is the leftmost smallest hash of
``SEED`` characters among the starts in a window of ``LENGTH`` characters. Whether a place in a window
is its anchor depends on the window's text alone, so every window that occurs twice holds the same
anchor at the same offset, and nothing is missed although about one suffix in seventy is kept. What
lies left of an anchor is compared backwards, so a node of depth ``r`` gives the span ``l + r``.

Equal surroundings of an anchor are one leaf, whatever the number of documents that hold them; a combining
aggregate finds them first, so copies never meet in a task. Groups of leaves share a *prefix*: the ``R``
characters from the anchor on and the ``L`` before it, ``(0, SEED)`` at first. A group of more than ``GROUP``
leaves is split by longer prefixes, step by step until it fits: two leaves with ``l`` and ``r`` common
characters, ``l + r >= LENGTH``, have either ``r >= R'`` or ``l >= LENGTH - R' + 1``, so they meet under
``(L, R')`` or under ``(LENGTH - R' + 1, R)``. Where ``L + R`` reaches ``LENGTH`` and a group is still too
large, its root is itself a deep internal node: the group is cut into slots, each of which also gets the
leaves of the smallest and the largest document. Every group and slot goes through its tree.

Defined results: null texts and texts shorter than the length have no spans; a span repeated inside
one text only is not shared; equal texts of different ids are shared whole; repeated rows of one id
are one text; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import arrays as A
from threadloom.session import Scratch, ship

U = np.uint64
LENGTH = 200
SEED = 64
GROUP = 2_000
SEGMENT = 1 << 22
ROWS = 2_000  # surroundings that leave a task at a time


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all ``w``-long windows: block-wise running minima from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(cps: np.ndarray, start: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed hash) of the anchors of texts laid end to end."""
    pos, hashes = [], []
    w = length - seed + 1
    for a in range(0, max(len(cps), 1), SEGMENT):  # windows that start in this segment
        part = cps[a : a + SEGMENT + length - 1]
        if len(part) < length:
            break
        at = np.arange(len(part) - seed + 1)
        h = A.spans_hash(part, at, at + seed)
        low = (h >> U(24)) << U(24) | at.astype(U)
        least = _sliding_min(low, w)
        first = np.arange(len(least)) + a
        row = np.searchsorted(start, first, side="right") - 1
        inside = first + length <= start[row + 1]
        p = np.unique((least[inside] & U((1 << 24) - 1)).astype(np.int64))
        pos.append(p + a)
        hashes.append(h[p])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, U)
    p, k = np.unique(np.concatenate(pos), return_index=True)
    return p, np.concatenate(hashes)[k]


def _anchor_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                t = A.texts_of(text, lower_sigma=False)
                p, h = anchors(t.cps, t.start, length, seed)
                r = t.row_of(p)
                ids = batch.column("doc_id").slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(A.signed(h)), pa.array(ids[r]), pa.array(p - t.start[r])], names=["seed", "doc_id", "pos"])

    return run


def _contexts(length: int, seed: int):
    """One row per shared anchor: its text to the left, reversed, and to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py()
                pos = np.unique(batch.column("at")[i].values.to_numpy(zero_copy_only=False))
                for k in range(0, len(pos), ROWS):
                    some = pos[k : k + ROWS]
                    back = [text[max(0, p - (length - seed)) : p][::-1] for p in some.tolist()]
                    ahead = [text[p : p + length] for p in some.tolist()]
                    yield pa.record_batch([pa.array([doc] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(back, pa.string()), pa.array(ahead, pa.string())], names=["doc_id", "pos", "back", "ahead"])

    return run


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _best_elsewhere(order: list[int], common: list[int], docs: list[int]) -> dict[int, int]:
    """For each element of a sorted list, its longest common prefix with one of another document."""
    best = dict.fromkeys(order, -1)
    for step in (1, -1):
        seq = order if step == 1 else order[::-1]
        gaps = common if step == 1 else common[::-1]
        far = -1  # common prefix with the last element of another document
        for n in range(1, len(seq)):
            if docs[seq[n]] != docs[seq[n - 1]]:
                far = gaps[n - 1]
            elif far >= 0:
                far = min(far, gaps[n - 1])
            best[seq[n]] = max(best[seq[n]], far)
    return best


def tree_spans(docs: list[int], back: list[str], ahead: list[str], length: int) -> set[tuple[int, int, int]]:
    """Shared spans ``(leaf, characters before the anchor, characters from it on)`` from one group's suffix tree.

    The tree is held as its sorted suffixes and their common prefixes; an internal node is an interval
    whose smallest common prefix is the node's depth.
    """
    order = sorted(range(len(docs)), key=ahead.__getitem__)
    common = [_common(ahead[a], ahead[b]) for a, b in zip(order, order[1:])]
    out: set[tuple[int, int, int]] = set()
    stack = [(0, len(order) - 1)]
    while stack:
        i, j = stack.pop()
        if i >= j or len({docs[x] for x in order[i : j + 1]}) < 2:
            continue
        depth = min(common[i:j])
        back_order = sorted(order[i : j + 1], key=back.__getitem__)
        back_common = [_common(back[a], back[b]) for a, b in zip(back_order, back_order[1:])]
        for x, left in _best_elsewhere(back_order, back_common, docs).items():
            if left >= 0 and left + depth >= length:
                out.add((x, left, depth))
        a = i
        for k in range(i, j + 1):
            if k == j or common[k] == depth:
                if k > a:
                    stack.append((a, k))
                a = k + 1
    return out


def _trees(length: int):
    """Leaves sorted by group and slot in, ``(leaf, before, after)`` out."""
    columns = ("g", "slot", "k1", "k2", "lo", "hi", "back", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []

        def close(leaves: list[tuple]) -> None:
            # A leaf of several documents differs from every other one and is shared by itself.
            docs = [x[4] if x[4] == x[5] else ("several", n) for n, x in enumerate(leaves)]
            spans = {(n, len(x[6]), len(x[7])) for n, x in enumerate(leaves) if x[4] != x[5] and len(x[6]) + len(x[7]) >= length}
            if len(leaves) > 1:
                spans |= tree_spans(docs, [x[6] for x in leaves], [x[7] for x in leaves], length)
            got.extend((leaves[n][2], leaves[n][3], before, after) for n, before, after in spans)

        def send() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*got)], names=["k1", "k2", "before", "after"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if group and group[0][:2] != row[:2]:
                    close(group)
                    group = []
                group.append(row)
            if len(got) > 10_000:
                yield send()
                got.clear()
        if group:
            close(group)
        if got:
            yield send()

    return run


def _longer(leaves: DataFrame, length: int) -> DataFrame:
    """The leaves of too large groups under the two longer prefixes of each."""
    half = F.expr(f"(r + {length} - l + 1) div 2").cast("int")
    both = F.array(F.struct(F.col("l"), half.alias("r")), F.struct((F.lit(length) - half + 1).alias("l"), F.col("r")))
    out = leaves.select("k1", "k2", "lo", "hi", "back", "ahead", F.explode(both).alias("p"))
    return out.where("length(back) >= p.l and length(ahead) >= p.r").select("k1", "k2", "lo", "hi", "back", "ahead", "p.l", "p.r")


def shared_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``(doc_id, start_pos, end_pos)``: the stretches of each text that occur in another one."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "spans")
    seed = min(seed, length)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length("text") >= length)
    found = scratch.save(docs.mapInArrow(_anchor_rows(length, seed), "seed long, doc_id long, pos long"))
    shared = found.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    # An anchor belongs to one seed; the list of a text's anchors is shorter than the text.
    at = found.join(shared, "seed").groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    around = docs.join(at, "doc_id").mapInArrow(_contexts(length, seed), "doc_id long, pos long, back string, ahead string")
    around = scratch.save(around.select("doc_id", "pos", F.xxhash64(F.lit(1), "back", "ahead").alias("k1"), F.xxhash64(F.lit(2), "ahead", "back").alias("k2"), "back", "ahead"))
    scratch.drop(found)
    leaves = around.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("back").alias("back"), F.min("ahead").alias("ahead"))
    leaves = leaves.withColumns({"l": F.lit(0), "r": F.lit(seed)})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = lambda x: scratch.save(x.repartition(n, "g", "slot").sortWithinPartitions("g", "slot").mapInArrow(_trees(length), "k1 long, k2 long, before long, after long").distinct())
    grown = []
    while leaves is not None:
        leaves = scratch.save(leaves.withColumn("g", F.xxhash64("l", "r", F.expr("substring(back, 1, l)"), F.expr("substring(ahead, 1, r)"))))
        size = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))
        large = scratch.save(size.where(F.col("n") > group))
        fit = leaves.withColumn("slot", F.lit(0))
        if large.isEmpty():
            grown.append(trees(fit))
            break
        grown.append(trees(fit.join(large, "g", "left_anti")))
        large = large.where("first < last")  # the others are one document's
        # Full prefixes: slots of bounded size, each with the first and the last document's leaves.
        n_slots = F.ceil(F.col("n") / max(group, 1)).cast("int")
        full = leaves.where(F.col("l") + F.col("r") >= length).join(large, "g")
        own = full.withColumn("slot", F.pmod(F.xxhash64("k2"), n_slots).cast("int")).select(*fit.columns)
        row = F.struct(*leaves.columns)
        ends = full.groupBy("g").agg(F.min_by(row, "lo").alias("a"), F.max_by(row, "hi").alias("z"), F.first("n").alias("n"))
        ends = ends.select(F.explode(F.array("a", "z")).alias("x"), n_slots.alias("m")).select("x.*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("slot"))
        grown.append(trees(own.unionByName(ends).distinct()))
        leaves = _longer(leaves.where(F.col("l") + F.col("r") < length).join(large, "g", "left_semi"), length)
    spans = grown[0]
    for more in grown[1:]:
        spans = spans.union(more)
    # Overlapping and touching spans of a text become one.
    spans = around.select("doc_id", "pos", "k1", "k2").join(spans.distinct(), ["k1", "k2"]).select("doc_id", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b")).distinct()
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return parts.groupBy("doc_id", "g").agg(F.min("a").alias("start_pos"), F.max("b").alias("end_pos")).select(F.col("doc_id").alias(doc_id), "start_pos", "end_pos")


def shared_parts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per record: its length, how many characters are shared elsewhere, and their part of it."""
    per = shared_spans(df, doc_id, text, **options).groupBy(doc_id).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    size = df.select(doc_id, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return size.join(per, doc_id, "left").select(
        doc_id, "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 4)).otherwise(F.lit(0.0)).alias("shared_part")
    )
