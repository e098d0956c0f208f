"""Problems 6 and 7: near-duplicate records with small edits, and their signatures.

Method: token-combination prefixes. Two word sets with a Jaccard similarity of at least ``t`` differ
in few words, so some of each set's rarest words are shared. A set's words are put in one global order
(rarest first) and split by frequency into classes; class 1 words are indexed singly, class ``k``
words by combinations of ``k`` of them, within hash blocks of the class. The prefix is extended until

    sum over blocks of max(0, words in the block - (k - 1))  >=  allowed misses + 1

so by the pigeonhole principle two similar sets share at least one signature. The smaller set of a
pair needs the shorter *index* prefix (misses allowed against a set at least as large), the larger one
the *probe* prefix. The number of blocks grows with the set (``_level``), so combinations stay few; a set
also probes on the level below if a similar smaller set may lie there. Nothing is sampled or capped.

Groups (problem 6) never list all pairs of a cluster. Rows that meet at a signature are parted into
components of the pairs that size and a parity bitmap (an upper bound of the overlap) leave possible; equal
components of other signatures are dropped, wider parity bits part them further, and each then meets its texts once: pairs are verified until
its rows are connected, which yields a spanning forest of verified links. A signature of more than ``HOT``
rows is cut into blocks that share ``WITNESSES`` rows; pairs of blocks are compared only if the verified
links of the blocks have left the signature's rows in several groups. Pairs (problem 7) are the result
itself, so they are listed, in pieces of bounded size.

Word frequencies come from a table of ``2**BUCKETS`` hashed counters: any global order is exact, so
hash collisions cost time only, and what is broadcast has a fixed size (4 MB).

Words are compared by 64-bit hashes: two texts of 20 words each have a false common word with a chance of
about 400 / 2**64, or one in 4 * 10**16.

Defined results: null texts and texts with fewer than ``MIN_WORDS`` different words belong to no
group; equal word sets are copies whatever their order; empty tables give empty results; further
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import arrays as A
from threadloom.llm.groups import components, salt, salts_for, slots
from threadloom.session import Scratch, ship

U = np.uint64
MIN_WORDS = 6
THRESHOLD = 0.7
BUCKETS = 20
SINGLE = 1000  # a word in at most so many sets is indexed singly; of rarer expectation for combinations
SMALL, LARGE = 8, 64  # up to so many words: one block a class; from so many: blocks grow with the set
HOT = 200_000  # rows of one signature that are joined in one piece; more are joined in blocks
WITNESSES = 16
ROWS = 300_000  # signature rows handled at a time
PAIRS = 1_000_000  # pairs tested or listed at a time
EPS = 1e-9


def texts_by_node(df: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """``(node, text)`` with ``node = row_id * number of fields + field``."""
    n = len(fields)
    parts = F.array(*[F.struct((F.col(row_id).cast("long") * n + i).alias("node"), F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)])
    return df.select(F.explode(parts).alias("x")).select("x.node", "x.text").where("text is not null")


def _tokens(t: A.Texts, node: np.ndarray, n_fields: int) -> tuple[np.ndarray, np.ndarray]:
    row, h = A.word_sets(t)
    return row, A.mix(h ^ A.mix(node[row] % n_fields, 5))


def _column(batch: pa.RecordBatch, name: str, i: int, j: int) -> np.ndarray:
    return batch.column(name).slice(i, j - i).to_numpy(zero_copy_only=False)


def _set_keys(n_fields: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                node = _column(batch, "node", i, j)
                t = A.texts_of(text)
                row, tok = _tokens(t, node, n_fields)
                n = np.bincount(row, minlength=len(t))
                cut = np.cumsum(n)
                k = []
                for seed in (1, 2):
                    s = np.concatenate([[U(0)], np.cumsum(A.mix(tok, seed))])
                    k.append(A.signed(A.mix((s[cut] - s[cut - n]) ^ A.mix(n, seed))))
                keep = n >= MIN_WORDS
                yield pa.record_batch([pa.array(x[keep]) for x in (node, *k)], names=["node", "k1", "k2"])

    return run


def _bucket(tok: np.ndarray) -> np.ndarray:
    return (tok >> U(64 - BUCKETS)).astype(np.int64)


def _count_words(n_fields: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                _, tok = _tokens(A.texts_of(text), _column(batch, "node", i, j), n_fields)
                total += np.bincount(_bucket(tok), minlength=1 << BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def word_counts(texts: DataFrame, n_fields: int) -> np.ndarray:
    """Sets per hashed word; at most ``2**BUCKETS`` rows reach the driver, whatever the input."""
    got = texts.mapInArrow(_count_words(n_fields), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKETS, np.int32)
    out[got["bucket"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return out


def _misses(n: np.ndarray, share: float) -> np.ndarray:
    return n - np.ceil(n * share - EPS).astype(np.int64)


def _rank_in_group(group: np.ndarray) -> np.ndarray:
    """Place of each element among those of its group, in array order."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    at = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    out = np.empty(len(g), np.int64)
    out[order] = at
    return out


def _level(n: np.ndarray) -> np.ndarray:
    return np.where(n <= SMALL, 0, np.where(n < LARGE, 1, 2 + np.log2(np.maximum(n // LARGE, 1)).astype(np.int64)))


def _blocks(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of classes 2 and 3: so few that a prefix always fits, and more for larger sets."""
    return np.where(level == 0, 1, 2 << np.maximum(level, 1)), np.where(level < 2, 1, 1 << np.maximum(level, 0))


def signatures(row: np.ndarray, tok: np.ndarray, n_rows: int, counts: np.ndarray, n_sets: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, is-index) of word sets given as (row, token) pairs ordered by row."""
    if t < THRESHOLD:
        raise ValueError(f"prefixes are long enough for similarities of {THRESHOLD} or more")
    df = counts[_bucket(tok)]
    order = np.lexsort((tok, df, row))
    row, tok, df = row[order], tok[order], df[order]
    n = np.bincount(row, minlength=n_rows)
    own, below = _level(n), _level(np.ceil(n * t - EPS).astype(np.int64))
    out = _signatures(row, tok, df, n, own, n_sets, t, True)
    down = (below < own)[row]
    more = _signatures(row[down], tok[down], df[down], np.bincount(row[down], minlength=n_rows), below, n_sets, t, False)
    return tuple(np.concatenate(x) for x in zip(out, more))  # type: ignore[return-value]


def _signatures(row: np.ndarray, tok: np.ndarray, df: np.ndarray, n: np.ndarray, level: np.ndarray, n_sets: int, t: float, indexed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    probe, index = _misses(n, t)[row], _misses(n, 2 * t / (1 + t))[row]
    kind = np.where(df <= SINGLE, 1, np.where(df <= math.sqrt(SINGLE * max(n_sets, 1)), 2, 3))
    start = np.cumsum(n) - n
    b2, b3 = (b[row] for b in _blocks(level))
    block = np.where(kind == 1, 0, np.where(kind == 2, 1 + (tok % b2.astype(U)).astype(np.int64), 1 + b2 + (tok % b3.astype(U)).astype(np.int64)))
    width = int((1 + b2 + b3).max()) if len(row) else 1
    group = row * width + block
    gives = _rank_in_group(group) >= kind - 1
    total = np.cumsum(gives)
    before = total - gives
    before = before - np.concatenate([[0], total])[start[row]]
    use = (before <= probe) & (n[row] >= MIN_WORDS)
    in_index = (before <= index)[use] & indexed
    row, tok, kind, group = row[use], A.mix(tok[use] ^ A.mix(level[row[use]], 20), 23), kind[use], group[use]
    one = kind == 1
    out = [(row[one], A.mix(tok[one], 22), in_index[one])]
    for k in (2, 3):
        sel = np.flatnonzero(kind == k)
        sel = sel[np.argsort(group[sel], kind="stable")]
        r, w, g, x = row[sel], tok[sel], group[sel], in_index[sel]
        lag = 1
        while lag < len(g):
            hit = np.flatnonzero(g[lag:] == g[:-lag])
            if not len(hit):
                break
            pair = w[hit] + w[hit + lag]
            if k == 2:
                out.append((r[hit], A.mix(pair, 24), x[hit + lag]))
            else:
                more = 1
                while True:
                    third = hit + lag + more
                    ok = third < len(g)
                    ok[ok] = g[third[ok]] == g[hit[ok]]
                    if not ok.any():
                        break
                    out.append((r[hit[ok]], A.mix(pair[ok] + w[third[ok]], 25), x[third[ok]]))
                    more += 1
            lag += 1
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _parity(row: np.ndarray, tok: np.ndarray, n_rows: int) -> np.ndarray:
    """64 parity bits of each set: two sets differ in at least as many words as bits."""
    bits = np.zeros(n_rows, U)
    if len(row):
        n = np.bincount(row, minlength=n_rows)
        has = np.flatnonzero(n)
        bits[has] = np.bitwise_xor.reduceat(U(1) << (A.mix(tok, 31) & U(63)), (np.cumsum(n) - n)[has])
    return bits


def _sign(counts, n_sets: int, n_fields: int, t: float, side: int, wanted=None) -> Callable:
    """Signature rows; ``wanted`` (a broadcast bitmap of fixed size) drops signatures absent from the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, only = counts.value, None if wanted is None else wanted.value
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                node = _column(batch, "node", i, j)
                x = A.texts_of(text)
                row, tok = _tokens(x, node, n_fields)
                n = np.bincount(row, minlength=len(x))
                bits = _parity(row, tok, len(x))
                r, sig, index = signatures(row, tok, len(x), table, n_sets, t)
                if only is not None:
                    b = _bit(sig)
                    keep = (only[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
                    r, sig, index = r[keep], sig[keep], index[keep]
                meta = n[r] * 4 + index * 2 + side
                yield pa.record_batch([pa.array(A.signed(sig)), pa.array(node[r]), pa.array(meta.astype(np.int32)), pa.array(A.signed(bits[r]))], names=["sig", "node", "meta", "bits"])

    return run


SIGN_DDL = "sig long, node long, meta int, bits long"
BITMAP = 22


def _bit(sig: np.ndarray) -> np.ndarray:
    return (sig >> U(64 - BITMAP)).astype(np.int64)


def bitmap_of(spark, values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (``2**BITMAP`` bits) of a frame of 64-bit ``sig`` values.

    Bits are united by a combining aggregate; at most ``2**(BITMAP - 6)`` words reach the driver.
    """
    at = values.select(F.shiftrightunsigned("sig", 64 - BITMAP).alias("b"))
    word = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP - 6), np.int64)
    bits[word["w"].to_numpy()] = word["bits"].to_numpy()
    return bits.view(np.uint8)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, starts of the groups) of sorted keys."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.cumsum(new) - 1, np.flatnonzero(new)


class Rows:
    """Signature rows ordered by (signature, size, node), and the test that leaves a pair possible."""

    def __init__(self, part: pa.Table, t: float):
        c = {k: part.column(k).to_numpy() for k in part.column_names if not part.column(k).null_count}
        order = np.lexsort((c["node"], c["meta"] >> 2, c["sig"]))
        self.c = c = {k: v[order] for k, v in c.items()}
        self.n, self.index, self.side, self.bits = c["meta"] >> 2, (c["meta"] >> 1) & 1, c["meta"] & 1, c["bits"].view(U)
        self.group, self.starts = _runs(c["sig"])
        self.ends = np.append(self.starts[1:], len(order))[self.group]
        self.half, self.t = c.get("half"), t
        self.wide = [c[k].view(U) for k in ("b1", "b2") if k in c]

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` comes before ``b``, so it must be in its index prefix."""
        both = self.n[a] + self.n[b]
        slack = both - 2 * np.ceil(self.t / (1 + self.t) * both - EPS).astype(np.int64)
        ok = (self.index[a] == 1) & (self.n[a] >= self.n[b] * self.t - EPS) & (np.bitwise_count(self.bits[a] ^ self.bits[b]) <= slack)
        for bits in self.wide:
            ok &= np.bitwise_count(bits[a] ^ bits[b]) <= slack
        return ok if self.half is None else ok & ((self.half[a] != self.half[b]) | (self.half[a] < 0))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The possible pairs of rows of different sides."""
        act = np.flatnonzero((self.index == 1) & (self.ends - np.arange(len(self.n)) > 1))
        if len(act):
            has = np.minimum.reduceat(self.side, self.starts) != np.maximum.reduceat(self.side, self.starts)
            act = act[has[self.group[act]]]
        lag = 1
        while len(act):
            act = act[act + lag < self.ends[act]]
            act = act[self.n[act] >= self.n[act + lag] * self.t - EPS]  # larger rows follow
            a = act[self.side[act] != self.side[act + lag]]
            a = a[self.possible(a, a + lag)]
            if len(a):
                yield self.c["node"][a], self.c["node"][a + lag]
            lag += 1


def forest(group: np.ndarray, starts: np.ndarray, test: Callable, size: np.ndarray, t: float, label: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(label of each row, links): the components of the pairs that pass a test within groups of rows.

    Pairs are tested by distance, and only while their rows are apart; rows of one ``label`` are together
    from the start. A row leaves when the next ones are too large for it (rows are ordered by size), a
    group as soon as its rows are one component. The links are a forest.
    """
    n = len(group)
    lab, links = np.arange(n), []
    if label is not None and n:
        order = np.lexsort((label, group))
        new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])])
        lab[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    ends = np.append(starts[1:], n)[group] if n else starts
    act = np.flatnonzero((ends - np.arange(n) > 1) & (True if first is None else first))
    lag = 1
    while len(act):
        act = act[act + lag < ends[act]]
        act = act[size[act] >= size[act + lag] * t - EPS]
        if lag & (lag - 1) == 0 and len(act):
            single = np.minimum.reduceat(lab, starts) == np.maximum.reduceat(lab, starts)
            act = act[~single[group[act]]]
        for i in range(0, len(act), PAIRS):
            a = act[i : i + PAIRS]
            a = a[lab[a] != lab[a + lag]]
            a = a[test(a, a + lag)] if len(a) else a
            b = a + lag
            while len(a):
                x, y = lab[a], lab[b]
                apart = x != y
                a, b, lo, hi = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
                if not len(a):
                    break
                top, at = np.unique(hi, return_index=True)
                links.append((a[at], b[at]))
                lab[top] = lo[at]
                while True:
                    up = lab[lab]
                    if (up == lab).all():
                        break
                    lab = up
        lag += 1
    return lab, links


def _clusters(t: float) -> Callable:
    """Rows of whole signatures in, ``(gid, node, root, half)`` of the components of possible pairs out."""
    seen: set[int] = set()

    def handle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        r = Rows(part, t)
        root = r.c.get("root")
        lab, _ = forest(r.group, r.starts, r.possible, r.n, t, root, r.index == 1)
        order = np.argsort(lab, kind="stable")
        node = r.c["node"][order]
        g, starts = _runs(lab[order])
        if root is None:
            several = np.bincount(g) > 1
        else:
            several = np.minimum.reduceat(root[order], starts) != np.maximum.reduceat(root[order], starts)
        h = np.add.reduceat(A.mix(node, 71), starts) if len(starts) else np.zeros(0, U)
        gid = A.signed(A.mix(h))
        if root is None:  # most signatures of a cluster bring the same rows together
            fresh = np.fromiter((several[i] and x not in seen for i, x in enumerate(gid.tolist())), bool, len(gid))
            seen.update(gid[fresh].tolist())
            if len(seen) > 1_000_000:
                seen.clear()
        else:
            fresh = several
        keep = fresh[g]
        extra = {} if root is None else {"root": root[order][keep], "half": r.half[order][keep]}
        for i in range(0, int(keep.sum()), PAIRS):
            cut = slice(i, i + PAIRS)
            yield _met(gid[g[keep]][cut], node[keep][cut], **{k: v[cut] for k, v in extra.items()})

    return handle


MEET_DDL = "gid long, node long, sig long, meta int, bits long, root long, half int"


def _met(gid, node, sig=None, meta=None, bits=None, root=None, half=None) -> pa.RecordBatch:
    kinds = {"gid": pa.int64(), "node": pa.int64(), "sig": pa.int64(), "meta": pa.int32(), "bits": pa.int64(), "root": pa.int64(), "half": pa.int32()}
    values = {"gid": gid, "node": node, "sig": sig, "meta": meta, "bits": bits, "root": root, "half": half}
    return pa.record_batch([pa.nulls(len(node), k) if values[c] is None else pa.array(values[c], k) for c, k in kinds.items()], names=list(kinds))


def _listed(t: float) -> Callable:
    """Rows of whole signatures in, possible pairs of different sides out (``gid`` and ``node``), in bounded pieces."""

    def handle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            pair = np.unique(np.concatenate(held), axis=0)
            return _met(pair[:, 0], pair[:, 1])

        for a, b in Rows(part, t).pairs():
            held.append(np.sort(np.stack([a, b], 1), axis=1))
            if sum(map(len, held)) > PAIRS:
                yield send()
                held.clear()
        if held:
            yield send()

    return handle


def _meet(make: Callable, t: float, hot: int | None) -> Callable:
    """Rows sorted by signature in; whole signatures go to a handler, rows of hot ones come out as they are."""

    def spill(part: pa.Table) -> pa.RecordBatch:
        c = {k: part.column(k).to_numpy() for k in ("sig", "node", "meta", "bits")}
        return _met(None, c["node"], c["sig"], c["meta"], c["bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make(t)
        held: list[pa.RecordBatch] = []
        rows, hot_sig = 0, None

        def split(part: pa.Table) -> Iterator[pa.RecordBatch]:
            if hot is not None:
                _, starts = _runs(part.column("sig").to_numpy())
                size = np.diff(np.append(starts, part.num_rows))
                for k in np.flatnonzero(size > hot):
                    yield spill(part.slice(starts[k], size[k]))
                if (size > hot).any():
                    part = part.filter(pa.array(np.repeat(size <= hot, size)))
            if part.num_rows:
                yield from handle(part)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS and hot_sig is None:
                continue
            part = pa.Table.from_batches(held)
            sig = part.column("sig").to_numpy()
            last = sig[-1]
            cut = int(np.searchsorted(sig == last, True)) if sig[0] != last else 0
            if hot_sig is not None and sig[0] == hot_sig:
                stop = int(np.searchsorted(sig != hot_sig, True)) if last != hot_sig else rows
                yield spill(part.slice(0, stop))
                part, cut = part.slice(stop), max(cut - stop, 0)
                hot_sig = hot_sig if stop == rows else None
            if part.num_rows:
                if cut:
                    yield from split(part.slice(0, cut))
                    part = part.slice(cut)
                if hot is not None and part.num_rows > hot:  # the group goes on and is already too large for one piece
                    hot_sig = last
                    yield spill(part)
                    part = part.slice(part.num_rows)
            held, rows = part.to_batches(), part.num_rows
        if rows:
            part = pa.Table.from_batches(held)
            if hot_sig is not None:
                stop = int((part.column("sig").to_numpy() == hot_sig).sum())
                if stop:
                    yield spill(part.slice(0, stop))
                part = part.slice(stop)
            if part.num_rows:
                yield from split(part)

    return run


def _met_at(rows: DataFrame, make: Callable, t: float, hot: int | None = None) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(_meet(make, t, hot), MEET_DDL)


def _in_blocks(hot_rows: DataFrame, hot: int, cross: bool) -> DataFrame:
    """Rows of hot signatures under each pair of blocks they belong to; ``half`` tells the blocks apart.

    With ``cross`` only pairs of different blocks, else also each block with itself.
    """
    sizes = hot_rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / max(hot // 2, 1)).cast("int").alias("nb"))
    cut = hot_rows.join(sizes, "sig").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cut = cut.where("blk <> other") if cross else cut
    half = F.when(F.col("blk") == F.col("other"), -1).otherwise((F.col("blk") > F.col("other")).cast("int"))
    return cut.withColumn("half", half).withColumn("sig", F.xxhash64("sig", F.least("blk", "other"), F.greatest("blk", "other")))


def candidates(signed: DataFrame, t: float, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Different candidate pairs ``(a, b)`` of signature rows of two sides."""
    met = scratch.save(_met_at(signed, _listed, t, hot))
    pairs = met.where("sig is null")
    blocks = _in_blocks(met.where("sig is not null").select("sig", "node", "meta", "bits"), hot, False).select("sig", "node", "meta", "bits", "half")
    return pairs.union(_met_at(blocks, _listed, t)).select(F.col("gid").alias("a"), F.col("node").alias("b")).distinct()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of each entry, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Sets:
    """The word sets of texts, by their sorted hashes, and whether two are similar."""

    def __init__(self, text: pa.Array, t: float):
        rows, hashes, bits = [], [], []
        for i, _, part in A.chunks(text):
            x = A.texts_of(part)
            r, h = A.word_sets(x)
            rows.append(r + i)
            hashes.append(h)
            bits.append(_parity(r, h, len(x)))
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.n = np.bincount(np.concatenate(rows) if rows else np.zeros(0, np.int64), minlength=len(text))
        self.start, self.bits, self.t = np.cumsum(self.n) - self.n, np.concatenate(bits) if bits else np.zeros(0, U), t

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = self.n[a], self.n[b]
        both = na + nb
        slack = both - 2 * np.ceil(self.t / (1 + self.t) * both - EPS).astype(np.int64)
        ok = (np.bitwise_count(self.bits[a] ^ self.bits[b]) <= slack) & (np.minimum(na, nb) >= MIN_WORDS)
        left = np.flatnonzero(ok)
        size = np.cumsum(both[left])
        at = 0
        while at < len(left):  # some million words at a time
            stop = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + 4 * PAIRS)), at + 1)
            p = left[at:stop]
            h = np.concatenate([self.h[_ranges(self.start[a[p]], na[p])], self.h[_ranges(self.start[b[p]], nb[p])]])
            r = np.concatenate([np.repeat(np.arange(len(p)), na[p]), np.repeat(np.arange(len(p)), nb[p])])
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            shared = np.bincount(r[1:][(r[1:] == r[:-1]) & (h[1:] == h[:-1])], minlength=len(p))
            ok[p] = shared >= self.t * (both[p] - shared) - EPS
            at = stop
        return ok


def _links(t: float) -> Callable:
    """Components of possible pairs with their texts in, a forest of verified links out."""

    def handle(part: pa.Table) -> pa.RecordBatch:
        sets = Sets(part.column("text").combine_chunks(), t)
        gid, node = part.column("sig").to_numpy(), part.column("node").to_numpy()
        order = np.lexsort((node, sets.n, gid))
        group, starts = _runs(gid[order])
        labels, half = (part.column(c).to_numpy()[order] if c in part.column_names else None for c in ("root", "half"))

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = np.ones(len(a), bool) if half is None else half[a] != half[b]
            ok[ok] = sets.similar(order[a[ok]], order[b[ok]])
            return ok

        _, links = forest(group, starts, test, sets.n[order], t, labels)
        a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        return pa.record_batch([pa.array(node[order[a]]), pa.array(node[order[b]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < 8_000_000:
                continue
            part = pa.Table.from_batches(held)
            sig = part.column("sig").to_numpy()
            cut = int(np.searchsorted(sig == sig[-1], True)) if len(sig) and sig[0] != sig[-1] else 0
            if cut:
                yield handle(part.slice(0, cut))
                part = pa.Table.from_batches(part.slice(cut).to_batches(), part.schema)
            held, size = part.to_batches(), part.nbytes if cut else 0  # a long group waits for as much again
        part = pa.Table.from_batches(held) if held else None
        if part is not None and part.num_rows:
            yield handle(part)

    return run


def near_links(signed: DataFrame, texts: DataFrame, t: float, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``(a, b)``: verified links whose components are those of all near pairs."""
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verified(met: DataFrame, *more: str) -> DataFrame:
        # Wider parity bits take most wrong rows out of the components before any text moves.
        wide = texts_near_nodes(texts, met.select("node")).mapInArrow(_wide_parity, "node long, n long, b1 long, b2 long")
        wide = wide.select("node", (F.col("n") * 4 + 2).cast("int").alias("meta"), F.lit(0).cast("long").alias("bits"), "b1", "b2")
        met = scratch.save(_met_at(met.join(wide, "node").select(F.col("gid").alias("sig"), "node", "meta", "bits", "b1", "b2", *more), _clusters, t).select("gid", "node", *more).distinct())
        some = texts_near_nodes(texts, met.select("node"))
        rows = met.join(some, "node").select(F.col("gid").alias("sig"), "node", "text", *more)
        return scratch.save(rows.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(_links(t), "a long, b long").distinct())

    met = scratch.save(_met_at(signed, _clusters, t, hot))
    links = verified(scratch.save(met.where("sig is null").select("gid", "node").distinct()))
    hot_rows = met.where("sig is not null").select("sig", "node", "meta", "bits")
    if hot_rows.isEmpty():
        return links
    # Blocks of a hot signature share some rows, picked by hash, which tie its similar rows together.
    sizes = hot_rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / max(hot // 2, 1)).cast("int").alias("nb"), F.array(*[F.min_by(F.struct("node", "meta", "bits"), F.xxhash64("node", F.lit(i))) for i in range(WITNESSES)]).alias("w"))
    blocks = hot_rows.join(sizes.select("sig", "nb"), "sig").select(F.xxhash64("sig", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).alias("sig"), "node", "meta", "bits")
    ties = sizes.select("sig", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("blk"), "w").select(F.xxhash64("sig", "blk").alias("sig"), F.explode("w").alias("w")).select("sig", "w.*")
    met = scratch.save(_met_at(blocks.union(ties).distinct(), _clusters, t).select("gid", "node").distinct())
    links = scratch.save(links.union(verified(met)).distinct())
    roots = components(links, scratch)
    placed = hot_rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    rest = scratch.save(placed.join(apart, "sig", "left_semi").select("sig", "node", "meta", "bits", "root"))
    cross = _in_blocks(rest, hot, True).select("sig", "node", "meta", "bits", "root", "half")
    met = scratch.save(_met_at(cross, _clusters, t).select("gid", "node", "root", "half"))
    return links.union(verified(met, "root", "half")).distinct()


def _pick(wanted, inside: bool) -> Callable:
    """Texts whose node may be in a bitmap (``inside``), or those that surely are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            b = _bit(A.mix(batch.column("node").to_numpy(zero_copy_only=False), 61))
            yield batch.filter(pa.array(((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0) == inside))

    return run


def _node_bitmap(nodes: DataFrame):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(A.signed(A.mix(batch.column("node").to_numpy(zero_copy_only=False), 61)))], names=["sig"])

    spark = nodes.sparkSession
    return spark.sparkContext.broadcast(bitmap_of(spark, nodes.select("node").mapInArrow(run, "sig long")))


def texts_near_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts that include those of the given nodes: a bitmap of fixed size drops most others."""
    return texts.mapInArrow(_pick(_node_bitmap(nodes), True), texts.schema)


def texts_without_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of all other nodes; only those the bitmap cannot decide are shuffled."""
    bits = _node_bitmap(nodes)
    return texts.mapInArrow(_pick(bits, False), texts.schema).union(texts.mapInArrow(_pick(bits, True), texts.schema).join(nodes, "node", "left_anti"))


def _similar(t: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text_a")):
                ra, ha = A.word_sets(A.texts_of(text))
                rb, hb = A.word_sets(A.texts_of(batch.column("text_b").slice(i, j - i)))
                rows = j - i
                na, nb = np.bincount(ra, minlength=rows), np.bincount(rb, minlength=rows)
                r, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                both = np.bincount(r[1:][(r[1:] == r[:-1]) & (h[1:] == h[:-1])], minlength=rows)
                ok = (both >= t * (na + nb - both) - EPS) & (na >= MIN_WORDS) & (nb >= MIN_WORDS)
                yield pa.record_batch([pa.array(_column(batch, c, i, j)[ok]) for c in ("a", "b")], names=["a", "b"])

    return run


def _wide_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set sizes and 128 further parity bits."""
    for batch in batches:
        for i, j, text in A.chunks(batch.column("text")):
            x = A.texts_of(text)
            row, h = A.word_sets(x)
            n = np.bincount(row, minlength=len(x))
            bits = [A.signed(_parity(row, A.mix(h, seed), len(x))) for seed in (32, 33)]
            yield pa.record_batch([batch.column("node").slice(i, j - i), *map(pa.array, (n, *bits))], names=["node", "n", "b1", "b2"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, t: float) -> DataFrame:
    """The pairs whose whole texts' word sets have a similarity of at least ``t``.

    Wider parity bits drop nearly all wrong candidates before any text moves.
    """
    pairs = scratch.save(pairs)
    wide = texts_near_nodes(texts, _ends(pairs)).mapInArrow(_wide_parity, "node long, n long, b1 long, b2 long")
    side = lambda x, c: x.select(F.col("node").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "b1", "b2")])
    both = F.col("n_a") + F.col("n_b")
    allowed = both - 2 * F.ceil(F.lit(t / (1 + t)) * both - EPS)
    joined = pairs.join(side(wide, "a"), "a").join(side(wide, "b"), "b")
    differ = [F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in ("b1", "b2")]
    kept = scratch.save(joined.where((differ[0] <= allowed) & (differ[1] <= allowed)).select("a", "b"))
    scratch.drop(pairs)
    some = texts_near_nodes(texts, _ends(kept))
    a = some.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = some.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    links = scratch.save(kept.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(t), "a long, b long").distinct())
    scratch.drop(kept)
    return links


def collapse(texts: DataFrame, n_fields: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Copies by word set: ``(node, first_id, salt)`` of all rows of sets with copies, and the texts but for
    each set's later copies."""
    keyed = scratch.save(texts.mapInArrow(_set_keys(n_fields), "node long, k1 long, k2 long"))
    keyed = keyed.withColumn("salt", salt("node", salts_for(keyed)))
    found = scratch.save(slots(keyed, ["k1", "k2"], "node").where("copies > 1"))
    copies = scratch.save(keyed.join(found, ["k1", "k2", "salt"]).select("node", "first_id", "salt"))
    return copies, scratch.save(texts_without_nodes(texts, copies.where("node <> first_id").select("node").distinct()))


def near_groups(df: DataFrame, fields: list[str], row_id: str = "row_id", t: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """``(text_field, first_row_id, row_id)`` for every member of a group but its smallest row."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    n_fields = len(fields)
    copies, reps = collapse(texts_by_node(df, fields, row_id), n_fields, scratch)
    counts = spark.sparkContext.broadcast(word_counts(reps, n_fields))
    signed = reps.mapInArrow(_sign(counts, reps.count(), n_fields, t, 0), SIGN_DDL)
    roots = components(near_links(signed, reps, t, scratch, hot), scratch)
    # A first row's root holds for its copies: the copies of one set are spread over slots of rows.
    spread = copies.where("node <> first_id")
    firsts = spread.select("first_id", "salt").distinct().join(roots.select(F.col("node").alias("first_id"), "root"), "first_id")
    later = spread.join(firsts, ["first_id", "salt"], "left").select("node", F.coalesce("root", "first_id").alias("root"))
    members = roots.union(later).where("node <> root")
    names = F.array(*[F.lit(f) for f in fields])
    return members.select(
        F.get(names, F.pmod("node", F.lit(n_fields)).cast("int")).alias("text_field"),
        F.expr(f"root div {n_fields}").alias("first_row_id"),
        F.expr(f"node div {n_fields}").alias("row_id"),
    ).distinct()
