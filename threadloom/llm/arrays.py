"""Vectorised text kernels over Arrow string columns.

A batch of texts becomes one array of code points; every step below works on that array, so no
per-character Python code runs and no canonical string is built.

The *skip-and-fold table* maps a code point to the code point of its lower-case form if that is a
letter or digit (``str.isalnum``), and to 0 if the character is to be skipped. Rolling polynomial
hashes are taken modulo 2**64 over mixed character values: a prefix sum of ``value * BASE**i`` gives
the hash of any stretch by one subtraction and one multiplication with the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BASE_INV = pow(BASE, -1, 1 << 64)
LAST_CASED = 0x33500  # no letters or digits are assigned above this code point
CHUNK = 1 << 18  # code points handled at a time

_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & MASK)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def fold_table() -> np.ndarray:
    if "fold" not in _cache:
        t = np.zeros(0x110000, np.uint32)
        for c in range(LAST_CASED):
            low = chr(c).lower()
            if low[0].isalnum():
                t[c] = ord(low[0])
        _cache["fold"] = t
    return _cache["fold"]


def _powers(name: str, base: int, n: int) -> np.ndarray:
    p = _cache.get(name)
    if p is None or len(p) < n:
        size = max(n, CHUNK * 2)
        p = np.empty(size, U)
        p[0] = 1
        have = 1
        while have < size:  # doubling: base**(have + i) = base**have * base**i
            take = min(have, size - have)
            p[have : have + take] = p[:take] * U(pow(base, have, 1 << 64))
            have += take
        _cache[name] = p
    return p


class Texts:
    """Code points of a run of texts; ``start[i]:start[i + 1]`` are those of text ``i``."""

    __slots__ = ("cps", "start")

    def __init__(self, cps: np.ndarray, start: np.ndarray):
        self.cps, self.start = cps, start

    def __len__(self) -> int:
        return len(self.start) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, side="right") - 1


def texts_of(column: pa.Array, lower_sigma: bool = True) -> Texts:
    """Decode a string column; null counts as the empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if lower_sigma and len(column):
        import pyarrow.compute as pc

        if pc.any(pc.match_substring(column, "Σ")).as_py():  # its lower case depends on its place in the word
            column = pa.array([t.lower() if "Σ" in t else t for t in column.to_pylist()], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.zeros(0, np.uint32), np.zeros(1, np.int64))
    a, b = int(offsets[0]), int(offsets[-1])
    raw = column.buffers()[2]
    data = raw.slice(a, b - a).to_pybytes() if raw is not None and b > a else b""
    if data.isascii():
        return Texts(np.frombuffer(data, np.uint8).astype(np.uint32), (offsets - a).astype(np.int64))
    cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return Texts(cps, before[offsets - a].astype(np.int64))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(first, last, slice) pieces of a column of about ``limit`` bytes; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    large = column.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + n + 1]
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, large.slice(i, j - i)
        i = j


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` for arrays of starts and ends."""
    n = len(values)
    pw, inv = _powers("pow", BASE, n + 1), _powers("inv", BASE_INV, n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(values, seed) * pw[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inv[start]
    return mix(h ^ mix((end - start).astype(U), seed + 7), seed)


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, folded) of every word: a longest run of letters and digits, lower-cased."""
    f = fold_table()[t.cps]
    on = f != 0
    edge = np.zeros(len(on) + 1, bool)
    edge[t.start] = True
    first = on.copy()
    first[1:] &= ~on[:-1] | edge[1:-1]
    last = on.copy()
    last[:-1] &= ~on[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return t.row_of(start), start, end, f


def word_hashes(t: Texts, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word."""
    row, start, end, f = words(t)
    return row, start, end, spans_hash(f, start, end, seed)


def word_sets(t: Texts, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different words of each text, ordered by row and hash."""
    row, _, _, h = word_hashes(t, seed)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def content_hashes(t: Texts, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, kept) per text: the hash of its folded letters and digits with all else skipped."""
    f = fold_table()[t.cps]
    kept = np.concatenate([[0], np.cumsum(f != 0)])
    at = kept[t.start]
    return spans_hash(f[f != 0], at[:-1], at[1:], seed), at[1:] - at[:-1]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, as Spark stores them."""
    return h.astype(U).view(np.int64)
