"""Problem 1: abusive, hateful or sexual content.

Method: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count
ratios, trained on labelled text. Texts are first normalised for spelling tricks (look-alike letters,
digits for letters, separators or spaces inside words, repeated letters); every window of
``WINDOWS`` words is scored and a text's score is that of its worst window, so that a short remark in a
long message counts and the whole text is read.

The labelled text is ``abuse_examples``, a bounded set (``PER_PATTERN`` fillings of each pattern,
embedded in neutral text, and random windows of ``BACKGROUND`` ordinary messages, labelled not abusive as
they were written). No row of the corpus is trained on, so a text's score does not depend on the table.
Training is deterministic and runs once per driver process; the model broadcast has a fixed size
(``2**BITS`` weights). Scores and rates cover every row.

Defined results: null texts and texts without a word score 0; ties keep the first window; repeated rows
are scored each; very long texts are scored whole; empty tables give empty results.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import abuse_examples as X
from threadloom.llm import arrays as A
from threadloom.session import ship

ORDERS = (3, 4, 5)
BITS = 19
WINDOWS = (4, 7, 11)
PER_PATTERN = 24
SMOOTH = 1.0
PENALTY = 2e-5
STEPS = 60
THRESHOLD = 0.85
SEED = 11
BACKGROUND = 6_000  # ordinary messages
PER_ROW = 5  # windows of each
SHARES = (0.4, 0.3, 0.3)  # of the training weight: abusive, labelled other, ordinary messages

_LOOK = str.maketrans("асеорхуіѕјԁһкмтвнɡαοερνικτωυ", "aceopxyisjdhkmtbngaoepviktwu")
_LEET = str.maketrans("01345789@$!|€£", "oieastbgasiiel")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<![^\s.,!?(])(?:[a-z0-9*@$!] ){2,}[a-z0-9*@$!](?![a-z0-9*])")
_INSIDE = re.compile(r"(?<=[a-z0-9*@$])[._\-'’](?=[a-z0-9*@$])")
_TOKEN = re.compile(r"[a-z0-9*@$!|#]+")
_PLAIN_NUMBER = re.compile(r"\d+[a-z]{0,2}$")
_RUN = re.compile(r"(.)\1+")
_KEEP = str.maketrans({"#": "*", "!": None, "|": None})


def _token(m: re.Match) -> str:
    w = m.group()
    if w.isalpha():
        return w
    tail = len(w) - len(w.rstrip("!|"))
    w = w[: len(w) - tail] if tail else w
    if not any(c.isalpha() for c in w):
        return "0" if any(c.isdigit() for c in w) else " "
    if w[0] == "#":
        return w[1:]
    if _PLAIN_NUMBER.match(w):  # a house number or a model, not a disguised word
        return "0"
    return w.translate(_LEET).replace("#", "*")


def normal(text: str) -> str:
    """The text in one spelling: lower-case words of letters, ``*`` and ``0``, one space between."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = text.lower().translate(_LOOK)
    else:
        text = text.lower()
    if "  " in text or "\t" in text or "\n" in text:
        text = " ".join(text.split())
    text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
    text = _INSIDE.sub("", text)
    text = " ".join(w for w in (_token(m).strip() for m in _TOKEN.finditer(text)) if w)
    return _RUN.sub(r"\1", text)


class Grams:
    """n-grams of normalised texts laid end to end, each between two spaces."""

    def __init__(self, texts: list[str]):
        joined = "".join(f" {t} " for t in texts).encode("ascii", "replace")
        self.chars = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) + 2 for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        space = self.chars == 32
        edge = np.flatnonzero(space[:-1] & ~space[1:])
        self.word = edge  # the space before each word
        self.word_end = np.flatnonzero(~space[:-1] & space[1:]) + 2  # just after the space behind it
        self.word_row = np.searchsorted(self.start, self.word, side="right") - 1

    def features(self, order: int) -> np.ndarray:
        """The hashed n-gram that starts at each place (the last ones wrap into nothing)."""
        n = len(self.chars) - order + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        h = np.full(n, order, A.U)
        with np.errstate(over="ignore"):
            for k in range(order):
                h = h * A.U(0x100000001B3) + self.chars[k : k + n].astype(A.U)
        return (A.mix(h) >> A.U(64 - BITS)).astype(np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, from, to) of every window of ``size`` words, or of the whole text if it is shorter."""
        if not len(self.word):
            return (np.zeros(0, np.int64),) * 3
        first = np.searchsorted(self.word_row, self.word_row)
        count = np.searchsorted(self.word_row, self.word_row, side="right") - first
        at = np.arange(len(self.word)) - first
        use = np.flatnonzero(at + np.minimum(size, count) <= count)
        return self.word_row[use], self.word[use], self.word_end[use + np.minimum(size, count[use]) - 1]


@dataclass
class Model:
    weight: np.ndarray  # of each n-gram: its log-count ratio times its coefficient
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window probability of each text."""
        g = Grams([normal(t) if t else "" for t in texts])
        best = np.full(len(texts), -np.inf)
        sums = []
        for order in ORDERS:
            f = g.features(order)
            sums.append(np.concatenate([[0.0], np.cumsum(self.weight[f], dtype=np.float64)]) if len(f) else np.zeros(1))
        for size in WINDOWS:
            row, a, b = g.windows(size)
            total, n = np.zeros(len(row)), np.zeros(len(row))
            for order, s in zip(ORDERS, sums):
                to = np.minimum(np.maximum(b - order + 1, a), len(s) - 1)
                total += s[to] - s[np.minimum(a, to)]
                n += to - np.minimum(a, to)
            np.maximum.at(best, row, total / np.sqrt(np.maximum(n, 1)) + self.bias)
        out = np.zeros(len(texts))
        some = np.isfinite(best)
        out[some] = 1 / (1 + np.exp(-np.clip(best[some], -40, 40)))
        return out


def training_windows(per_pattern: int = PER_PATTERN, seed: int = SEED, lines: dict[int, list[str]] | None = None) -> tuple[list[str], np.ndarray]:
    """Normalised windows and labels: each example embedded in neutral text and cut as texts are."""
    rng = random.Random(seed)
    texts, labels = [], []
    for passage, label in X.expand(per_pattern, seed, lines):
        before, after = X.carriers(rng).split(), X.carriers(rng).split()
        p = normal(passage).split()
        size = rng.choice(WINDOWS)
        words = [normal(w) or "0" for w in before] + p + [normal(w) or "0" for w in after]
        if label:
            # A window is positive if it holds most of the passage, or is filled by it.
            need = max(1, min(len(p), size, max(3, round(0.8 * len(p)))))
            lo, hi = len(before) + need - size, len(before) + len(p) - need
            at = rng.randint(max(0, min(lo, hi)), max(0, hi))
        else:
            at = rng.randint(0, max(0, len(words) - size))
        texts.append(" ".join(words[at : at + size]))
        labels.append(label)
    return texts, np.array(labels, float)


def background_windows(texts: list[str], seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    out = []
    for t in texts:
        words = normal(t).split()
        for _ in range(PER_ROW if words else 0):
            size = rng.choice(WINDOWS)
            at = rng.randint(0, max(0, len(words) - size))
            out.append(" ".join(words[at : at + size]))
    return out


@cache
def train() -> Model:
    return fit()


def fit(per_pattern: int = PER_PATTERN, seed: int = SEED, lines: dict[int, list[str]] | None = None) -> Model:
    """The model of the labelled text, or of a choice of its patterns by label."""
    texts, y = training_windows(per_pattern, seed, lines)
    ordinary = background_windows(X.messages(BACKGROUND, seed), seed)
    texts, y = texts + ordinary, np.concatenate([y, np.zeros(len(ordinary))])
    g = Grams(texts)
    feats, rows = [], []
    for order in ORDERS:
        f = g.features(order)
        row = np.searchsorted(g.start, np.arange(len(f)), side="right") - 1
        inside = np.arange(len(f)) + order <= g.start[row + 1]
        feats.append(f[inside])
        rows.append(row[inside])
    f, r = np.concatenate(feats), np.concatenate(rows)
    n = np.bincount(r, minlength=len(texts))
    value = 1 / np.sqrt(n[r])
    dim = 1 << BITS
    p = SMOOTH + np.bincount(f, y[r], dim)  # n-gram counts of either class
    q = SMOOTH + np.bincount(f, 1 - y[r], dim)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    used, at = np.unique(f, return_inverse=True)
    x = ratio[used][at] * value
    # Logistic loss by Nesterov steps on w, from the naive Bayes solution w = 1.
    w, v, b, vb = np.ones(len(used)), np.zeros(len(used)), 0.0, 0.0
    kind = np.concatenate([1 - y[: len(y) - len(ordinary)], np.full(len(ordinary), 2)]).astype(int)
    balance = (np.array(SHARES) / np.maximum(np.bincount(kind, minlength=3), 1))[kind]
    for step in range(STEPS):
        m = min(0.9, step / (step + 3))
        ahead, ahead_b = w + m * v, b + m * vb
        z = np.bincount(r, x * ahead[at], len(y)) + ahead_b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        grad = np.bincount(at, x * e[r], len(used)) + PENALTY * (ahead - 1)
        v, vb = m * v - 10.0 * grad, m * vb - 1.0 * e.sum()
        w, b = w + v, b + vb
    weight = np.zeros(dim, np.float32)
    weight[used] = ratio[used] * w
    return Model(weight, float(b))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for i, j, text in A.chunks(batch.column("text")):
                s = m.scores(text.to_pylist())
                yield pa.record_batch([batch.column("row_id").slice(i, j - i), batch.column("source").slice(i, j - i), pa.array(np.round(s, 6))], names=["row_id", "source", "score"])

    return run


def scores(df: DataFrame, text: str, source: str = "ingest_source", row_id: str = "row_id") -> DataFrame:
    """``(row_id, source, score)`` of every row."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train())
    return rows.mapInArrow(_score(model), "row_id long, source string, score double")


def found(df: DataFrame, text: str, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    """``row_id`` of every row whose score reaches the threshold."""
    return scores(df, text, **names).where(F.col("score") >= threshold).select("row_id").distinct()


def rates(df: DataFrame, text: str, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    """Per source: rows, rows that reach the threshold, their rate and the mean score."""
    hit = (F.col("score") >= threshold).cast("long")
    return scores(df, text, **names).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hit).alias("n_abusive"), F.round(F.avg(hit), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
