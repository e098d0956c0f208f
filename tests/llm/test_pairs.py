"""Copies, near duplicates and split overlaps against brute force, and their defined edge cases."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from threadloom.llm import arrays as A
from threadloom.llm import copies as C
from threadloom.llm import near as N
from threadloom.llm import splits as P
from threadloom.llm.groups import components
from threadloom.session import Scratch

DDL = "row_id long, t string, node string, k string, text int, salt double, first_id string"


def frame(spark, texts):
    return spark.createDataFrame([(i + 1, t, "x", "y", 0, 0.0, None) for i, t in enumerate(texts)], DDL)


def words(x):
    return frozenset(re.findall(r"[^\W_]+", (x or "").lower()))


def groups_of(pairs, n):
    parent = list(range(n + 1))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {(find(i), i) for i in range(1, n + 1) if find(i) != i}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbBÉé ß9_-.·İΣσ𝔸😡\n", max_size=12), min_size=1, max_size=5))
def test_content_hash_follows_the_canonical_string(texts):
    h, kept = A.content_hashes(A.texts_of(pa.array(texts)))
    canon = ["".join(c for c in t.lower() if c.isalnum()) for t in texts]
    assert [int(x) for x in kept] == [len(c) for c in canon]
    for (x, cx), (y, cy) in itertools.combinations(zip(h, canon), 2):
        assert (x == y) == (cx == cy)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab1 _É,\t😡", max_size=20), min_size=1, max_size=4))
def test_words_are_runs_of_letters_and_digits(texts):
    t = A.texts_of(pa.array(texts))
    row, start, end, f = A.words(t)
    got = [(int(r), "".join(map(chr, f[s:e]))) for r, s, e in zip(row, start, end)]
    assert got == [(i, w) for i, x in enumerate(texts) for w in re.findall(r"[^\W_]+", x.lower())]


def test_copies_edge_cases(spark):
    texts = ["Hello, World", None, "", "  ", "!!!", "hello world", "HELLOWORLD", "é", "É!", "A: x; B: y; C: z", "c : Z | a : X | b : Y", "Axbycz", "a: x; b: y", "b: y; a: x", "z" * 300_000, "Z " * 300_000]
    got = {tuple(r) for r in C.copies_found(frame(spark, texts), "t").collect()}
    # The two-field texts keep their order; the three-field ones do not, also through a plain third.
    assert got == {(1, 6), (1, 7), (8, 9), (10, 11), (10, 12), (15, 16)}
    assert {tuple(r) for r in C.records(frame(spark, texts), "t").where("n_copies > 1").collect()} == {(1, 3), (8, 2), (10, 3), (15, 2)}


def test_copies_joined_through_a_record_of_the_plain_first_row(spark):
    texts = ["a1b2c3", "b: 2; a: 1; c: 3", "a: 1; b: 2; c: 3", "A1 B2 C3", "b2a1c3", "a: 1; c: 3; b: 2"]
    got = {tuple(r) for r in C.copies_found(frame(spark, texts), "t").collect()}
    assert got == {(1, n) for n in range(2, 7)}
    assert [tuple(r) for r in C.records(frame(spark, texts), "t").collect()] == [(1, 6)]


def test_copies_of_empty_and_repeated(spark):
    assert C.copies_found(frame(spark, ["a"]).limit(0), "t").count() == 0
    twice = frame(spark, ["same", "Same."]).union(frame(spark, ["same", "Same."]))
    assert [tuple(r) for r in C.copies_found(twice, "t").collect()] == [(1, 2)]


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    assert not C.same_content("ab-c", "abd") and C.same_content("A.b c", "abC") and C.same_content("", "!!")
    x, y = A.texts_of(pa.array(["ab", "a", "", "x y"])), A.texts_of(pa.array(["A-B", "b", "?", "xyz"]))
    assert C._equal_rows(x, y).tolist() == [True, False, True, False]


def noisy(rng, vocab, base):
    w = list(base)
    for _ in range(rng.randint(0, 4)):
        k = rng.random()
        if k < 0.4:
            w[rng.randrange(len(w))] = rng.choice(vocab)
        elif k < 0.7 and len(w) > 3:
            w.pop(rng.randrange(len(w)))
        else:
            w.insert(rng.randrange(len(w)), rng.choice(vocab))
    return w


@pytest.mark.parametrize(("single", "hot"), [(1000, 200_000), (2, 200_000), (5, 8), (2, 16)])
def test_near_groups_against_brute_force(spark, monkeypatch, single, hot):
    monkeypatch.setattr(N, "SINGLE", single)
    rng = random.Random(single)
    vocab = [f"w{i}" for i in range(150)]
    bases = [rng.choices(vocab[: rng.choice((20, 150))], k=rng.randint(6, 25)) for _ in range(25)]
    texts = [" ".join(noisy(rng, vocab, rng.choice(bases))) for _ in range(160)] + [None, "", "one two three", "one two three", "a b c d e f", "F e d; c b A"]
    sets = [words(t) for t in texts]
    near = [(i + 1, j + 1) for i, j in itertools.combinations(range(len(sets)), 2) if min(len(sets[i]), len(sets[j])) >= 6 and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])]
    want = {("t", a, b) for a, b in groups_of(near, len(texts))}
    got = {tuple(r) for r in N.near_groups(frame(spark, texts), ["t"], hot=hot).collect()}
    assert got == want and len(want) > 20


def test_large_and_small_sets_against_brute_force(spark, monkeypatch):
    """Sets around the sizes at which the number of blocks changes, all of frequent words."""
    monkeypatch.setattr(N, "SINGLE", 1)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for n in (6, 7, 8, 9, 10, 11, 12, 63, 64, 65, 90, 91, 128, 180, 256):
        base = rng.sample(vocab, n)
        for cut in (0, 1, 2, n // 8, n // 5, n // 4, n // 3):
            texts += [" ".join(base[cut:]), " ".join(base + rng.sample(vocab, cut))]
    sets = [words(t) for t in texts]
    near = [(i + 1, j + 1) for i, j in itertools.combinations(range(len(sets)), 2) if min(len(sets[i]), len(sets[j])) >= 6 and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])]
    # Every near pair shares a signature of which the smaller set's is an index one.
    t = A.texts_of(pa.array(texts))
    row, tok = A.word_sets(t)
    counts = __import__("numpy").full(1 << N.BUCKETS, 5)
    for n_sets in (1, 100):
        r, sig, index = N.signatures(row, tok, len(texts), counts, n_sets, 0.7)
        of = {}
        for x, s, i in zip(r.tolist(), sig.tolist(), index.tolist()):
            of.setdefault(x, {})[s] = of.get(x, {}).get(s, False) or i
        for a, b in near:
            a, b = sorted((a - 1, b - 1), key=lambda k: len(sets[k]))
            met = [s for s, i in of[a].items() if s in of[b] and (i or (len(sets[a]) == len(sets[b]) and of[b][s]))]
            assert met, (len(sets[a]), len(sets[b]), n_sets)
    want = {("t", a, b) for a, b in groups_of(near, len(texts))}
    assert {tuple(r) for r in N.near_groups(frame(spark, texts), ["t"]).collect()} == want


def test_combinations_of_many_common_words_stay_few():
    import numpy as np

    for n in (100, 200, 400, 2000):
        row, tok = np.zeros(n, np.int64), A.mix(np.arange(n))
        _, sig, _ = N.signatures(row, tok, 1, np.full(1 << N.BUCKETS, 2**31 - 1), 10**6, 0.7)
        assert len(sig) < 40 * n, (n, len(sig))


@pytest.mark.parametrize("hot", [1_000_000, 1_000])
def test_a_template_with_one_word_changed(spark, hot):
    """All rows are near all others: links stay fewer than rows, whole or in blocks."""
    n = 6_000
    df = spark.range(1, n + 1).selectExpr("id as row_id", "concat('your order number ', id, ' has been sent to the shop on the main road today and will arrive soon') as t")
    links = {}
    real = N.components

    def counted(edges, scratch, *a):
        links[len(links)] = edges.count()
        return real(edges, scratch, *a)

    N.components = counted
    try:
        got = N.near_groups(df, ["t"], hot=hot)
        assert got.count() == n - 1 and got.select("first_row_id").distinct().count() == 1
    finally:
        N.components = real
    assert max(links.values()) < 3 * n


def test_a_forest_of_a_million_rows_of_one_group():
    import numpy as np

    n = 1_000_000
    tested = []

    def near(a, b):
        tested.append(len(a))
        return np.ones(len(a), bool)

    lab, links = N.forest(np.zeros(n, np.int64), np.zeros(1, np.int64), near, np.full(n, 20), 0.7)
    assert (lab == 0).all() and sum(len(a) for a, _ in links) == n - 1 and sum(tested) < 2 * n


def test_near_groups_keep_fields_apart(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "x", "a b c d e f g"), (3, "a b c d e f h", None)], "row_id long, p string, q string")
    assert [tuple(r) for r in N.near_groups(df, ["p", "q"]).collect()] == [("p", 1, 3)]
    assert N.near_groups(df.limit(0), ["p", "q"]).count() == 0


def test_many_copies_of_one_text(spark):
    df = frame(spark, ["a b c d e f g"] * 500 + ["a b c d e f h"])
    got = N.near_groups(df, ["t"]).collect()
    assert len(got) == 500 and {r.first_row_id for r in got} == {1}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {(i, 1) for i in range(1, 71)} | {(1000 + i, 1000) for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_overlaps(spark):
    train = spark.createDataFrame(
        [(1, " 77", "alpha beta"), (2, "5", "One two, three four five six seven"), (3, "6", "one two three four five six eight"), (4, "7", "k: a; l: b; m: c"), (5, None, None), (6, "", "?"), (2, "5", "One two, three four five six seven")],
        "row_id long, id string, t string",
    )
    evals = spark.createDataFrame(
        [("g1", "77 ", "nothing here"), ("g2", None, "ONE TWO THREE FOUR FIVE SIX SEVEN"), ("g3", " ", "m: c | k: a | l: b"), ("g4", "x", None), (None, "5", "alpha beta"), ("g5", "y", "?!")], "key string, id string, t string"
    ).withColumnRenamed("id", "eid")
    got = {tuple(r) for r in P.overlaps(evals, train, "key", "eid", "id", "t").collect()}
    assert got == {("g1", 1), ("g2", 2), ("g2", 3), ("g3", 4)}
    assert P.overlaps(evals.limit(0), train, "key", "eid", "id", "t").count() == 0
    assert P.overlaps(evals, train.limit(0), "key", "eid", "id", "t").count() == 0
