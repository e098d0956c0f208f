"""Conversations and consensus: definitions on small fixtures, recovery on simulated votes."""

from __future__ import annotations

import datetime
import random

from threadloom.llm import consensus as K
from threadloom.llm import conversations as V
from threadloom.llm import sessions as G

DDL = "row_id long, customerTweetId string, supportTweetId string, customerInResponseToId string, isInitialInquiry boolean, customerCreatedAt string, customerTextClean string, supportTextClean string, root string, ptr int"


def talk(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6] if len(r) > 6 else "q", r[7] if len(r) > 7 else "a", "x", 0) for r in rows], DDL)


def turns(df):
    return sorted(tuple(r) for r in V.conversations(df).collect())


def flat(root, *pairs):
    return [(root, n + 1, t, "customer" if n % 2 == 0 else "support") for n, t in enumerate(x for p in pairs for x in p)]


def test_order_by_time_but_never_before_the_answered_row(spark):
    df = talk(spark, [(1, "c1", "s1", None, True, "100"), (2, "c2", "s2", " s1 ", False, "400"), (3, "c3", "s3", "s2", False, "200"), (4, "c4", "s4", "s1", False, "300"), (5, "c5", "s5", "s2", False, None)])
    assert turns(df) == sorted(flat("c1", ("c1", "s1"), ("c4", "s4"), ("c2", "s2"), ("c5", "s5"), ("c3", "s3")))


def test_repeated_rows_count_once_and_ids_are_trimmed(spark):
    df = talk(spark, [(2, " c1", "s1 ", "", None, "1"), (1, "c1", "s1", None, None, "1"), (3, None, "s9", None, True, "1"), (4, " ", "s8", None, True, "1")])
    assert turns(df) == flat("c1", ("c1", "s1"))


def test_broken_conversations_are_dropped(spark):
    bad = [
        [(1, "a", "b", None, True, "1"), (2, "c", None, "b", False, "2")],  # no reply
        [(1, "a", "b", None, True, "1"), (2, "c", "d", "b", False, "2", " \n")],  # blank text
        [(1, "a", "b", None, True, "1"), (2, "c", "d", "b", True, "2")],  # two openings
        [(1, "a", "b", "zz", False, "1"), (2, "c", "d", "b", False, "2")],  # no opening
        [(1, "a", "b", "d", False, "1"), (2, "c", "d", "b", False, "2")],  # a circle
        [(1, "a", "b", None, None, "1", None)],
        [(1, "a", "b", "gone", None, "1")],  # answers something that is absent
    ]
    for rows in bad:
        assert turns(talk(spark, rows)) == [], rows
    assert turns(talk(spark, bad[0]).limit(0)) == []


def test_an_opening_row_that_answers_joins_the_sets(spark):
    assert turns(talk(spark, [(1, "a", "b", None, True, "1"), (2, "c", "d", "b", True, "2"), (3, "e", "f", None, True, "3")])) == flat("e", ("e", "f"))


def test_long_chain(spark):
    n = 70
    rows = [(i, f"c{i:03}", f"s{i:03}", f"s{i - 1:03}" if i else None, i == 0, str(1000 - i)) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert turns(talk(spark, rows)) == sorted(flat("c000", *[(f"c{i:03}", f"s{i:03}") for i in range(n)]))


AGREE = "goldenId string, annotatorA string, annotatorB string, adjudicatedLabel string, annotator_a_id string, annotator_b_id string, label string, item int"
VOTES = "vote_id long, golden_id string, annotator_id string, vote_label string, voted_at timestamp"


def test_latest_valid_vote_holds(spark):
    t = datetime.datetime(2020, 1, 1)
    a = spark.createDataFrame([("g1", "Battery Power", "audio-media ", None, "x", "y", "l", 1), ("g2", None, "??", None, None, "y", "l", 1)], AGREE)
    v = spark.createDataFrame([(1, "g1", "x", "skip", t), (2, "g1", "x", "APPS_APPSTORE", t), (3, "g1", "x", "software update", t), (4, " g1", "z", "audio_media", t), (5, None, "z", "audio_media", t), (6, "g1", "", "audio_media", t)], VOTES)
    got = sorted(tuple(r) for r in K.valid_votes(a, v).collect())
    assert got == [("g1", "x", "software_update"), ("g1", "y", "audio_media"), ("g1", "z", "audio_media")]
    fit = K.fit(a, v)
    assert [(r.golden_id, r.label, r.n_annotators) for r in fit.items.collect()] == [("g1", "audio_media", 3)]


def test_recovers_truth_better_than_the_vote(spark):
    rng = random.Random(5)
    truth = {f"g{i:04}": rng.choice(K.INTENTS) for i in range(300)}
    skill = {f"ann{j}": s for j, s in enumerate((0.95, 0.9, 0.8, 0.3, 0.25, 0.2, 0.2))}
    votes, n = [], 0
    for item, label in truth.items():
        for name in rng.sample(sorted(skill), 5):
            n += 1
            wrong = K.INTENTS[(K.INTENTS.index(label) + 1) % 10] if rng.random() < 0.6 else rng.choice(K.INTENTS)
            votes.append((n, item, name, label if rng.random() < skill[name] else wrong, datetime.datetime(2020, 1, 1)))
    fit = K.fit(spark.createDataFrame([], AGREE), spark.createDataFrame(votes, VOTES))
    rows = fit.items.collect()
    ours = sum(r.label == truth[r.golden_id] for r in rows) / len(rows)
    by = {}
    for _, item, _, label, _ in votes:
        by.setdefault(item, []).append(label)
    plain = sum(max(sorted(set(x)), key=x.count) == truth[i] for i, x in by.items()) / len(by)
    assert len(rows) == 300 and ours > plain + 0.05
    est = {r.annotator_id: r.reliability for r in fit.annotators.collect()}
    assert est["ann0"] > est["ann2"] > est["ann5"]
    one = K.agreement_summary(K.item_agreement(spark.createDataFrame([], AGREE), spark.createDataFrame(votes, VOTES))).first()
    assert one.n_items == 300 and 0 < one.pairwise_agreement < 1
    assert {(r.golden_id, r.n_annotators) for r in rows} == {(i, len(x)) for i, x in by.items()}


def test_as_many_annotators_as_items(spark, monkeypatch):
    """50,000 annotators of three votes each, one of whom votes on every item; blocks and pieces are small."""
    monkeypatch.setattr(K, "COIN_ROUNDS", 1)
    monkeypatch.setattr(K, "ROUNDS", 1)
    ids = spark.range(50_000).selectExpr("id", "explode(sequence(0, 2)) as j")
    label = f"element_at(array({', '.join(map(repr, K.INTENTS))}), cast(pmod(item, 10) as int) + 1)"
    many = ids.selectExpr("id * 3 + j as vote_id", "cast(pmod(id * 7 + j * 13, 40000) as long) as item", "concat('a', id) as annotator_id").union(spark.range(40_000).selectExpr("150000 + id", "id", "'hot'"))
    votes = many.selectExpr("vote_id", "concat('g', item) as golden_id", "annotator_id", f"{label} as vote_label", "timestamp'2020-01-01' as voted_at")
    fit = K.fit(spark.createDataFrame([], AGREE), votes)
    assert fit.annotators.count() == 50_001
    assert fit.annotators.where("annotator_id = 'hot'").first().n_votes == 40_000
    right = fit.items.selectExpr("cast(substring(golden_id, 2) as long) as item", "label").where(f"label = {label}").count()
    assert right == fit.items.count() > 30_000


def test_an_item_of_more_votes_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(K, "AT_ONCE", 7)
    votes = [(i, "g", f"a{i}", K.INTENTS[3] if i % 3 else "Battery-Power", datetime.datetime(2020, 1, 1)) for i in range(50)]
    rows = K.fit(spark.createDataFrame([], AGREE), spark.createDataFrame(votes, VOTES)).items.collect()
    assert [(r.golden_id, r.label, r.n_annotators, r.agreement) for r in rows] == [("g", "battery_power", 50, 1.0)]


def test_empty_tables(spark):
    fit = K.fit(spark.createDataFrame([], AGREE), spark.createDataFrame([], VOTES))
    assert fit.items.count() == 0 and fit.annotators.count() == 0


FEED = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"


def brute_sessions(rows, gap):
    out, by = {}, {}
    for t in {r[0]: r for r in rows}.values():
        customer = t[1] if t[2] == "True" else t[4].split()[0][1:]
        by.setdefault(customer, []).append((int(t[3]), t[0], "customer" if t[2] == "True" else "support"))
    for m in by.values():
        m.sort()
        cuts = [0] + [i for i in range(1, len(m)) if m[i][0] - m[i - 1][0] > gap] + [len(m)]
        for a, b in zip(cuts, cuts[1:]):
            if m[a][2] == "customer" and len({x[2] for x in m[a:b]}) == 2:
                out.update({(m[a][1], n + 1, x[1], x[2]): 1 for n, x in enumerate(m[a:b])})
    return set(out)


def test_sessions_split_at_gaps_across_partitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        customer = rng.choice(["1", "1", "1", "2", "3"])
        inbound = rng.random() < 0.5
        rows.append((f"t{i:03}", customer if inbound else "Brand", str(inbound), str(rng.randrange(40_000)), "@Brand hi" if inbound else f"@{customer} hello", "", ""))
    feed = spark.createDataFrame(rows + rows[:20] + [(None, "1", "True", "5", "@Brand x", "", ""), ("zz", "1", "True", "soon", "@Brand x", "", ""), ("zy", "Brand", "False", "9", None, "", "")], FEED)
    got = {tuple(r) for r in G.sessions_by_gap(feed, gap=400 * 1_000_000).collect()}
    assert got == brute_sessions(rows, 400) and len(got) > 100
    assert G.sessions_by_gap(feed.limit(0)).count() == 0
    assert G.sessions_by_gap(feed).count() > 0
