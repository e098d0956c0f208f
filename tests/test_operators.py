from __future__ import annotations

import math
import random

import pytest

from threadloom.operators import bulk, classify, metrics, pairing, ranking, retrieval, rules, sampling
from threadloom.plans.catalog import QUERIES
from threadloom.sources import files
from threadloom.streaming import ingest


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_metrics_toy(spark):
    df = spark.createDataFrame(list(zip("AABBCC", "ABBBCA")), "t string, p string")
    cells = metrics.confusion(df, "t", "p")
    assert set(rows(cells)) == {("A", "A", 1), ("A", "B", 1), ("B", "B", 2), ("C", "C", 1), ("C", "A", 1)}
    per = {r.label: r for r in metrics.per_class(cells).collect()}
    assert per["A"].precision == 0.5 and per["B"].recall == 1.0
    assert metrics.summary(cells).first().accuracy == 0.6667
    assert ("(all)", "(all)", 6) in rows(metrics.confusion_totals(cells))


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "t string, p string")
    assert metrics.kappa(metrics.confusion(df, "t", "p")).first().kappa == 0.5
    same = spark.createDataFrame([("a", "a")] * 3, "t string, p string")
    assert metrics.kappa(metrics.confusion(same, "t", "p")).first().kappa == 1.0


def test_place_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)] + [(None,)], "v double")
    assert sorted(rows(metrics.sorted_place_quantiles(df, "v", [0.5, 0.95]))) == [(0.5, 3.0), (0.95, 4.0)]
    assert rows(metrics.sorted_place_quantiles(df.limit(0), "v", [0.5])) == []


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(x % 7,) for x in range(50)], "v int")
    got = sorted(rows(ranking.global_rank(df, ["v"])), key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(1, 51)) and [r[0] for r in got] == sorted(x % 7 for x in range(50))


def test_majority_prefers_the_label_seen_first(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "x"), (5, None)], "id int, l string")
    assert rows(classify.majority(df, "l", "id")) == [("x", 2, 0.5)]


def test_naive_bayes(spark):
    corpus = [
        (1, "battery drains fast battery", "battery"), (2, "battery dies quickly", "battery"), (3, "keyboard typing autocorrect", "keyboard"), (4, "autocorrect changes typing", "keyboard"),
        (5, "screen is black frozen", "display"), (6, "black screen touch", "display"), (7, "refund charged card", "billing"), (8, "charged twice refund", "billing"),
    ]
    df = spark.createDataFrame(corpus, "id int, text string, label string")
    model = classify.fit_bayes(df, "id", "text", "label", alpha=1.0)
    test = spark.createDataFrame([(1, "my battery keeps dying battery"), (2, "autocorrect typing issue"), (3, "zzz qqq"), (4, None)], "id int, text string")
    got = {r.id: r for r in classify.predict_bayes(model, test, "id", "text", "other").collect()}
    assert got[1].predicted == "battery" and got[2].predicted == "keyboard"
    assert (got[3].predicted, got[3].confidence, got[3].oov) == ("other", 0.5, True) and got[4].oov


def test_bm25_scores_by_hand(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    index = retrieval.fit(df)
    q = spark.createDataFrame([(1, "red red"), (2, "apple"), (3, "!!!"), (4, None)], "qid long, q string")
    got = rows(retrieval.search(index, q, "qid", "q", 5).select("qid", "doc_id", "rank", "score").orderBy("qid", "rank"))
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    score = lambda tf, dl: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.75)), 4)
    assert got == [(1, 2, 1, score(2, 3)), (1, 1, 2, score(1, 2))]


def test_first_reply_wins(spark):
    t = [("1", "c", "True", "x", "my phone is slow", "2,3", None), ("2", "Brand", "false", "x", "first", "", "1"), ("3", "brand", "False", "x", "second", "", "1"), ("4", "c", "true", "x", "hm", "", ""), ("5", "brand", "False", "x", "late", "", "99")]
    df = spark.createDataFrame(t, files.TWEETS)
    got = pairing.reply_pairs(df, "BRAND").collect()
    assert [(r.pair_id, r.n_replies, r.is_initial, r.response_ids) for r in got] == [("pair_1_2", 2, True, ["2", "3"])]


def test_quarantine_trims_and_keeps_nulls(spark):
    df = spark.createDataFrame([("1",), (" 2",), (None,), ("",)], "id string")
    held = spark.createDataFrame([("2 ",), ("",), (None,)], "h string")
    assert sorted(rows(pairing.quarantine(df, held, "id", "h")), key=repr) == [("",), ("1",), (None,)]


def test_dedupe_first_runs_in_order(spark):
    df = spark.createDataFrame([(1, "a", "t"), (2, "a", "u"), (3, "b", "t"), (4, "c", "u")], "n int, id string, t string")
    assert sorted(rows(ranking.dedupe_first(df, [["id"], ["t"]], ["n"]).select("n"))) == [(1,), (4,)]


def test_rules(spark):
    df = spark.createDataFrame([("battery and screen",), ("my screen",), (None,), ("nothing",)], "x string")
    assert sorted(rows(rules.coverage(df, "x"))) == [("battery_power", 1, 0), ("display_touch", 2, 1)]
    assert rows(rules.match_sizes(df, "x")) == [(2, 1, 1)]


def test_quota_prefers_flagged_and_may_stay_short(spark):
    df = spark.createDataFrame([(i, "a", i < 2) for i in range(10)] + [(20, "b", True)], "id int, s string, f boolean")
    got = sampling.quota_sample(df, "s", "f", "id", {"a": 6, "b": 5}, 0.5, 1).collect()
    assert sum(r.f for r in got if r.s == "a") == 2 and sum(r.s == "a" for r in got) == 6 and sum(r.s == "b" for r in got) == 1


def test_generator_and_shuffle():
    s = sampling.uniform_stream(42)
    assert [round(next(s), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]
    out = sampling.shuffled(list(range(10)), 7)
    assert sorted(out) == list(range(10)) and out == sampling.shuffled(list(range(10)), 7)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" 1", "a", "True", None, 'quote " and\nbreak, comma', "", "2")], files.TWEETS)
    files.write_csv(df, str(tmp_path / "c"))
    r = files.read_csv(spark, str(tmp_path / "c")).first()
    assert (r.tweet_id, r.text) == (" 1", 'quote " and\nbreak, comma')


def test_index_round_trip_and_gz_fallback(spark, tmp_path):
    df = spark.createDataFrame([(1, "red apple"), (2, "red car")], "doc_id long, text string")
    files.write_index(retrieval.fit(df), str(tmp_path / "i"))
    assert files.read_index(spark, str(tmp_path / "i")).terms.count() == 1
    (tmp_path / "x.json.gz").write_bytes(b"")
    assert files.first_existing(spark, str(tmp_path / "x.json")).endswith(".gz")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "none"))


def test_stream_join_and_sessions(spark, tmp_path):
    a = spark.createDataFrame([("1", "2020-01-01 00:00:00"), ("2", "2020-01-01 00:10:00")], "id string, at string").selectExpr("id", "timestamp(at) at")
    b = spark.createDataFrame([("1", "2020-01-01 00:05:00"), ("9", "2020-01-01 00:06:00")], "answers string, at string").selectExpr("answers", "timestamp(at) replied_at")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    joined = ingest.reply_stream(ingest.read_stream(spark, str(tmp_path / "a"), a, 100), ingest.read_stream(spark, str(tmp_path / "b"), b, 100))
    seen = []
    ingest.each_batch(joined, lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "s")).awaitTermination()
    assert seen == ["1"]


def test_code_fence_query_covers_fenced_and_null_texts(spark, tmp_path):
    texts = ["a", "see\n```\nx\n```\nend", "```\nx\n```", None, "", "ends with ```"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.body for r in QUERIES["strip_code_fence_all"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(texts))


def test_dup_rate_covers_queries_without_language(spark, tmp_path):
    docs = [(0, "The screen flickers", None), (1, "the screen flickers ", "en"), (100, "battery drains fast", "en"), (101, "battery is fine", "en"), (200, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(QUERIES["a_exact_dup_rate_all"](spark, str(tmp_path))) == [(3, 1)]


def test_summary_over_a_class_list_counts_every_row(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("a", None), ("zz", "a"), (None, "a")], "t string, p string")
    got = metrics.class_summary(df, "t", "p", ["a", "b", "c"]).first()
    assert (got.n, got.accuracy) == (6, 0.3333)
    assert (got.macro_precision, got.macro_recall) == (round((1 / 3 + 1 / 2) / 3, 4), round((1 / 3 + 1) / 3, 4))
    wrong = metrics.failures(df.selectExpr("monotonically_increasing_id() as id", "*"), "id", "t", "p", 1)
    assert sorted((r.truth, r.n_wrong) for r in wrong.collect()) == [("a", 2), ("zz", 1)]
    assert metrics.class_summary(df.limit(0), "t", "p", ["a"]).first().n == 0


def test_majority_predicts_every_row_and_labels_have_a_source(spark):
    df = spark.createDataFrame([(1, "x", "ann", "y"), (2, None, "ann", "y"), (3, "x", None, "z")], "id int, h string, who string, auto string")
    got = rows(classify.predict_majority(classify.majority(df, "h", "id"), df, "id"))
    assert got == [(1, "x", 1.0), (2, "x", 1.0), (3, "x", 1.0)]
    label, source = classify.evaluation_label("h", "who", "auto")
    assert rows(df.select("id", label, source)) == [(1, "x", "human_author (ann)"), (2, "y", "automatic_proposal"), (3, "z", "automatic_proposal")]


def test_models_are_read_back_and_annotations_merged(spark, tmp_path):
    df = spark.createDataFrame([(1, "battery dies fast", "p"), (2, "battery drain", "p"), (3, "keyboard types wrong", "k"), (4, None, None)], "id int, text string, label string")
    model = classify.fit_bayes(df, "id", "text", "label")
    files.write_model(model, str(tmp_path / "m"))
    back = files.read_model(spark, str(tmp_path / "m"), classify.NaiveBayes)
    assert sorted(rows(classify.predict_bayes(back, df, "id", "text", "?"))) == sorted(rows(classify.predict_bayes(model, df, "id", "text", "?")))
    assert files.size_of(spark, str(tmp_path / "m")) > 0 and files.size_of(spark, str(tmp_path / "none")) == 0
    new = spark.createDataFrame([(3, "q"), (9, "r")], "id int, label string")
    assert rows(pairing.merge_annotations(df.select("id", "label"), new, "id", ["label"])) == [(1, "p"), (2, "p"), (3, "q"), (4, None)]


def test_many_query_terms_meet_the_postings_slot_by_slot(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"battery word{i % 7} charger word{i % 3}") for i in range(60)] + [(90, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "battery word2"), (2, "nothing here"), (3, None)], "qid int, q string")
    index = retrieval.fit(df)
    whole = sorted(rows(retrieval.scores(index, q, "qid", "q")))
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 0)
    assert sorted(rows(retrieval.scores(index, q, "qid", "q"))) == whole and whole


def test_progress_counts_the_rows_of_a_stream(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "cast(null as string) as note")
    df.write.parquet(str(tmp_path / "in"))
    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        ingest.write_jsonl_stream(ingest.read_stream(spark, str(tmp_path / "in"), df, 100), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert files.read_jsonl(spark, str(tmp_path / "out"), df.schema).count() == 50
        for _ in range(50):
            if seen.rows:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows == 50


@pytest.mark.parametrize("piece, share", [(200_000, 0.006), (40, 0.006), (200_000, 0.0), (200_000, 2.0)])
def test_bulk_search_gives_the_hits_of_the_join(spark, monkeypatch, piece, share):
    rng = random.Random(7)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(400)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 8))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:40], "w1 w2", "w1 w2", "w1 w2", None, ""])], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*texts[:30], "w1", "w1 w1", "none", None])], "qid string, q string")
    for name, value in {"PIECE_TERMS": piece, "COMMON_SHARE": share, "QUERY_BLOCK": 7, "DOC_BLOCK": 16, "FIRST_DOCS": 4, "MORE_DOCS": 32, "PENDING": 50}.items():
        monkeypatch.setattr(bulk, name, value)
    index = retrieval.fit(df)
    cols = ["qid", "doc_id", "score", "rank"]
    want = sorted(rows(retrieval.search(index, q, "qid", "q", 6).select(cols)))
    assert sorted(rows(bulk.search(index, q, "qid", "q", 6).select(cols))) == want and want
    assert rows(bulk.search(index, q.where("qid is null"), "qid", "q", 6)) == []


def test_leak_search_moves_no_row_for_each_pair_and_golden_item(spark, tmp_path):
    spark.range(1500).selectExpr("id as row_id", "concat('battery drains fast x', id % 50) as customerTextClean", "cast(id as string) as customerTweetId").write.parquet(str(tmp_path / "applesupport_pairs.parquet"))
    spark.range(300).selectExpr("concat('g', id) as goldenId", "concat('battery drains x', id % 50) as customerTextClean", "cast(id as string) as tweetId").write.parquet(str(tmp_path / "golden_set.parquet"))
    sc = spark.sparkContext

    def moved():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    # Of 30 pairs with the same text the first 20 are found, by row id; items 0 to 299 hold the first six.
    assert rows(QUERIES["j_leak_search"](spark, str(tmp_path))) == [(6000, 300, 300)]
    assert sum(n for stage, n in moved().items() if stage not in before) < 1500 * 300 / 10
