"""Queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import abuse, consensus, conversations, copies, encoding, leaks, near, pii, sessions, spans, splits
from threadloom.session import load

PAIRS = "applesupport_pairs"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(load(spark, d, PAIRS), "customerTextClean")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(load(spark, d, PAIRS), "customerTextClean").select("row_id", F.col("source").alias("ingest_source"), "score")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(load(spark, d, PAIRS), "customerTextClean").withColumnRenamed("source", "ingest_source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(load(spark, d, PAIRS), "customerTextClean")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.records(load(spark, d, PAIRS), "customerTextClean")


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.fit(load(spark, d, "golden_agreement"), load(spark, d, "golden_votes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.select("golden_id", "label")


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).annotators


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement_summary(consensus.item_agreement(load(spark, d, "golden_agreement"), load(spark, d, "golden_votes")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(load(spark, d, PAIRS), ["customerTextRaw", "supportTextRaw"]).where(F.col("pii_type").isin(*pii.TYPES))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(load(spark, d, PAIRS), ["customerTextRaw", "supportTextRaw"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(load(spark, d, PAIRS))


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions_by_gap(load(spark, d, "tweets"))


def p5_sessions_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions_of(sessions.pair_messages(load(spark, d, PAIRS)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(load(spark, d, PAIRS), ["customerTextClean", "supportTextClean"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = splits.overlaps(load(spark, d, "golden_set"), load(spark, d, PAIRS), "goldenId", "tweetId", "customerTweetId", "customerTextClean")
    return found.withColumnRenamed("goldenId", "golden_id")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    golden = load(spark, d, "golden_set")
    found = splits.overlaps(golden, load(spark, d, PAIRS), "goldenId", "tweetId", "customerTweetId", "customerTextClean")
    return splits.overlap_counts(found, golden, "goldenId", "eval_split", "samplingStratum")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode_corpus(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(load(spark, d, "documents"))


def p10_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(load(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
