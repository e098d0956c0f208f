"""Message ingest: reply pairs, profiles and leak checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T


def inbound(df: DataFrame) -> DataFrame:
    return df.where(T.parse_bool("inbound"))


def outbound_of(df: DataFrame, brand: str) -> DataFrame:
    return df.where(~T.parse_bool("inbound") & (F.lower(F.trim("author_id")) == brand.lower()))


def reply_pairs(tweets: DataFrame, brand: str, order: str | None = None) -> DataFrame:
    """Customer messages with the first reply of a brand and the number of its replies.

    First is the smallest ``order`` (an ordinal of the source's rows where it has one), else the smallest id by
    number, since files have no order once they are read in parallel; ids that are no numbers come first, as text.

    The replies are reduced to one row per answered message by a combining aggregate before the join.
    """
    ids = lambda c: F.trim(F.col(c))
    reply = F.struct(F.col(order).alias("o") if order else F.trim("tweet_id").try_cast("bigint").alias("o"), ids("tweet_id").alias("support_id"), F.col("text").alias("support_raw"), F.col("created_at").alias("support_at"))
    replies = outbound_of(tweets, brand).select(ids("in_response_to_tweet_id").alias("customer_id"), reply.alias("r")).where("customer_id <> ''")
    replies = replies.groupBy("customer_id").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n_replies"))
    customers = inbound(tweets).select(
        ids("tweet_id").alias("customer_id"), "author_id", F.col("created_at").alias("customer_at"), F.col("text").alias("customer_raw"), T.clean_text("text").alias("customer_clean"), T.is_blank("in_response_to_tweet_id").alias("is_initial"), T.split_ids("response_tweet_id").alias("response_ids")
    )
    kept = customers.where(T.utf16_length("customer_clean") >= 3)
    return kept.join(replies, "customer_id").select(
        T.pair_id("customer_id", "r.support_id").alias("pair_id"), "customer_id", "author_id", "customer_at", "customer_raw", "customer_clean", "is_initial", "response_ids", F.col("r.support_id").alias("support_id"), T.clean_text("r.support_raw").alias("support_clean"), "n_replies"
    )


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and blank values per column in one pass, as ``(column, n_rows, n_missing, percent)``."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(T.is_blank(F.col(c).cast("string"))).alias(c) for c in columns])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns]))
    return one.select("n", stacked.alias("x")).select("x.column", F.col("n").alias("n_rows"), "x.n_missing", F.round(F.col("x.n_missing") * 100 / F.col("n"), 2).alias("percent"))


def author_groups(tweets: DataFrame) -> DataFrame:
    """Per outbound author: messages, direct replies, replies with several answers."""
    return tweets.where(~T.parse_bool("inbound")).groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~T.is_blank("in_response_to_tweet_id")).alias("n_direct"), F.count_if(F.size(T.split_ids("response_tweet_id")) > 1).alias("n_multi")
    )


def brand_mentions(tweets: DataFrame, brands: list[str]) -> DataFrame:
    """Per brand: inbound messages that name it and how many of them open a talk; one may count for several."""
    low = F.lower(F.coalesce("text", F.lit("")))
    named = F.array_compact(F.array(*[F.when(low.contains("@" + b.lower()), F.lit(b)) for b in brands]))
    rows = inbound(tweets).select(F.explode(named).alias("brand"), T.is_blank("in_response_to_tweet_id").alias("initial"))
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if("initial").alias("n_initial"))


def quarantine(df: DataFrame, held_out: DataFrame, key: str, held_key: str) -> DataFrame:
    """Rows whose trimmed id is not held out."""
    ids = held_out.select(F.trim(held_key).alias("_id")).where("_id <> ''").distinct()
    return df.join(ids, F.trim(df[key]) == F.col("_id"), "left_anti")


def found_ids(df: DataFrame, held_out: DataFrame, key: str, held_key: str) -> DataFrame:
    """Held-out rows whose trimmed id occurs in the table."""
    ids = df.select(F.trim(key).alias("_id")).where("_id <> ''").distinct()
    return held_out.join(ids, F.trim(held_out[held_key]) == F.col("_id"), "left_semi")


def population(df: DataFrame, held_out: DataFrame, key: str, held_key: str) -> DataFrame:
    """Total, excluded and remaining rows, and whether they add up; one pass over the table."""
    ids = held_out.select(F.trim(held_key).alias("_id"), F.lit(True).alias("_held")).where("_id <> ''").distinct()
    one = df.select(F.trim(key).alias("_id")).join(ids, "_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_held").alias("excluded"), F.count_if(F.col("_held").isNull()).alias("remaining"))
    return one.withColumn("adds_up", F.col("total") == F.col("excluded") + F.col("remaining"))


def run_difference(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of two runs that differ: missing on a side or with another value."""
    x, y = a.select(*key, F.col(value).alias("left_value")), b.select(*key, F.col(value).alias("right_value"))
    return x.join(y, key, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def pair_statistics(tweets: DataFrame, brand: str) -> DataFrame:
    """One row: what a pairing run reports of its feed, its pairs and what was dropped."""
    blank = T.is_blank("in_response_to_tweet_id")
    mine = ~T.parse_bool("inbound") & (F.lower(F.trim("author_id")) == brand.lower())
    named = T.parse_bool("inbound") & F.lower(F.coalesce("text", F.lit(""))).contains("@" + brand.lower())
    feed = tweets.agg(
        F.count_if(mine).alias("n_replies"), F.count_if(mine & blank).alias("n_without_parent"), F.countDistinct(F.when(mine & ~blank, F.trim("in_response_to_tweet_id"))).alias("n_answered_ids"), F.count_if(T.parse_bool("inbound")).alias("n_inbound"), F.count_if(named).alias("n_mentions")
    )
    pairs = reply_pairs(tweets, brand)
    made = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_initial").alias("n_initial"), F.count_if(~F.col("is_initial")).alias("n_follow_up"), F.count_if(F.col("n_replies") > 1).alias("n_multi"))
    out = feed.crossJoin(made)
    return out.select("*", (F.col("n_replies") - F.col("n_without_parent") - F.col("n_answered_ids")).alias("n_extra_replies"), F.when(F.col("n_pairs") > 0, F.round(F.col("n_initial") * 100 / F.col("n_pairs"), 2)).alias("initial_percent"), (F.col("n_replies") - F.col("n_pairs")).alias("n_unmatched"), (F.col("n_mentions") - F.col("n_pairs")).alias("n_unmatched_mentions"))


def linkage(tweets: DataFrame) -> DataFrame:
    """One row: inbound and outbound rows, how many answer something, and how many of those parents are there."""
    ids = tweets.select(F.trim("tweet_id").alias("_id"), F.lit(True).alias("_there")).where("_id <> ''").distinct()
    parent = tweets.select(T.parse_bool("inbound").alias("inbound"), F.when(~T.is_blank("in_response_to_tweet_id"), F.trim("in_response_to_tweet_id")).alias("_id"))
    return parent.join(ids, "_id", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("inbound").alias("n_inbound"), F.count_if(~F.col("inbound")).alias("n_outbound"), F.count("_id").alias("n_answers"), F.count("_there").alias("n_linked"), F.countDistinct(F.when(F.col("_there"), F.col("_id"))).alias("n_parents"))


def merge_annotations(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the given columns overwritten where an update has a value; updates of unknown keys are dropped."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    merged = rows.join(new, key, "left")
    return merged.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
