"""Problem 5: rebuilding conversations from message rows.

``conversations`` follows the rows' ids, because the wanted conversations are defined by them; time
gaps cannot give them. ``sessions`` is the method by participants and calibrated inactivity gaps, for
feeds whose links are missing.

Every row points to the row it answers; pointer jumping finds the opening row in a number of rounds
that grows with the logarithm of the longest chain. While jumping, each row collects the key of its
place: the suffix maxima of ``(time, row_id)`` on the way from the opening row. Compared as arrays,
these keys sort the rows by time, but never before the row they answer. Turns are counted without
bringing a conversation into one task: rows are range-partitioned by (conversation, key), counted
locally, and shifted by the counts of the partitions before.

Defined results: rows with a null or blank customer id are no messages; repeated rows count once (the
smallest ``row_id``); if several rows hold the answered reply, all belong together and the smallest
``row_id`` counts as answered; a missing or unreadable time sorts right after the row answered; empty
tables give no conversations; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.times import created_micros
from threadloom.session import Scratch, ship

EARLIEST = -(2**63)


def _blank(c: str):
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within a root's run of one sorted partition."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        root = np.array(batch.column("root").to_pylist(), object)
        new = np.concatenate([[root[0] != last], root[1:] != root[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(root)), 0))
        n = np.arange(len(root)) - start + 1
        if not new[0]:
            head = int(np.argmax(new)) if new.any() else len(root)
            n[:head] += seen
        last, seen = root[-1], int(n[-1])
        yield pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "place"), pa.array(n)], names=[*(c for c in batch.schema.names if c != "place"), "n"])


def numbered(df: DataFrame, root: str, order: list[str], keep: list[str], scratch: Scratch) -> DataFrame:
    """``keep`` and ``place``: the 1-based place of each row of a root in the given order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, root, *order).sortWithinPartitions(root, *order)
    rows = rows.select(F.col(root).alias("root"), *[F.col(c) for c in keep], F.spark_partition_id().alias("pid"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", n long"
    local = scratch.save(rows.mapInArrow(_number, ddl))
    ends = local.groupBy("root", "pid").agg(F.max("n").alias("rows"))
    shift = ends.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("root").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Only conversations that lie in several partitions are shifted.
    shift = shift.where("before > 0").select("root", "pid", "before")
    return local.join(shift, ["root", "pid"], "left").select("root", *keep, (F.col("n") + F.coalesce("before", F.lit(0))).alias("place"))


def message_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per customer message id, with what linking needs."""
    blank = lambda c: F.when(_blank(c), F.lit(None)).otherwise(F.trim(c))
    flag = F.col("isInitialInquiry")
    parts = F.struct(
        F.col(row_id).cast("long").alias("row_id"),
        blank("supportTweetId").alias("sid"),
        blank("customerInResponseToId").alias("irt"),
        F.coalesce(flag | (flag.isNull() & _blank("customerInResponseToId")), F.lit(False)).alias("opens"),
        (_blank("supportTweetId") | _blank("customerTextClean") | _blank("supportTextClean")).alias("bad"),
        F.coalesce(created_micros("customerCreatedAt"), F.lit(EARLIEST)).alias("at"),
    )
    return df.select(blank("customerTweetId").alias("cid"), parts.alias("x")).where("cid is not null").groupBy("cid").agg(F.min("x").alias("x")).select("cid", "x.*")


def conversations(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(root_tweet_id, turn_no, tweet_id, speaker)`` of every whole conversation."""
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "conversations")
    v = scratch.save(message_rows(df, row_id))
    # An answer points to the first holder of the reply; further holders are tied to that one, if anything answers.
    held = v.where("sid is not null").select(F.col("sid").alias("irt"), "cid", F.struct(F.col("row_id").alias("up_row"), F.col("cid").alias("up")).alias("u"))
    first = scratch.save(held.groupBy("irt").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("n")).select("irt", "u.up", "n"))
    edges = scratch.save(v.where("irt is not null").select("cid", "irt", "opens").join(first, "irt").select("cid", "irt", "opens", "up", "n"))
    several = edges.where("n > 1").select("irt", "up").distinct()
    ties = held.select("cid", "irt").join(several, "irt").where("cid <> up").select("cid", "up")
    answered = edges.select("cid", "up")
    own = F.array(F.struct(F.col("at").alias("t"), F.col("row_id").alias("r")))
    root = F.col("opens") | F.col("up").isNull()
    s = v.join(answered, "cid", "left").select("cid", "sid", "opens", "bad", F.when(root, F.col("cid")).otherwise(F.col("up")).alias("ptr"), root.alias("done"), own.alias("key"))
    s = scratch.save(s)
    left = s.where("not done").count()
    while left:
        b = s.select(F.col("cid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), F.col("key").alias("up_key"))
        a = s.where("not done").drop("done").join(b, "ptr")
        a = a.select("cid", "sid", "opens", "bad", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), F.concat(F.filter("up_key", lambda x: x > F.col("key")[0]), "key").alias("key"))
        jumped = scratch.save(s.where("done").unionByName(a))
        scratch.drop(s)
        s, before = jumped, left
        left = s.where("not done").count()
        if left == before:  # what is left runs in circles
            break
    rooted = s.where("done")
    # A link that no pointer follows joins two trees, and neither is whole.
    place = s.select("cid", F.when(F.col("done"), F.col("ptr")).alias("tree"))
    other = edges.where("opens").select("cid", "up").union(ties)
    ends = other.select("cid", "up").join(place, "cid").withColumnRenamed("tree", "t1").join(place.select(F.col("cid").alias("up"), F.col("tree").alias("t2")), "up")
    crossed = ends.where(~F.col("t1").eqNullSafe(F.col("t2")))
    broken = crossed.select(F.col("t1").alias("ptr")).union(crossed.select("t2")).where("ptr is not null").distinct()
    whole = rooted.groupBy("ptr").agg(F.max("bad").alias("bad"), F.max(F.col("opens") & (F.col("cid") == F.col("ptr"))).alias("ok")).where("ok and not bad").select("ptr")
    whole = whole.join(broken, "ptr", "left_anti")
    kept = scratch.save(rooted.join(whole, "ptr", "left_semi").select("ptr", "cid", "sid", "key"))
    rows = numbered(kept, "ptr", ["key"], ["cid", "sid"], scratch)
    said = F.array(F.struct((F.col("place") * 2 - 1).alias("turn_no"), F.col("cid").alias("tweet_id"), F.lit("customer").alias("speaker")), F.struct((F.col("place") * 2).alias("turn_no"), F.col("sid").alias("tweet_id"), F.lit("support").alias("speaker")))
    return rows.select(F.col("root").alias("root_tweet_id"), F.explode(said).alias("m")).select("root_tweet_id", "m.turn_no", "m.tweet_id", "m.speaker")
