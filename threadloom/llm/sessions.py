"""Problem 5, for feeds without reliable links: sessions by participants and inactivity gaps.

Method: messages are sorted by participants and time, split where nothing was said for longer than a
gap calibrated on the feed, given speaker roles, and kept if both sides speak and the customer begins.

The gap is a quantile of the times between neighbouring messages of the same participants, kept within
``BOUNDS``. No participant's messages are gathered in one task: rows are range-partitioned and sorted,
each partition finds the starts inside it, and one row per partition carries the open session on.

Defined results: repeated ids count once; messages without an id, a readable time or a customer are
dropped; equal times are ordered by id; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import parse_bool
from threadloom.functions.times import created_micros
from threadloom.llm.conversations import numbered
from threadloom.session import Scratch, ship

QUANTILE = 0.9
BOUNDS = (5 * 60, 24 * 3600)  # seconds


def messages(feed: DataFrame) -> DataFrame:
    """``(id, who, at, speaker)``; ``who`` names the customer and the brand."""
    text = F.coalesce("text", F.lit(""))
    inbound = parse_bool("inbound")
    author = F.trim("author_id")
    customer = F.when(inbound, author).otherwise(F.nullif(F.regexp_extract(text, r"@(\d+)", 1), F.lit("")))
    brand = F.lower(F.when(inbound, F.regexp_extract(text, r"@(\w*[A-Za-z]\w*)", 1)).otherwise(author))
    rows = feed.select(F.trim("tweet_id").alias("id"), F.concat_ws("|", customer, brand).alias("who"), customer.alias("c"), created_micros("created_at").alias("at"), F.when(inbound, "customer").otherwise("support").alias("speaker"))
    rows = rows.where("id <> '' and c is not null and c <> '' and at is not null")
    return rows.groupBy("id").agg(F.min(F.struct("at", "who", "speaker")).alias("m")).select("id", "m.*")


def _starts(gap: int):
    """The start of each row's session where it lies in this partition, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, at, start, first = None, None, None, True
        for batch in batches:
            out = []
            for w, a, i in zip(*(batch.column(c).to_pylist() for c in ("who", "at", "id"))):
                if not first and (w != who or a - at > gap):
                    start = i
                out.append(start)
                who, at, first = w, a, False
            yield batch.append_column("start", pa.array(out, pa.string()))

    return run


def calibrated_gap(rows: DataFrame, quantile: float = QUANTILE) -> int:
    """Microseconds: the quantile of the times between neighbouring messages of the same participants."""
    placed = rows.select("who", "place", "at")
    nxt = placed.select("who", (F.col("place") - 1).alias("place"), F.col("at").alias("next_at"))
    got = placed.join(nxt, ["who", "place"]).agg(F.percentile_approx(F.col("next_at") - F.col("at"), quantile, 10_000)).first()[0]
    return int(min(max(got or 0, BOUNDS[0] * 1_000_000), BOUNDS[1] * 1_000_000))


def pair_messages(pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(id, who, at, speaker)`` of the customer message and the reply of each pair row."""
    who = F.concat_ws("|", F.trim("customerAuthorId"), F.lower(F.trim("supportAuthorId")))
    side = lambda c, t, s: F.struct(F.trim(c).alias("id"), created_micros(t).alias("at"), F.lit(s).alias("speaker"))
    rows = pairs.select(who.alias("who"), F.explode(F.array(side("customerTweetId", "customerCreatedAt", "customer"), side("supportTweetId", "supportCreatedAt", "support"))).alias("m"))
    rows = rows.select("m.id", "who", "m.at", "m.speaker").where("id <> '' and at is not null and who <> ''")
    return rows.groupBy("id").agg(F.min(F.struct("at", "who", "speaker")).alias("m")).select("id", "m.*")


def sessions_by_gap(feed: DataFrame, gap: int | None = None) -> DataFrame:
    """``(session_id, turn_no, tweet_id, speaker)`` of a raw feed; ``gap`` in microseconds overrides calibration."""
    return sessions_of(messages(feed), gap)


def sessions_of(said: DataFrame, gap: int | None = None) -> DataFrame:
    """The sessions of messages ``(id, who, at, speaker)``."""
    spark = said.sparkSession
    ship(spark)
    scratch = Scratch(spark, "sessions")
    rows = scratch.save(said)
    if gap is None:
        gap = calibrated_gap(numbered(rows, "who", ["at", "id"], ["at", "id"], scratch).withColumnRenamed("root", "who"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "who", "at", "id").sortWithinPartitions("who", "at", "id").select("who", "at", "id", "speaker", F.spark_partition_id().alias("pid"))
    local = scratch.save(ordered.mapInArrow(_starts(gap), "who string, at long, id string, speaker string, pid int, start string"))
    # One row per partition: where it begins and what it leaves open.
    ends = local.groupBy("pid").agg(F.min(F.struct("who", "at", "id")).alias("a"), F.max(F.struct("who", "at", "id", "start")).alias("z")).orderBy("pid").collect()
    lead, who, at, start = [], None, None, None
    for r in ends:
        mine = start if (r.a.who == who and r.a.at - at <= gap) else r.a.id
        lead.append((r.pid, mine))
        who, at, start = r.z.who, r.z.at, r.z.start or mine
    leads = spark.createDataFrame(lead, "pid int, lead string")
    said = local.join(F.broadcast(leads), "pid").select("id", "at", "speaker", F.coalesce("start", "lead").alias("session"))
    said = scratch.save(said)
    kept = said.groupBy("session").agg(F.min(F.struct("at", "id", "speaker")).alias("f"), F.countDistinct("speaker").alias("sides")).where("sides = 2 and f.speaker = 'customer'").select("session")
    placed = numbered(said.join(kept, "session", "left_semi"), "session", ["at", "id"], ["id", "speaker"], scratch)
    return placed.select(F.col("root").alias("session_id"), F.col("place").alias("turn_no"), F.col("id").alias("tweet_id"), "speaker")
