"""Orders over whole tables and per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based places over the whole table without a single-task window.

    Rows are range-partitioned and sorted; a place is the row's index in its partition plus the sizes
    of the partitions before, a table of one row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    size = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_at", "_p", "_i", "_before")


def first_n_per_key(df: DataFrame, key: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each key with their places; planned with a limit per group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def dedupe_first(df: DataFrame, steps: list[list[str]], order: list[str]) -> DataFrame:
    """Keep each step's first row per key, one step after the other, in the given order.

    Each step is a combining aggregate (``min_by``), so copies shrink before the shuffle.
    """
    out = df
    for key in steps:
        cols = [c for c in out.columns]
        row = F.struct(*[F.col(c) for c in cols])
        out = out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    return out


def shares(df: DataFrame, label: str) -> DataFrame:
    """Count and share of each label."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def monotone(df: DataFrame, key: str, rank: str, score: str) -> DataFrame:
    """Per key whether scores never rise with the rank."""
    prev = F.lag(score).over(Window.partitionBy(key).orderBy(rank))
    return df.withColumn("_up", (F.col(score) > prev).cast("int")).groupBy(key).agg((F.coalesce(F.max("_up"), F.lit(0)) == 0).alias("ordered"))
