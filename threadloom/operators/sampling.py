"""Seeded sampling: quotas per stratum, and a bit-exact sequential generator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF


def seeded_key(key: str, seed: int) -> Column:
    """A pseudo-random sort key that depends on the row's id and the seed only."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def quota_sample(df: DataFrame, stratum: str, flag: str, key: str, quotas: dict[str, int], flag_share: float, seed: int) -> DataFrame:
    """A stratified sample: a share of flagged rows first, other rows up to the quota.

    A stratum with too few flagged rows is filled with others; one with too few others stays short.
    """
    pairs = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    rows = df.withColumn("_q", pairs[F.col(stratum)]).where("_q is not null").withColumn("_f", F.coalesce(F.col(flag), F.lit(False)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_f").orderBy(seeded_key(key, seed), key))).where(F.col("_r") <= max(quotas.values(), default=0))
    want = F.floor(F.col("_q") * flag_share + 0.5).cast("long")
    # Counted up to the largest quota, which is all that a target needs.
    have = rows.where("_f").groupBy(stratum).agg(F.count(F.lit(1)).alias("_h"))
    rows = rows.join(F.broadcast(have), stratum, "left").withColumn("_t", F.least(want, F.coalesce("_h", F.lit(0))))
    return rows.where(F.when(F.col("_f"), F.col("_r") <= F.col("_t")).otherwise(F.col("_r") <= F.col("_q") - F.col("_t"))).drop("_q", "_f", "_r", "_h", "_t")


def uniform_stream(seed: int) -> Iterator[float]:
    """The 32-bit generator known as Mulberry32, as an endless stream in [0, 1)."""
    state = seed & M32
    while True:
        state = (state + 0x6D2B79F5) & M32
        x = ((state ^ state >> 15) * (state | 1)) & M32
        x ^= (x + ((x ^ x >> 7) * (x | 61) & M32)) & M32
        yield ((x ^ x >> 14) & M32) / 2**32


def shuffled(items: list, seed: int) -> list:
    """A seeded shuffle that swaps from the end, drawing once per place."""
    out, draw = list(items), uniform_stream(seed)
    for last in range(len(out) - 1, 0, -1):
        other = int(next(draw) * (last + 1))
        out[last], out[other] = out[other], out[last]
    return out


def exact_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``(key, place)`` of the sequential shuffle of the keys in ascending order.

    The generator's state is sequential, so this runs in one task over the keys alone; use
    ``seeded_key`` wherever a bit-exact order is not required.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = sorted(k for b in batches for k in b[key].tolist())
        out = shuffled(keys, seed)
        yield pd.DataFrame({key: out, "place": range(1, len(out) + 1)})

    return df.select(key).where(F.col(key).isNotNull()).coalesce(1).mapInPandas(run, f"`{key}` {kind}, place long")
