"""Problem 7: the same or nearly the same records across splits.

Method: the records of both splits are hashed after case, punctuation and white space normalisation
(the keys of ``copies``); evaluation hashes are joined with training hashes and the matches counted by
split and source. Ids are joined trimmed. Near matches use the signatures of ``near`` between the two
sides: training signatures that no evaluation record has are dropped by a bitmap of fixed size before
the shuffle.

Defined results: null or blank ids and texts without letter or digit match nothing; a pair that
matches in several ways is one row; repeated rows give one row per pair; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import arrays as A
from threadloom.llm import near as N
from threadloom.llm.copies import _keys, _verify
from threadloom.llm.groups import salt, salts_for
from threadloom.session import Scratch, ship

U = np.uint64


def _matching_rows(wanted):
    """Training rows one of whose content keys may be an evaluation record's, with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            numbered = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["row_id", "text"])
            for keys in _keys(iter([numbered])):
                hit = np.zeros(keys.num_rows, bool)
                for c in ("k", "free"):
                    b = N._bit(keys.column(c).fill_null(0).to_numpy(zero_copy_only=False).view(U))
                    hit |= ((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0) & keys.column(c).is_valid().to_numpy(zero_copy_only=False)
                some = keys.filter(pa.array(hit))
                at = some.column("row_id")
                yield pa.record_batch([batch.column("row_id").take(at), some.column("k"), some.column("free"), batch.column("text").take(at)], names=["row_id", "k", "free", "text"])

    return run


def overlaps(evals: DataFrame, train: DataFrame, eval_key: str, eval_id: str, train_id: str, text: str, row_id: str = "row_id", t: float = N.THRESHOLD) -> DataFrame:
    """``(eval key, row_id)`` of every overlap between evaluation and training records."""
    spark = evals.sparkSession
    ship(spark)
    scratch = Scratch(spark, "splits")
    # Evaluation records get numbers of their own, told from training rows by the lowest bit.
    e = scratch.save(
        evals.select(F.col(eval_key).alias("key"), F.trim(F.col(eval_id)).alias("id"), F.col(text).cast("string").alias("text"))
        .where("key is not null")
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    tr = train.select(F.col(row_id).cast("long").alias("row_id"), F.trim(F.col(train_id)).alias("id"), F.col(text).cast("string").alias("text"))
    by_id = e.where("id <> ''").select("key", "id").distinct().join(tr.select("id", "row_id"), "id").select("key", "row_id")

    # The same content.
    ek = scratch.save(e.select("row_id", "text").mapInArrow(_keys, "row_id long, k long, free long").withColumnRenamed("row_id", "e_id"))
    e_keys = ek.select(F.col("k").alias("key64")).union(ek.where("free is not null").select("free"))
    bits = spark.sparkContext.broadcast(N.bitmap_of(spark, e_keys.select(F.col("key64").alias("sig"))))
    rows = scratch.save(tr.select("row_id", "text").mapInArrow(_matching_rows(bits), "row_id long, k long, free long, text string"))
    keyed = lambda x, i: x.select(i, F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("w"), F.col("k").alias("key64")), F.struct(F.lit(1).alias("w"), F.col("free").alias("key64"))))).alias("s")).where("s.key64 is not null").select(i, "s.w", "s.key64")
    met = keyed(ek, "e_id").join(keyed(rows, "row_id"), ["w", "key64"]).select("e_id", "row_id").distinct()
    same = (
        met.join(e.select(F.col("row_id").alias("e_id"), "key", F.col("text").alias("first_text")), "e_id")
        .join(rows.select("row_id", "text"), "row_id")
        .select("row_id", F.col("e_id").alias("first_id"), "text", "first_text")
        .mapInArrow(_verify, "row_id long, first_id long, ok boolean")
        .where("ok")
        .join(e.select(F.col("row_id").alias("first_id"), "key"), "first_id")
        .select("key", "row_id")
    )

    # Nearly the same: node = 2 * id + side; both sides are collapsed by word set first.
    both = e.select((F.col("row_id") * 2 + 1).alias("node"), "text").where("text is not null").union(tr.select((F.col("row_id") * 2).alias("node"), "text").where("text is not null"))
    sets = scratch.save(both.mapInArrow(N._set_keys(1), "node long, k1 long, k2 long"))
    sets = sets.withColumn("salt", salt("node", salts_for(sets)))
    side = F.pmod("node", F.lit(2))
    local = sets.groupBy("k1", "k2", side.alias("side"), "salt").agg(F.min("node").alias("m"))
    first = local.groupBy("k1", "k2", "side").agg(F.min("m").alias("first"), F.collect_list("salt").alias("salts"))
    found = scratch.save(first.select("k1", "k2", "side", F.explode("salts").alias("salt"), "first"))
    later = found.join(sets, ["k1", "k2", "salt"]).where((side == F.col("side")) & (F.col("node") != F.col("first"))).select("node").distinct()
    reps = scratch.save(N.texts_without_nodes(both, later))
    counts = spark.sparkContext.broadcast(N.word_counts(reps, 1))
    n_sets = reps.count()
    e_signed = scratch.save(reps.where(side == 1).mapInArrow(N._sign(counts, n_sets, 1, t, 1), N.SIGN_DDL))
    wanted = spark.sparkContext.broadcast(N.bitmap_of(spark, e_signed))
    t_signed = reps.where(side == 0).mapInArrow(N._sign(counts, n_sets, 1, t, 0, wanted), N.SIGN_DDL)
    links = N.verify(N.candidates(e_signed.union(t_signed), t, scratch), reps, scratch, t)
    is_eval = F.pmod("a", F.lit(2)) == 1
    links = links.select(F.when(is_eval, F.col("a")).otherwise(F.col("b")).alias("e"), F.when(is_eval, F.col("b")).otherwise(F.col("a")).alias("r"))
    # Links between first rows are opened to their copies, slot by slot.
    copies = found.join(sets, ["k1", "k2", "salt"]).where(side == F.col("side")).select("first", "node")
    near = (
        links.join(copies.select(F.col("first").alias("e"), F.col("node").alias("e_node")), "e")
        .join(copies.select(F.col("first").alias("r"), F.col("node").alias("r_node")), "r")
        .select(F.expr("(e_node - 1) div 2").alias("e_id"), F.expr("r_node div 2").alias("row_id"))
        .join(e.select(F.col("row_id").alias("e_id"), "key"), "e_id")
        .select("key", "row_id")
    )
    return by_id.union(same).union(near).distinct().select(F.col("key").alias(eval_key), F.col("row_id").alias(row_id))


def overlap_counts(found: DataFrame, evals: DataFrame, eval_key: str, split: str, source: str) -> DataFrame:
    """Per split and source: evaluation records, those that overlap, and the overlapping pairs."""
    per = found.groupBy(eval_key).agg(F.count(F.lit(1)).alias("n"))
    return (
        evals.select(eval_key, split, source)
        .distinct()
        .join(per, eval_key, "left")
        .groupBy(split, source)
        .agg(F.count(F.lit(1)).alias("n_records"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )
