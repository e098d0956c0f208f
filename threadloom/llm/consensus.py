"""Problem 3: consensus from several annotators' labels.

Method: minimax conditional entropy. A vote ``k`` of annotator ``a`` on item ``i`` of class ``c`` has
probability ``exp(sigma[a, c, k] + tau[i, c, k]) / Z``. The annotators' tilts ``sigma`` and the items'
tilts ``tau`` are fitted by regularised dual coordinate ascent, in blocks (items, then annotators),
alternating with the posteriors of the items' classes. ``sigma`` is regularised towards a one-coin
model of the annotator's overall accuracy, so that rare cells of a confusion matrix stay moderate.

Nothing is held by the driver. Items lie in blocks whose number follows from the counted votes; the tilts
are a table by annotator. In a round every block meets the tilts of its own annotators in one shuffle,
solves its items and adds up its annotators' sums, and a second shuffle, by annotator, turns the sums into
new tilts. An annotator of any number of votes sends one row of sums per task, and there may be as many
annotators as votes. Agreement is counted separately from the fit.

Defined results: labels are read whatever their case, spacing and separators, anything else is no
vote; of an annotator's votes on an item the latest holds (a vote without a time is the earliest, ties
go to the larger vote id); null items or annotators are ignored; items with fewer than ``MIN_VOTES``
annotators get no consensus; ties between classes go to the first class in the list; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch, ship

# The project's ten intents.
INTENTS = [
    "account_icloud",
    "apps_appstore",
    "audio_media",
    "battery_power",
    "billing_subscriptions",
    "connectivity_network",
    "display_hardware",
    "keyboard_typing",
    "other_unclear",
    "software_update",
]
MIN_VOTES = 3
ADJUDICATED = 3.0  # log-odds that an adjudicated label adds to its class
BETA = 2.0  # regularisation of the annotators' tilts
ALPHA = 8.0  # regularisation of the items' tilts
COIN_ROUNDS, ROUNDS, LOCAL = 5, 10, 4
BLOCK = 8_192  # votes of a block
AT_ONCE = 4_096  # votes whose class tables are in memory at a time
HELD = 20_000  # annotators whose sums a task holds before it sends them on


def label_of(c: str | Column) -> Column:
    """The intent a label spells, or null."""
    x = F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"[\s_\-./]+", "_")
    x = F.regexp_replace(x, r"^_+|_+$", "")
    return F.when(x.isin(INTENTS), x)


def valid_votes(agreement: DataFrame, votes: DataFrame) -> DataFrame:
    """``(item, annotator, label)``: each annotator's latest valid label of each item."""
    sides = F.array(F.struct(F.col("annotator_a_id").alias("annotator"), F.col("annotatorA").alias("label")), F.struct(F.col("annotator_b_id").alias("annotator"), F.col("annotatorB").alias("label")))
    first = agreement.select(F.trim("goldenId").alias("item"), F.explode(sides).alias("s")).select("item", F.trim("s.annotator").alias("annotator"), label_of("s.label").alias("label"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("id"))
    later = votes.select(F.trim("golden_id").alias("item"), F.trim("annotator_id").alias("annotator"), label_of("vote_label").alias("label"), F.col("voted_at").alias("at"), F.col("vote_id").cast("long").alias("id"))
    both = first.union(later).where("item is not null and annotator is not null and annotator <> '' and label is not null")
    return both.groupBy("item", "annotator").agg(F.max(F.struct("at", "id", "label")).alias("v")).select("item", "annotator", F.col("v.label").alias("label"))


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def solve_items(item: np.ndarray, ann: np.ndarray, lab: np.ndarray, prior: np.ndarray, sigma: np.ndarray, alpha: float | None, local: int = LOCAL) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, item tilts) given the annotators' tilts; without ``alpha`` items have no tilts."""
    n, k = prior.shape
    tau = np.zeros((n, k, k))
    steps = 1 if alpha is None else local
    for step in range(steps):
        like = np.zeros((n, k))
        for v in _pieces(len(item)):
            p = _softmax(sigma[ann[v]] + tau[item[v]], 2)
            np.add.at(like, item[v], np.log(np.take_along_axis(p, lab[v][:, None, None], 2)[:, :, 0] + 1e-300))
        q = _softmax(like + prior, 1)
        if step == steps - 1:
            break
        grad, curve = -alpha * tau, np.full_like(tau, alpha)
        for v in _pieces(len(item)):
            p = _softmax(sigma[ann[v]] + tau[item[v]], 2)
            weight = q[item[v]][:, :, None]
            np.add.at(grad, item[v], weight * (np.eye(k)[lab[v]][:, None, :] - p))
            np.add.at(curve, item[v], weight * p * (1 - p))
        tau += grad / curve
    return q, tau


def _pieces(n: int) -> Iterator[slice]:
    return (slice(i, min(i + AT_ONCE, n)) for i in range(0, n, AT_ONCE))


def _block(key: tuple, part: pa.Table) -> pa.Table:
    """One row of a block's votes: items, annotators and labels as places in lists."""
    part = part.sort_by([("item", "ascending"), ("annotator", "ascending")])
    item, ann = (part.column(c).combine_chunks().dictionary_encode() for c in ("item", "annotator"))
    adj = np.full(len(item.dictionary), -1, np.int32)
    adj[item.indices.to_numpy()] = part.column("adjudicated").to_numpy()
    row = [[key[0].as_py()], [item.dictionary.to_pylist()], [ann.dictionary.to_pylist()], [adj], [item.indices.to_numpy()], [ann.indices.to_numpy()], [part.column("lab").to_numpy()]]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 4]
    return pa.table([pa.array(x, t) for x, t in zip(row, kinds)], names=["block", "items", "anns", "adj", "v_item", "v_ann", "v_lab"])


BLOCK_DDL = "block int, items array<string>, anns array<string>, adj array<int>, v_item array<int>, v_ann array<int>, v_lab array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The blocks of rows sorted by block, the tilts of each before its votes: (items, anns, item, ann, lab, prior, sigma)."""
    k = len(INTENTS)
    tilts: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        tilt = batch.column("tilt")
        at, flat = tilt.offsets.to_numpy(), tilt.values.to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if slot[i] >= 0:
                tilts[int(slot[i])] = flat[at[i] : at[i + 1]].reshape(k, k)
                continue
            adj, item, ann, lab = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("adj", "v_item", "v_ann", "v_lab"))
            prior = np.zeros((len(adj), k))
            has = np.flatnonzero(adj >= 0)
            prior[has, adj[has]] = ADJUDICATED
            yield batch.column("items")[i].values, batch.column("anns")[i].values, item, ann, lab, prior, np.stack([tilts[a] for a in range(len(tilts))])
            tilts = {}


def _sums(alpha: float | None):
    """Per task and annotator: hits and misfits by class and label, and the classes' weights, in one list."""
    k = len(INTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array([1] * len(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["annotator", "kind", "cells"])

        for _, anns, item, ann, lab, prior, sigma in _blocks(batches):
            q, tau = solve_items(item, ann, lab, prior, sigma, alpha)
            hits, misfit, size = np.zeros((len(anns), k, k)), np.zeros((len(anns), k, k)), np.zeros((len(anns), k))
            for v in _pieces(len(item)):
                w = q[item[v]]
                x = w[:, :, None] * np.eye(k)[lab[v]][:, None, :]
                np.add.at(hits, ann[v], x)
                np.add.at(misfit, ann[v], x - w[:, :, None] * _softmax(sigma[ann[v]] + tau[item[v]], 2))
                np.add.at(size, ann[v], w)
            cells = np.concatenate([hits.reshape(-1, k * k), misfit.reshape(-1, k * k), size], axis=1)
            for a, c in zip(anns.to_pylist(), cells):
                held[a] = held[a] + c if a in held else c
            if len(held) > HELD:
                yield send()
                held = {}
        if held:
            yield send()

    return run


def coin(acc: float) -> np.ndarray:
    """Tilts of an annotator who hits with a probability and errs evenly."""
    k = len(INTENTS)
    s = np.full((k, k), np.log((1 - acc) / (k - 1)))
    np.fill_diagonal(s, np.log(acc))
    return s


def _update(coins: bool):
    """New tilts of annotators whose old tilts (kind 0) and sums (kind 1) lie side by side."""
    k = len(INTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, old, total = None, None, None
        done: list[tuple] = []

        def close() -> None:
            hits, misfit, size = total[: k * k].reshape(k, k), total[k * k : 2 * k * k].reshape(k, k), total[2 * k * k :]
            right, n = float(np.trace(hits)), float(size.sum())
            centre = coin(float(np.clip((right + 3.5) / (n + 5), 0.05, 0.995)))
            new = centre if coins else old + (misfit - BETA * (old - centre)) / (0.25 * size[:, None] + BETA)
            done.append((name, new.ravel(), right, n))

        def send() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64()))], names=["annotator", "tilt", "n_right", "n_votes"])

        for batch in batches:
            cells = batch.column("cells")
            at, flat = cells.offsets.to_numpy(), cells.values.to_numpy(zero_copy_only=False)
            for i, (a, kind) in enumerate(zip(batch.column("annotator").to_pylist(), batch.column("kind").to_pylist())):
                if a != name:
                    if name is not None:
                        close()
                    name, total = a, np.zeros(2 * k * k + k)
                if kind == 0:
                    old = flat[at[i] : at[i + 1]].reshape(k, k)
                else:
                    total = total + flat[at[i] : at[i + 1]]
            if len(done) > 1000:
                yield send()
                done.clear()
        if name is not None:
            close()
        if done:
            yield send()

    return run


def _posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for items, _, item, ann, lab, prior, sigma in _blocks(batches):
        q, _ = solve_items(item, ann, lab, prior, sigma, ALPHA)
        best = np.argmax(np.round(q, 9), axis=1)
        votes = np.zeros(prior.shape)
        np.add.at(votes, (item, lab), 1)
        n = votes.sum(1)
        agree = np.where(n > 1, (votes * (votes - 1)).sum(1) / np.maximum(n * (n - 1), 1), 1.0)
        yield pa.record_batch(
            [items, pa.array([INTENTS[b] for b in best], pa.string()), pa.array(np.round(q[np.arange(len(q)), best], 6)), pa.array(n.astype(np.int64)), pa.array(np.round(agree, 6))],
            names=["golden_id", "label", "confidence", "n_annotators", "agreement"],
        )


class Consensus:
    """A fit: ``items`` (one row per item) and ``annotators`` (one row per annotator)."""

    def __init__(self, items: DataFrame, annotators: DataFrame):
        self.items, self.annotators = items, annotators


def fit(agreement: DataFrame, votes: DataFrame) -> Consensus:
    spark = agreement.sparkSession
    ship(spark)
    scratch = Scratch(spark, "consensus")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid = scratch.save(valid_votes(agreement, votes))
    n_blocks = max(4 * tasks, -(-valid.count() // BLOCK))
    lab = F.array_position(F.array(*map(F.lit, INTENTS)), F.col("label")).cast("int") - 1
    adjudicated = agreement.select(F.trim("goldenId").alias("item"), label_of("adjudicatedLabel").alias("l")).where("l is not null").groupBy("item").agg(F.min("l").alias("label")).select("item", lab.alias("adjudicated"))
    rows = valid.join(adjudicated, "item", "left").select(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block"), "item", "annotator", lab.alias("lab"), F.coalesce("adjudicated", F.lit(-1)).alias("adjudicated"))
    blocks = scratch.save(rows.groupBy("block").applyInArrow(_block, BLOCK_DDL))
    needed = blocks.select("block", F.posexplode("anns").alias("slot", "annotator"))
    parts = blocks.withColumn("slot", F.lit(-1)).withColumn("tilt", F.lit(None).cast("array<double>"))

    def meeting(tilts: DataFrame) -> DataFrame:
        theirs = needed.join(tilts.select("annotator", "tilt"), "annotator").select("block", "slot", "tilt")
        return parts.unionByName(theirs, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", F.desc("slot"))

    tilts = needed.select("annotator").distinct().select("annotator", F.array(*map(F.lit, coin(0.7).ravel().tolist())).alias("tilt"), F.lit(0.0).alias("n_right"), F.lit(0.0).alias("n_votes"))
    tilts = scratch.save(tilts)
    for step in range(COIN_ROUNDS + ROUNDS):
        sums = meeting(tilts).mapInArrow(_sums(None if step < COIN_ROUNDS else ALPHA), "annotator string, kind int, cells array<double>")
        old = tilts.select("annotator", F.lit(0).alias("kind"), F.col("tilt").alias("cells"))
        new = old.union(sums).repartition(tasks, "annotator").sortWithinPartitions("annotator", "kind").mapInArrow(_update(step < COIN_ROUNDS), "annotator string, tilt array<double>, n_right double, n_votes double")
        tilts, before = scratch.save(new), tilts
        scratch.drop(before)
    out = meeting(tilts).mapInArrow(_posteriors, "golden_id string, label string, confidence double, n_annotators long, agreement double").where(F.col("n_annotators") >= MIN_VOTES)
    reliability = tilts.select(F.col("annotator").alias("annotator_id"), F.round((F.col("n_right") + 3.5) / (F.col("n_votes") + 5), 6).alias("reliability"), F.round("n_votes").cast("long").alias("n_votes"))
    return Consensus(out, reliability)


def item_agreement(agreement: DataFrame, votes: DataFrame) -> DataFrame:
    """``(golden_id, n_annotators, n_agreeing, n_pairs)``: pairs of an item's votes and those that agree; no fit is needed."""
    per = valid_votes(agreement, votes).groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(F.col("item").alias("golden_id")).agg(F.sum("n").alias("n_annotators"), F.sum(F.expr("n * (n - 1) div 2")).alias("n_agreeing"))
    return per.where(F.col("n_annotators") >= MIN_VOTES).withColumn("n_pairs", F.expr("n_annotators * (n_annotators - 1) div 2"))


def agreement_summary(per_item: DataFrame) -> DataFrame:
    """Observed agreement over all pairs of votes of one item, and the items without disagreement."""
    return per_item.agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("n_agreeing") / F.sum("n_pairs"), 4).alias("pairwise_agreement"), F.count_if(F.col("n_agreeing") == F.col("n_pairs")).alias("n_unanimous"))
