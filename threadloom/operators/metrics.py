"""Classification and agreement metrics from counted label pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ranking import global_rank


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(truth, predicted, n)`` of the rows where both are known."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_totals(cells: DataFrame) -> DataFrame:
    """The matrix with row, column and grand totals, by one grouping-sets aggregation."""
    return cells.cube("truth", "predicted").agg(F.sum("n").alias("n")).select(F.coalesce("truth", F.lit("(all)")).alias("truth"), F.coalesce("predicted", F.lit("(all)")).alias("predicted"), "n")


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs on either side."""
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("claimed"))
    hit = cells.where("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    all_ = t.join(p, "label", "full_outer").join(hit, "label", "left").na.fill(0, ["support", "claimed", "hit"])
    precision = F.when(F.col("claimed") > 0, F.col("hit") / F.col("claimed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return all_.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit")


def summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted averages."""
    w = F.col("support")
    avg = lambda c: F.round(F.avg(c), 4)
    weighted = lambda c: F.round(F.sum(F.col(c) * w) / F.sum(w), 4)
    return per_class(cells).agg(
        F.sum("support").alias("n"), F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), avg("precision").alias("macro_precision"), avg("recall").alias("macro_recall"), avg("f1").alias("macro_f1"), weighted("f1").alias("weighted_f1")
    )


def class_summary(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row over a given class list: accuracy over all rows, averages over all listed classes.

    Labels outside the list count as rows that are wrong; listed classes that do not occur count as 0.
    """
    pair = df.select(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    known = lambda c: F.when(F.col(c).isin(classes), F.col(c))
    cells = pair.select(known("truth").alias("truth"), known("predicted").alias("predicted")).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    zero, n = F.lit(0).cast("long"), F.col("n")
    side = lambda c, *counts: F.struct(F.col(c).alias("label"), *[x.alias(k) for x, k in zip(counts, ("support", "claimed", "hit"))])
    sides = F.array(side("truth", n, zero, F.when(F.col("truth") == F.col("predicted"), n).otherwise(zero)), side("predicted", zero, n, zero))
    named = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    per = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])
    per = named.join(per, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("claimed")), ratio(F.col("hit"), F.col("support"))
    f1 = ratio(2 * F.col("hit"), F.col("claimed") + F.col("support"))
    sums = per.agg(*[F.round(F.avg(c), 4).alias(n) for c, n in ((p, "macro_precision"), (r, "macro_recall"), (f1, "macro_f1"))], F.sum("hit").alias("hits"))
    total = pair.agg(F.count(F.lit(1)).alias("n"))
    return total.crossJoin(sums).select("n", F.round(F.try_divide("hits", "n"), 4).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1")


def failures(df: DataFrame, key: str, truth: str, predicted: str, per_class: int = 20) -> DataFrame:
    """The first misclassified rows of each true class, by key, and how many it has in all."""
    wrong = df.where(F.col(truth).isNotNull() & ~F.col(truth).eqNullSafe(F.col(predicted))).select(key, F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    n = wrong.groupBy("truth").agg(F.count(F.lit(1)).alias("n_wrong"))
    placed = wrong.withColumn("place", F.row_number().over(Window.partitionBy("truth").orderBy(key))).where(F.col("place") <= per_class)
    return placed.join(n, "truth")


def spread(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, smallest and largest value."""
    return df.agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def kappa(cells: DataFrame) -> DataFrame:
    """Cohen's kappa of two labellings; 1 where chance agreement is certain."""
    n = F.sum("n").over(Window.partitionBy())
    base = cells.withColumn("total", n)
    a = base.groupBy("truth", "total").agg(F.sum("n").alias("na")).withColumnRenamed("truth", "label")
    b = base.groupBy("predicted").agg(F.sum("n").alias("nb")).withColumnRenamed("predicted", "label")
    pe = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb") / (F.col("total") * F.col("total"))), F.lit(0.0)).alias("pe"))
    po = cells.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"), F.sum("n").alias("n_items"))
    k = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return po.crossJoin(pe).select("n_items", F.round("po", 4).alias("observed"), F.round("pe", 4).alias("expected"), F.round(k, 4).alias("kappa"))


def sorted_place_quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """``(q, value)``: the value at place ``floor(n * q)`` of the sorted values, places from 0."""
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(value), [value])
    total = df.agg(F.count(value).alias("total"))
    places = total.select(F.explode(F.array(*map(F.lit, qs))).alias("q"), "total").where("total > 0").select("q", (F.least(F.floor(F.col("q") * F.col("total")), F.col("total") - 1) + 1).alias("rank"))
    return ranked.join(F.broadcast(places), "rank").select("q", F.col(value).alias("value"))
