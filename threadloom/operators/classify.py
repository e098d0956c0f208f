"""TF-IDF vectors, multinomial naive Bayes and the majority baseline as aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import bigrams, unigrams_tfidf
from threadloom.session import Scratch

MIN_DF, MAX_SHARE, ALPHA = 3, 0.85, 0.5


@dataclass
class Terms:
    """A corpus tokenised once: ``(key, label)`` per text, the written ``(key, term, tf)`` and, once a model is
    fitted on it, its written vectors and the vocabulary they are of."""

    docs: DataFrame
    counts: DataFrame
    weights: DataFrame | None = None
    vocab: DataFrame | None = None


def term_table(df: DataFrame, key: str, text: str, label: str | None = None) -> Terms:
    """Texts tokenised once into unigrams and bigrams; everything else is derived from the written table.

    The unigrams are a column of their own, so that their chain of patterns stands in the plan once.
    """
    scratch = Scratch(df.sparkSession, "terms")
    name = F.col(label) if label else F.lit(None).cast("string")
    words = df.select(F.col(key).alias("key"), name.alias("label"), unigrams_tfidf(text).alias("u"))
    tokens = words.select("key", F.explode(F.concat("u", bigrams("u"))).alias("term"))
    counts = scratch.save(tokens.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))
    return Terms(df.select(F.col(key).alias("key"), name.alias("label")), counts)


def vocabulary(terms: Terms, min_df: int = MIN_DF, max_share: float = MAX_SHARE) -> DataFrame:
    """``(term, df, idf)`` of the terms neither too rare nor too common (``min_df`` is 1 up to 10 texts)."""
    n = terms.docs.agg(F.count(F.lit(1)).alias("n"))
    df = terms.counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    low = F.when(F.col("n") <= 10, 1).otherwise(min_df)
    return df.crossJoin(F.broadcast(n)).where((F.col("df") >= low) & (F.col("df") <= F.floor(F.col("n") * max_share))).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(terms: Terms, vocab: DataFrame) -> DataFrame:
    """``(key, term, w)``: sublinear term frequency times idf, scaled to length 1 per text."""
    raw = terms.counts.join(vocab.select("term", "idf"), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return raw.select("key", "term", (F.col("w") / norm).alias("w"))


@dataclass
class NaiveBayes:
    vocab: DataFrame
    cells: DataFrame  # (label, term, logp) of the seen cells
    classes: DataFrame  # (label, prior, default_logp)


def fit_bayes(df: DataFrame | Terms, key: str = "key", text: str = "text", label: str | None = None, alpha: float = ALPHA, uniform: bool = True) -> NaiveBayes:
    """Fit on weighted term sums; texts without a label count for the vocabulary only.

    The model is written to the shared folder, so predictions never fit it again.
    """
    terms = df if isinstance(df, Terms) else term_table(df, key, text, label)
    scratch = Scratch(terms.docs.sparkSession, "bayes")
    vocab = scratch.save(vocabulary(terms))
    named = terms.docs.where("label is not null")
    terms.weights, terms.vocab = scratch.save(vectors(terms, vocab)), vocab
    sums = scratch.save(terms.weights.join(named, "key").groupBy("label", "term").agg(F.sum("w").alias("s")))
    totals = sums.groupBy("label").agg(F.sum("s").alias("t"))
    v = vocab.agg(F.count(F.lit(1)).alias("v"))
    n = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.join(totals, "label", "left").crossJoin(F.broadcast(v)).crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))))
    mass = F.coalesce("t", F.lit(0.0)) + alpha * F.col("v")
    prior = -F.log(F.col("k").cast("double")) if uniform else F.log(F.col("n") / F.col("all"))
    classes = scratch.save(sizes.select("label", prior.alias("prior"), mass.alias("mass"), F.log(F.lit(alpha) / mass).alias("default_logp")))
    cells = sums.join(classes.select("label", "mass"), "label").select("label", "term", F.log((F.col("s") + alpha) / F.col("mass")).alias("logp"))
    return NaiveBayes(vocab, cells, classes)


def predict_bayes(model: NaiveBayes, df: DataFrame | Terms, key: str, text: str = "text", fallback: str = "") -> DataFrame:
    """``(key, predicted, confidence, oov)``; a text without known terms gets the fallback at 0.5."""
    terms = df if isinstance(df, Terms) else term_table(df, key, text)
    x = terms.weights if terms.vocab is model.vocab else vectors(terms, model.vocab)
    # Each seen cell adds its difference from the class default; the defaults add by the text's weight. A text's
    # gains stay one row with a small map by class: texts are never multiplied by classes.
    gains = model.cells.join(model.classes.select("label", "default_logp"), "label")
    per_term = gains.groupBy("term").agg(F.collect_list(F.struct("label", (F.col("logp") - F.col("default_logp")).alias("d"))).alias("g"))
    each = x.join(per_term, "term", "left").select("key", "w", F.explode_outer("g").alias("g"))
    gain = each.groupBy("key", F.col("g.label").alias("label")).agg(F.sum(F.col("w") * F.col("g.d")).alias("gain"))
    base = x.groupBy("key").agg(F.sum("w").alias("total"))
    every = base.crossJoin(F.broadcast(model.classes)).join(gain.where("label is not null"), ["key", "label"], "left")
    score = F.col("prior") + F.col("total") * F.col("default_logp") + F.coalesce("gain", F.lit(0.0))
    best = every.groupBy("key").agg(F.collect_list(F.struct(score.alias("score"), "label")).alias("c"))
    top = F.array_max(F.transform("c", lambda c: c["score"]))
    best = best.select("key", "c", top.alias("top")).select("key", F.array_min(F.transform(F.filter("c", lambda c: c["score"] == F.col("top")), lambda c: c["label"])).alias("label"), (1 / F.aggregate("c", F.lit(0.0), lambda a, c: a + F.exp(c["score"] - F.col("top")))).alias("p"))
    out = terms.docs.select("key").join(best, "key", "left")
    return out.select(F.col("key").alias(key), F.coalesce("label", F.lit(fallback)).alias("predicted"), F.coalesce(F.round("p", 4), F.lit(0.5)).alias("confidence"), F.col("label").isNull().alias("oov"))


def majority(df: DataFrame, label: str, order: str) -> DataFrame:
    """One row: the commonest label (ties: the one seen first), its count and share."""
    per = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    total = F.sum("n").over(Window.partitionBy())
    best = F.row_number().over(Window.orderBy(F.desc("n"), "seen"))
    return per.select("label", "n", F.round(F.col("n") / total, 4).alias("share"), best.alias("r")).where("r = 1").drop("r")


def predict_majority(model: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Every row with the majority label and its share as confidence."""
    return df.select(key).crossJoin(F.broadcast(model.select(F.col("label").alias("predicted"), F.col("share").alias("confidence"))))


def evaluation_label(human: str, annotator: str, proposed: str) -> tuple[Column, Column]:
    """The human label where a person gave one, else the proposal, and where it comes from."""
    given = F.col(human).isNotNull() & F.col(annotator).isNotNull()
    return F.when(given, F.col(human)).otherwise(F.col(proposed)), F.when(given, F.concat(F.lit("human_author ("), annotator, F.lit(")"))).otherwise("automatic_proposal")


def class_cap(df: DataFrame, label: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows per class in a seeded pseudo-random order (a sampling operator)."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
