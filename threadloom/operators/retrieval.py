"""Inverted index and BM25 search over whole query sets.

``fit`` tokenises the corpus once into a written table and keeps the index as frames: postings ``(term,
doc_id, tf, dl)``, documents ``(doc_id, dl)`` and terms ``(term, df, idf)``. Postings are partitioned by document.
``search`` answers all queries at once. Query terms, with their weights, are broadcast to the postings while
they are at most ``QUERY_TERMS`` (checked by a count); then a frequent term is no hot key, and a document's
scores add up where its postings lie. More query terms meet the postings by an equi-join on term and slot, so
that a frequent term is spread over ``SLOTS`` tasks. Where queries grow with the corpus, ``bulk.search`` moves less.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import tokens_bm25
from threadloom.session import Scratch

K1, B, MIN_DF = 1.2, 0.75, 2
QUERY_TERMS, SLOTS = 200_000, 32


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame  # one row: n_docs, avg_dl
    tokens: DataFrame | None = None  # the written (doc_id, tokens) of ``fit``; an index read from a folder has none


def token_rows(df: DataFrame, key: str, text: str, tokenize=tokens_bm25) -> DataFrame:
    """``(key, tokens)``."""
    return df.select(F.col(key), tokenize(text).alias("tokens"))


def term_counts(tokens: DataFrame, key: str) -> DataFrame:
    """``(term, key, tf)``."""
    return tokens.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0)))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = MIN_DF) -> Index:
    """Index of a corpus. Lengths count every token, also of terms that ``min_df`` drops."""
    scratch = Scratch(df.sparkSession, "index")
    tokens = scratch.save(token_rows(df, key, text).withColumnRenamed(key, "doc_id"))
    docs = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    stats = scratch.save(docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")))
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    terms = scratch.save(terms.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", bm25_idf(F.col("n_docs"), F.col("df")).alias("idf")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.repartition(n, "doc_id").select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    postings = rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl")
    return Index(postings, docs, terms, stats, tokens)


def scores(index: Index, queries: DataFrame, query_id: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document that shares a term with a query; 4 decimals."""
    q = queries.select(query_id, tokens_bm25(text).alias("t")).select(query_id, F.explode(F.array_distinct("t")).alias("term"))
    q = Scratch(queries.sparkSession, "query").save(q.join(index.terms.where("idf > 0").select("term", "idf"), "term").crossJoin(F.broadcast(index.stats.select("avg_dl"))))
    if q.count() <= QUERY_TERMS:
        hits = index.postings.join(F.broadcast(q), "term")
    else:
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")
        spread = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
        hits = index.postings.select("*", slot).join(spread, ["term", "slot"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hits.groupBy(query_id, "doc_id").agg(F.round(F.sum(part), 4).alias("score"))


def top_k(scored: DataFrame, query_id: str, k: int) -> DataFrame:
    """The ``k`` best documents of each query, ties by document id; ranks start at 1."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, query_id: str, text: str, k: int = 5) -> DataFrame:
    return top_k(scores(index, queries, query_id, text), query_id, k)


def recall_at(hits: DataFrame, n_queries: DataFrame, query_id: str, relevant: Column, ks: list[int]) -> DataFrame:
    """Per ``k``: queries with a relevant hit, relevant and retrieved hits, pooled precision, hits per query."""
    each = hits.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").withColumn("rel", relevant.cast("long"))
    per = each.groupBy("k", query_id).agg(F.sum("rel").alias("rel"), F.count(F.lit(1)).alias("got"))
    out = per.groupBy("k").agg(F.sum((F.col("rel") > 0).cast("long")).alias("n_hit"), F.sum("rel").alias("relevant"), F.sum("got").alias("retrieved"))
    n = F.col("n_queries")
    return out.crossJoin(F.broadcast(n_queries)).select(
        "k", "n_queries", "n_hit", "relevant", "retrieved", F.round(F.col("n_hit") / n, 4).alias("recall"), F.round(F.col("relevant") / F.col("retrieved"), 4).alias("precision"), F.round(F.col("relevant") / n, 4).alias("hits_per_query")
    )
