"""Readers and writers of the file formats in use, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TWEETS = "tweet_id STRING, author_id STRING, inbound STRING, created_at STRING, text STRING, response_tweet_id STRING, in_response_to_tweet_id STRING"


def read_csv(spark: SparkSession, path: str, schema: str = TWEETS) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped, gzip is read as it is."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", "gzip" if gzip else "none").json(path)


def read_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def first_existing(spark: SparkSession, path: str) -> str:
    """The path itself, else the same with ``.gz``; an error if neither is there."""
    for p in (path, path + ".gz"):
        if exists(spark, p):
            return p
    raise FileNotFoundError(path)


def sample_rows(df: DataFrame, n: int = 5) -> tuple[str, list]:
    """Schema and first rows, for a look at a source."""
    return df.schema.simpleString(), df.take(n)


def write_index(index, path: str, mode: str = "errorifexists") -> None:
    """An index as parquet tables; postings are clustered by term and block of documents, so that searches prune
    files and a frequent term fills several."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    index.postings.repartition("term", block).sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/postings")
    for name in ("docs", "terms", "stats"):
        getattr(index, name).write.mode(mode).parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str):
    from threadloom.operators.retrieval import Index

    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "stats")))


def append_log(df: DataFrame, path: str) -> None:
    """Log records appended as JSON lines, stamped with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a path, 0 if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def write_model(model, path: str, mode: str = "errorifexists") -> None:
    """A fitted model of frames as one parquet table per frame."""
    for name, frame in vars(model).items():
        frame.write.mode(mode).parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, kind: type):
    """A written model back as its kind, from the names of its fields."""
    return kind(**{name: spark.read.parquet(f"{path}/{name}") for name in kind.__dataclass_fields__})


def markdown_table(df: DataFrame, order: list[str], limit: int = 1000) -> DataFrame:
    """``(line_no, line)``: a report of a small frame as a Markdown table, in order; cells' bars are escaped."""
    cells = F.array(*[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns])
    bar = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    rows = df.orderBy(*order).limit(limit).withColumn("line", bar(cells))
    placed = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), "line").select((F.col("n") + 2).cast("long").alias("line_no"), "line")
    head = df.sparkSession.createDataFrame([(1, "| " + " | ".join(df.columns) + " |"), (2, "|" + " --- |" * len(df.columns))], "line_no long, line string")
    return head.union(placed)
