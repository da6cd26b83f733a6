"""Readers.  Every reader declares its schema (no inference pass over the
data) and selects only the columns asked for, so the projection reaches the
Parquet / CSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.sources.quoted import scan_quoted

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

POST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("test_case", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("task1", T.StringType()), T.StructField("task2", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("translated_text", T.StringType()),
])

REFERENCE_ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("dataset", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("toxicity", T.DoubleType()),
    T.StructField("sexist", T.BooleanType()), T.StructField("sexist_content", T.StringType()),
    T.StructField("sexist_phrasing", T.StringType()), T.StructField("scale", T.StringType()),
    T.StructField("of_id", T.LongType()),
])


# Tables whose rows carry whole texts: per-row CPU (regex, tokenising)
# dominates, so they must be spread over all cores.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the scan has fewer splits than the
    cluster has cores (a file written as one row group is one task).  On a
    large input the scan already has far more splits and nothing moves."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


#: Rows of a partition of a table that fits hold and read again.
HELD_ROWS = 250_000


def spread_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Round-robin repartition only when partitions have more than ``rows`` rows
    on average, so that what a task holds doesn't grow with the table.  The
    frame is counted: give a written one."""
    n = -(-df.count() // (rows or HELD_ROWS))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table; ``columns`` prunes at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXT_TABLES else df


def scan_posts(spark: SparkSession, path: str, columns: list[str] | None = None,
               sep: str = "\t", schema: T.StructType = POST_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Delimited post table (header, quoted fields).  ``multi_line`` reads
    fields with line ends, by blocks of lines (``quoted``)."""
    df = (scan_quoted(spark, path, schema, sep) if multi_line else
          spark.read.schema(schema)
          .option("header", True).option("sep", sep)
          .option("quote", '"').option("escape", '"').option("enforceSchema", False)
          .csv(path))
    return df.select(*columns) if columns else df


def flatten_terms(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All cells of a term table as one ``term`` column, nulls dropped, distinct."""
    cols = columns or df.columns
    return (df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("term"))
            .where(F.col("term").isNotNull() & (F.trim("term") != ""))
            .select(F.trim("term").alias("term")).distinct())


def scan_lexicon(spark: SparkSession, path: str, sep: str = "\t", skip_comments: bool = False) -> DataFrame:
    """Term list file with one or more columns and no header (the
    reference reads it with a header and loses the first term; we do not)."""
    raw = spark.read.option("header", False).option("sep", sep).csv(path)
    terms = flatten_terms(raw)
    if skip_comments:
        terms = terms.where(~F.col("term").startswith("#"))
    return terms


def scan_reference_items(spark: SparkSession, path: str, with_modifications: bool = False,
                         multi_line: bool = False) -> DataFrame:
    """Reference items, originals only unless modifications are asked for."""
    df = (scan_quoted(spark, path, REFERENCE_ITEM_SCHEMA, check_header=False) if multi_line else
          spark.read.schema(REFERENCE_ITEM_SCHEMA).option("header", True).option("escape", '"').csv(path))
    return df if with_modifications else df.where(F.col("of_id") == -1)


def scan_features(spark: SparkSession, root: str, dataset: str, feature: str) -> DataFrame:
    """One feature of one dataset from the long feature store; the two
    equality filters prune partitions."""
    return (spark.read.parquet(root)
            .where((F.col("dataset") == dataset) & (F.col("feature") == feature))
            .select("id", "name", "value"))


def scan_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos, vec) table of per-position model outputs."""
    return spark.read.parquet(path).select("id", "pos", "vec")


def scan_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("token", "vec")
