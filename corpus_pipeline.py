"""A training corpus from ``documents``: quality rules, line dedup, near-dedup,
benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in
the shared folder and read again as the next one's documents, so a lost
executor costs at most the stage under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import row_of, shared_path
from textmill.llm.decontaminate import decontaminate
from textmill.llm.line_dedup import dedup_lines
from textmill.llm.near_dup import near_duplicates
from textmill.llm.pieces import encode_pieces
from textmill.llm.quality_rules import filter_quality
from textmill.llm.queries import table, tokenizer_file

#: SentencePiece is not SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of three lines; ``n_chars``, if there,
    follows the text.  A document whose every line with a word went is dropped."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = dedup_lines(docs, carry=rest).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_units")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in rest:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, at least
    0.8), that with the smallest id; of rows with that id, one.  Documents
    without an id all stay."""
    kept = near_duplicates(docs).where("kept").where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    rows = docs.select(F.col("doc_id").alias("own"), row_of(docs.columns).alias("row"))
    found = rows.join(kept, F.col("own") == F.col("doc_id"))
    once = found.where("copies = 1").select("row.*")
    again = found.where("copies > 1").dropDuplicates(["own"]).select("row.*")
    return once.union(again).union(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; a null text has none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's pieces, and the text that they decode to; a null
    text has none and decodes to the empty one."""
    done = encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), keep=["lang", "source"])
    return done.select("doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("decontamination", benchmark), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
