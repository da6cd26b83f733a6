"""textmill.streaming.

The reference reads every input whole from files and has no stream, so no
stateful streaming operator is built.  All scalar text functions
(``textmill.functions.text``) are stateless column expressions, so they
run unchanged on a streaming DataFrame; ``clean_stream`` shows the wiring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as TX

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def clean_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of (doc_id, tokens) over Parquet files arriving
    in ``path``; start it with ``writeStream`` and a checkpoint location in
    the shared checkpoint folder."""
    src = (spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(path))
    return src.select("doc_id", TX.word_tokens(TX.clean_text(F.col("text"))).alias("tokens"))
