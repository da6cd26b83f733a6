"""Writers.  Features live in one long Parquet store partitioned by
(dataset, feature); dynamic partition overwrite replaces only the
partitions a job writes, so jobs for different features never clobber
each other and readers prune by partition."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import zero_pad

def to_long(df: DataFrame, key: str = "id", value_cols: list[str] | None = None) -> DataFrame:
    """Wide numeric feature table -> long (id, name, value)."""
    cols = value_cols or [c for c in df.columns if c != key]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                for c in cols]))
    return df.select(F.col(key).alias("id"), stack.alias("kv")).select("id", "kv.name", "kv.value")


def sink_features(df_long: DataFrame, root: str, dataset: str, feature: str) -> None:
    spark = df_long.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (df_long.select("id", "name", F.col("value").cast("double").alias("value"))
     .withColumn("dataset", F.lit(dataset)).withColumn("feature", F.lit(feature))
     .write.mode("overwrite").partitionBy("dataset", "feature").parquet(root))


def submission_frame(df: DataFrame, id_col: str = "id", pred_col: str = "prediction",
                     test_case: str | None = None) -> DataFrame:
    """(test_case, six-digit id, prediction) rows of a run file."""
    tc = F.lit(test_case) if test_case is not None else F.col("test_case")
    return df.select(tc.alias("test_case"), zero_pad(F.col(id_col)).alias("id"),
                     F.col(pred_col).cast("string").alias("prediction"))


def run_name(task: str, team: str, run: str, model_type: str = "") -> str:
    return f"{task}_{team}_{run}{model_type}"


def sink_submission(df: DataFrame, root: str, task: str = "task1", team: str = "team", run: str = "1",
                    model_type: str = "", test_case: str | None = None) -> str:
    path = f"{root}/{run_name(task, team, run, model_type)}"
    (submission_frame(df, test_case=test_case)
     .write.mode("overwrite").option("sep", "\t").option("header", False).csv(path))
    return path


def sink_submission_const(df: DataFrame, path: str, test_case: str, sep: str = "\t") -> None:
    (submission_frame(df, test_case=test_case)
     .write.mode("overwrite").option("sep", sep).option("header", False).csv(path))


def sink_metrics(spark: SparkSession, rows: list[dict] | DataFrame, path: str) -> None:
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows)
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def sink_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def sink_translated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def sink_token_vectors(df: DataFrame, path: str) -> None:
    df.select("id", "pos", "vec").write.mode("overwrite").parquet(path)
