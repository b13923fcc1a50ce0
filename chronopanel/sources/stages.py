"""Tables of a run's stages, and models with their metrics, on any store that Spark writes to."""

from __future__ import annotations

import json

from pyspark.ml.util import MLReader
from pyspark.sql import DataFrame, SparkSession


def write(df: DataFrame, at: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Write a stage, as parquet or csv (with a header; no arrays), one folder for each value of the keys `by`.

    With keys the rows are brought together by key, so that a key has few files; adaptive execution splits keys
    that are too large for one task."""
    dealt = df.hint("rebalance", *by) if by else df
    writer = dealt.write.mode("overwrite").partitionBy(*(by or []))
    writer.option("header", True).format(form).save(at)


def read(spark: SparkSession, at: str, schema: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(form).load(at)


def write_model(spark: SparkSession, model, at: str, features: list[str], metrics: dict) -> None:
    """The model, and beside it one JSON row: its features, in order, and its metrics."""
    model.write().overwrite().save(f"{at}/model")
    text = json.dumps({"features": features, "metrics": metrics}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/about")


def read_model(spark: SparkSession, at: str, reader: MLReader):
    """Model, features and metrics. reader: that of the model's class, as RandomForestClassificationModel.read()."""
    about = json.loads(spark.read.text(f"{at}/about").first().value)
    return reader.load(f"{at}/model"), about["features"], about["metrics"]


def write_tensor(cubes: DataFrame, about: DataFrame, at: str, channels: list[str], steps: int) -> None:
    """Cubes (entity, cube) with the columns of about (entity, label and others) beside them as one Parquet table, and a
    JSON row with the names of the channels and the number of steps. Entities that about lacks have nulls there."""
    cubes.join(about, "entity", "left").write.mode("overwrite").parquet(f"{at}/tensor")
    text = json.dumps({"channels": channels, "steps": steps}, sort_keys=True)
    cubes.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/about")


def read_tensor(spark: SparkSession, at: str) -> tuple[DataFrame, list[str], int]:
    """The table of write_tensor(), its channels and its steps."""
    about = json.loads(spark.read.text(f"{at}/about").first().value)
    return spark.read.parquet(f"{at}/tensor"), about["channels"], about["steps"]
