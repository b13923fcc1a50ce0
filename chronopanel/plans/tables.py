"""The registered tables as panels, points and labelled scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import composite, series

STEPS = 15
#: Brings event values near reflectances; a prime, so that rounded results meet no ties.
SCALE = 497
EVENT_BANDS = ["click", "error", "purchase", "signup", "view"]
#: Which sensor band an event type stands for.
ROLES = {"B8": "view", "B4": "click", "B2": "purchase", "B3": "signup", "B11": "error"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def observed(spark: SparkSession, d: str) -> DataFrame:
    """entity, band, step (of two days), v (median value / SCALE) and n."""
    step = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 2).cast("int")
    e = read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("band"), step.alias("step"), (F.col("value") / SCALE).alias("value"))
    return composite.composite(e.where(f"step between 0 and {STEPS - 1}"), ["entity", "band", "step"])


def grid(spark: SparkSession, d: str) -> DataFrame:
    return composite.densify(observed(spark, d), STEPS, EVENT_BANDS)


def filled(spark: SparkSession, d: str) -> DataFrame:
    return series.gap_fill(grid(spark, d))


def wide(df: DataFrame) -> DataFrame:
    """A row for each entity and step with the bands as columns; the values are given, so no job looks for them."""
    return df.groupBy("entity", "step").pivot("band", EVENT_BANDS).agg(F.first("v"))


def months(spark: SparkSession, d: str) -> DataFrame:
    """Mean price per unit by supplier and month: entity, band, month_start, step, v."""
    m = F.trunc("l_shipdate", "month")
    x = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), m.alias("month_start")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("v"))
    step = (F.year("month_start") - 1995) * 12 + F.month("month_start") - 1
    return x.withColumns({"band": F.lit("price"), "step": step.cast("int")})


def points(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, lon, lat: two components of each vector, as places."""
    e = read(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.get("embedding", 0).cast("double") * 2 + 77.6).alias("lon"), (F.get("embedding", 1).cast("double") * 2 + 29.2).alias("lat"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, lang, y (quality) and a deterministic score."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", ((F.col("n_chars") % 1000) / 1000.0).cast("double").alias("score"))
    return docs.join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
