"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronopanel.session import shared_dir

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and nothing is computed twice."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def kept_apart(docs: DataFrame, made: Callable[..., DataFrame], *names: str) -> DataFrame:
    """made(docs, *names) where docs' columns that begin with two underscores, as an operator's own do, have other names
    meanwhile. names: columns that the operator reads."""
    clashing = [c for c in docs.columns if c.startswith("__")]
    away: dict[str, str] = {}
    for c in clashing:
        other = f"own{c}"
        while other.lower() in {x.lower() for x in (*docs.columns, *away.values())}:
            other = f"own_{other}"
        away[c] = other
    out = made(docs.withColumnsRenamed(away) if away else docs, *[away.get(n, n) for n in names])
    return out.withColumnsRenamed({v: k for k, v in away.items()}) if away else out
