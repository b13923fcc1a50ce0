"""Session with the settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "chronopanel", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder that the
    context was given. Where neither is set, a local session gets one of its own; on a cluster that is an error,
    as executors elsewhere could not read a folder made here."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="chronopanel-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and written to the session's checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
