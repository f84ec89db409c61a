"""The session that the library is meant for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "skyloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow; other settings by keyword with _ for a dot."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, in local mode one of our own if none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[[\d*,]+\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="skyloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
