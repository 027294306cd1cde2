"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings the operators are written for; a cluster adds its own sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "docflow", **settings: str) -> SparkSession:
    """A session with SETTINGS, overridden by the given ones (underscores for dots)."""
    conf = SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on local[...] without one a fresh folder, kept for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
