"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, small Arrow batches (documents can be long) and a fixed time zone.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "loomtext", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; a cluster's own master and sizes are left alone."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
