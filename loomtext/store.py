"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = ""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none, as in tests, gets a fresh local folder."""
    global _OWN
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        where = _OWN = _OWN or "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again, so that what follows is computed from files and not twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
