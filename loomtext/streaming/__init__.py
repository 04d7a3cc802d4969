"""Streams of documents.

Reading is local to a row, so a stream takes the same stateless select as a table; no
watermark and no state are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import parse_documents


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", max_files: int = 100) -> DataFrame:
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def parsed_stream(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verdict and canonical text for each document of a stream."""
    return parse_documents(stream, key, text, nodes=False).select(key, "status", "canonical", "canonical_hash")


def verdict_counts(stream: DataFrame, at: str, window: str = "1 hour", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Verdicts by time window, for streams that carry an event time."""
    rows = parse_documents(stream.select(F.col(at).cast("timestamp").alias("at"), text), "at", text, nodes=False)
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "status").count()


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch once; starts and returns the query, which ends when all there is has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
