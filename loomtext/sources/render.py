"""Documents rendered from relational rows, so that the answer of every parse is known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    """One document for each row."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), (F.expr(text) if isinstance(text, str) else text).alias("text"))


def joined(df: DataFrame, key: str, order: str, part: str, between: str = "\n", before: str = "''", after: str = "''") -> DataFrame:
    """One document for each group: its parts in order, with a head and a tail from the group's first row."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.struct(F.expr(order).alias("o"), F.expr(part).alias("p"), F.expr(before).alias("b"), F.expr(after).alias("a")).alias("x"))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("doc_id", F.concat(F.element_at("x", 1)["b"], F.array_join(F.transform("x", lambda y: y["p"]), between), F.element_at("x", 1)["a"]).alias("text"))
