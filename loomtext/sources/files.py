"""Readers and writers of document collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole UTF-8 files as ``(path, text, valid_utf8)``; bytes that aren't UTF-8 keep a null text."""
    raw = spark.read.format("binaryFile").load(paths)
    ok = F.expr("is_valid_utf8(cast(content as string))")
    return raw.select(F.col("path"), F.when(ok, F.col("content").cast("string")).alias("text"), ok.alias("valid_utf8"))


def read_cases(spark: SparkSession, paths: str | list[str], array: str = "cases") -> DataFrame:
    """JSON files that hold an array of cases: one row for each case, with the file's other fields beside it."""
    table = spark.read.option("multiLine", True).json(paths)
    return table.select(*[c for c in table.columns if c != array], F.explode(array).alias("case")).select("*", "case.*").drop("case")


def write_texts(df: DataFrame, path: str, text: str = "text", by: str | None = None, mode: str = "errorifexists") -> None:
    """One line-preserving text row for each document; always to a new path, committed as a whole."""
    out = df.select(*([by] if by else []), F.col(text).alias("value"))
    writer = out.write.mode(mode).option("lineSep", "\n")
    (writer.partitionBy(by) if by else writer).text(path)


def strip_front_matter(text):
    """The text without a leading ``---`` … ``---`` head, after an optional byte-order mark."""
    return F.regexp_replace(text, r"(?s)\A\x{FEFF}?---\s*\n.*?\n---\s*(?:\n|\z)", "")


def front_matter(text):
    """The head that ``strip_front_matter`` removes; empty where there is none."""
    return F.regexp_extract(text, r"(?s)\A(\x{FEFF}?---\s*\n.*?\n---\s*(?:\n|\z))", 1)
