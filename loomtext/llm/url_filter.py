"""URL filters: allow and block rules, and logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions.  The model is trained from a small labelled
table by gradient steps, each one aggregate over at most ``MOST_LABELLED`` rows; scoring
adds up the weights of a URL's n-grams in one expression, without a shuffle.
"""

from __future__ import annotations

import csv
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import double_array

#: Fixed values, in force from the longest to the shortest: (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
BUCKETS, GRAMS, STEPS, RATE, DECAY, CUTOFF = 8192, (2, 3, 4), 30, 4.0, 0.002, 0.5
MOST_LABELLED = 20_000


#: The labelled table that comes with the package: invented URLs, labelled by hand; label 1 is unwanted.
LABELLED = os.path.join(os.path.dirname(__file__), "data", "labelled_urls.csv")


def labelled_urls(spark: SparkSession, path: str = LABELLED) -> DataFrame:
    """A labelled table ``(url, label)`` from a small CSV file that the driver reads."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, label int")


def held_out_accuracy(labelled: DataFrame, folds: int = 5) -> float:
    """The share of rows that a model judges right which has not seen them: one model for each fold by crc32 of the URL."""
    right, fold = 0, F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(folds))
    for k in range(folds):
        weights, bias = train(labelled.where(fold != k))
        judged = judge_urls(labelled.where(fold == k), weights, bias, rules=())
        right += judged.where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    return right / labelled.count()


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS, grams=GRAMS) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, told apart by where they lie."""
    parts = []
    for kind, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in grams:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))
            parts.append(F.transform(starts, _hasher(kind, text, n, buckets)))
    return F.array_distinct(F.concat(*parts))


def _hasher(kind: str, text: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int")


def logit(features: Column, weights: list[float], bias: float) -> Column:
    """The score of hashed features under the weights, one literal array of ``BUCKETS`` numbers."""
    held = double_array([*weights, bias])
    total = F.aggregate(features, F.lit(0.0), lambda acc, i: acc + F.get(held, i))
    return F.get(held, F.lit(len(weights))) + total / F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double"))


def train(labelled: DataFrame, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights and bias of the logistic regression; each step is one aggregate over the labelled table.

    Rows without url or label are left out; ``MOST_LABELLED`` rows are used at most.  An
    empty table gives zero weights and a bias that allows everything.
    """
    url = F.col("url")
    rows = labelled.where(url.isNotNull() & F.col("label").isNotNull()).limit(MOST_LABELLED)
    rows = rows.select(gram_buckets(host_of(url), path_of(url)).alias("f"), F.col("label").cast("double").alias("y")).coalesce(1).cache()
    weights, bias, n = [0.0] * buckets, 0.0, rows.count()
    if not n:
        return weights, -1.0
    try:
        for _ in range(steps):
            p = 1 / (1 + F.exp(-logit(F.col("f"), weights, bias)))
            errors = rows.select(((p - F.col("y")) / F.sqrt(F.size("f").cast("double"))).alias("e"), (p - F.col("y")).alias("e0"), F.posexplode("f").alias("at", "f"))
            step = errors.groupBy("f").agg(F.sum("e").alias("g"), F.sum(F.when(F.col("at") == 0, F.col("e0")).otherwise(0.0)).alias("g0")).collect()  # BUCKETS rows at most
            weights = [w * (1 - rate * decay) for w in weights]
            for r in step:
                weights[r["f"]] -= rate * 8 * r["g"] / n
            bias -= rate * math.fsum(r["g0"] for r in step) / n
    finally:
        rows.unpersist()
    return weights, bias


def judge_urls(df: DataFrame, weights: list[float], bias: float, url: str = "url", rules=RULES, cutoff: float = CUTOFF) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``block_score`` (probability that a URL is unwanted) and ``verdict``.

    A rule decides where one fits, the model elsewhere.  A null or odd URL has an empty
    host and path, fits no rule and is scored like any other.  Of fitting rules the longest
    decides; very long URLs are scored whole, repeated rows alike, an empty table gives no
    rows, and columns named like an added one are replaced.
    """
    parts = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-logit(gram_buckets(F.col("host"), F.col("path")), weights, bias)))
    return parts.withColumns({"rule": rule, "block_score": score}).withColumn("verdict", F.coalesce(decided, F.when(F.col("block_score") >= cutoff, F.lit("block")).otherwise(F.lit("allow"))))
