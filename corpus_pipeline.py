"""A corpus pipeline of five stages: quality rules, language ID, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the
driver writes each result as Parquet and hands it to the next stage.  All but the last
return the columns of ``documents``, as they came: inside a stage they have private names,
so a column that shares its name with one that an operator adds is left alone.

Null and blank texts fail the quality rules.  A null ``doc_id`` is a key like any other,
rows of one ``doc_id`` with different texts are different documents, and rows that repeat
both are copies of each other.  An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe_automaton, decontaminate, language_id, ngram_join, quality_rules
from loomtext.llm.common import crc_fold, materialise, small_batches, table
from loomtext.llm.queries import vocabulary_path


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """The rows under private names, the private name of a column, and the way back."""
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    return renamed, own.__getitem__, lambda df: df.select(*[F.col(k).alias(c) for c, k in own.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the weighed rules keep; the text goes along with its counts, so nothing is joined."""
    rows, own, back = _apart(docs)
    return back(quality_rules.judge_quality(rows, own("text"), carry=rows.columns).where("kept"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose two best languages compress alike."""
    small_batches(spark)
    rows, own, back = _apart(docs)
    learned = language_id.learn_dictionaries(rows.where(crc_fold(F.col(own("doc_id")), 5) != 0), own("text"), own("lang"), own("doc_id"))
    return back(language_id.identify_language(rows, learned, own("text")).where("lang_accepted"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of linked texts, that of the smallest doc_id; texts without words stay.

    What goes is named by doc_id and a hash of the text.  Up to ``ngram_join.BROADCAST_IDS``
    such names are broadcast, else joined by a shuffle.  Only rows that repeat the name of
    a document that stays are brought together, to leave one of them.
    """
    small_batches(spark)
    rows, own, back = _apart(docs)
    found = ngram_join.joined_rows(rows, own("doc_id"), own("text")).where("n_shingles > 0")
    names = found.groupBy("doc", "digest").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("n"))
    names = materialise(names.where("not stays or n > 1"), "duplicates")
    few = names.count() <= ngram_join.BROADCAST_IDS
    named = lambda which: F.broadcast(names.where(which)) if few else names.where(which)
    same = lambda a: F.col(own("doc_id")).cast("bigint").eqNullSafe(a["doc"]) & (F.xxhash64(own("text")) == a["digest"])

    def among(which: str, how: str) -> DataFrame:
        other = named(which)
        return rows.join(other, same(other), how)

    if names.where("stays").isEmpty():
        return back(among("not stays", "left_anti"))
    alone = among("true", "left_anti")
    repeated = among("stays", "left_semi").withColumn("_digest", F.xxhash64(own("text"))).dropDuplicates([own("doc_id"), "_digest"])
    return back(alone.unionByName(repeated.drop("_digest")))


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in a benchmark window."""
    rows, own, back = _apart(docs)
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), own("text"))
    return back(found.where(~decontaminate.contaminated()))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left."""
    small_batches(spark)
    return bpe_automaton.token_digests(docs.select("doc_id", "text"), vocabulary_path())


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("n-gram jaccard join", duplicate_stage),
    ("benchmark decontamination", contamination_stage),
    ("bpe tokens", token_stage),
]
#: SQL can express neither the compression nor the merges; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; between two stages rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
