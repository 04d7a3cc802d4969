"""Relations inside documents: footnotes, ids, anchors, numbering, ancestry. Joins, aggregates and windows by document.

Every operator takes the node table; ``key`` names the document.  Joins are on the key and
an identifier, so very large documents spread by identifier and adaptive plans can split
what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import stored

SCOPES = ("listItem", "quoteRegion", "gridCell")


def paired(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the nodes, never by broadcast.

    What a stored table weighs as compressed files says little about its rows, so an
    estimate from it can send all of them through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def references(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Identifiers referred to, with the first reference and how often."""
    found = nodes.where("type = 'footnoteReference'")
    return found.groupBy(key, "identifier").agg(F.min("node_id").alias("first_ref"), F.count(F.lit(1)).alias("n_refs"))


def definitions(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Identifiers that are defined; duplicates kept by recovery count with their error blocks."""
    return nodes.where("type = 'footnoteDefinition'").select(key, "identifier", "node_id")


def footnote_order(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Canonical place of each definition: by first reference, then the unused in ASCII order."""
    joined = definitions(nodes, key).join(references(nodes, key), [key, "identifier"], "left")
    order = Window.partitionBy(key).orderBy(F.col("first_ref").asc_nulls_last(), "identifier")
    return joined.select(key, "identifier", F.row_number().over(order).cast("bigint").alias("position"), F.coalesce("n_refs", F.lit(0)).cast("bigint").alias("n_refs"))


def dangling_references(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return references(nodes, key).join(definitions(nodes, key), [key, "identifier"], "left_anti")


def unused_definitions(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return definitions(nodes, key).join(references(nodes, key), [key, "identifier"], "left_anti").select(key, "identifier")


def duplicate_ids(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Block ids that stand twice or more in a document."""
    return nodes.where("block_id is not null").groupBy(key, "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def below(nodes: DataFrame, tops: Column, key: str = "doc_id") -> DataFrame:
    """Adds ``inside``: whether a node lies below one where ``tops`` holds.

    Nodes are numbered in document order and a subtree ends at ``subtree_end``, so a node is
    inside where the largest end of the tops before it reaches it: one window, no pairs.
    """
    before = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("inside", F.coalesce(F.max(F.when(tops, F.col("subtree_end"))).over(before) >= F.col("node_id"), F.lit(False)))


def scope_violations(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids inside list items, quotes or grid cells."""
    return below(nodes, F.col("type").isin(*SCOPES), key).where("inside and block_id is not null").drop("inside")


def dangling_anchors(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Links to ``#id`` where no block has the id."""
    anchors = nodes.where("type = 'link' and dest rlike '^#[A-Za-z0-9_-]+\\\\z'").select(key, F.expr("substring(dest, 2)").alias("block_id"))
    return anchors.join(nodes.where("block_id is not null").select(key, "block_id"), [key, "block_id"], "left_anti").distinct()


def ordinals(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The visible number of every item of ordered lists: the last value given, plus the items since."""
    lists = nodes.where("type = 'list' and kind = 'ordered'").select(key, F.col("node_id").alias("parent_id"), F.coalesce("start_no", F.lit(1)).alias("_first"))
    items = paired(nodes.where("type = 'listItem'"), lists, [key, "parent_id"])
    w = Window.partitionBy(key, "parent_id").orderBy("pos")
    given = F.when(F.col("pos") == 0, F.col("_first")).otherwise(F.col("item_value"))
    last_pos = F.last(F.when(given.isNotNull(), F.col("pos")), True).over(w)
    return items.select(key, "parent_id", "node_id", "pos", (F.last(given, True).over(w) + F.col("pos") - last_pos).cast("bigint").alias("number"))


def shared_values(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``(side, n)``: distinct values that both tables have, and rows of the left that the right has no row for.

    As ``intersect`` and ``exceptAll`` count them, from one reading of each table; both rows are always there.
    """
    rows = left.select(value, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(value, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sums = rows.groupBy(value).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both, alone = F.count_if((F.col("l") > 0) & (F.col("r") > 0)), F.coalesce(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))), F.lit(0))
    return sums.agg(both.alias("both"), alone.cast("bigint").alias("alone")).selectExpr("stack(2, 'both', both, 'left', alone) as (side, n)")


def histogram(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))


def histogram_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Node types whose counts differ between two node tables."""
    both = histogram(left).withColumnRenamed("n", "n_left").join(histogram(right).withColumnRenamed("n", "n_right"), "type", "full_outer")
    both = both.select("type", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def descendant_types(nodes: DataFrame, ancestor: str, key: str = "doc_id") -> DataFrame:
    """Node types found below nodes of one type, with counts."""
    return below(nodes, F.col("type") == ancestor, key).where("inside").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def skeletons(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Block types of each document in order, as one text."""
    blocks = nodes.where("slot in ('children', 'items', 'rows', 'cells', 'header') and (type like '%Block' or type in ('heading','paragraph','horizontalRule','quoteRegion','list','table','container','grid'))")
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", "type"))).alias("b"))
    return rows.select(key, F.array_join(F.transform("b", lambda x: x["type"]), " ").alias("skeleton"))


def semantic_groups(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Valid documents of one meaning: grouped by the hash of their canonical text."""
    return parsed.where("canonical_hash is not null").groupBy("canonical_hash").agg(F.min(key).alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


def numbered(rows: DataFrame, by: str, order: str, name: str = "n") -> DataFrame:
    """Adds the number of a row among those of its ``by``, in the order of ``order``.

    Rows are dealt out in ranges of both, so a common value spreads over several tasks; the
    rows of a value in the ranges before come from a table with a row for each value and range.
    """
    ranges = stored(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = ranges.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)))
    sums = ranges.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sums.withColumn("_before", before).drop("_k"), [by, "_range"]).withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before", "_range")
