"""Validation of node tables: shape, white space, tables, lists, quotes and grids, each rule one query.

``violations`` unites the rules into ``(doc_id, node_id, rule)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..grammar.tree import NODE_FIELDS
from ..store import stored
from .relations import below, ordinals, paired

#: The fields that a node type must have.
REQUIRED = {
    "heading": ("level",), "codeBlock": ("value",), "mathBlock": ("value",), "commentBlock": ("value",), "imageBlock": ("dest",), "videoBlock": ("dest",),
    "audioBlock": ("dest",), "embedBlock": ("dest",), "downloadBlock": ("dest",), "container": ("form",), "grid": ("grid_columns",), "gridCell": ("grid_col",),
    "list": ("kind",), "table": ("alignments",), "footnoteDefinition": ("identifier",), "footnoteReference": ("identifier",), "text": ("value",),
    "inlineCode": ("value",), "inlineMath": ("value",), "sup": ("value",), "sub": ("value",), "link": ("dest",), "inlineImage": ("dest",), "autolink": ("kind", "value"),
    "errorBlock": ("reason",),
}
#: Types without fields that must be there.
PLAIN = ("document", "recoveryDocument", "paragraph", "horizontalRule", "quoteRegion", "listItem", "tableRow", "tableCell", "gridRow", "softBreak", "hardBreak", "em", "strong", "deletion", "obsolete", "insert", "mark", "metadataSpan")
#: The fields that a node type may have besides, and those that every block may have.
OPTIONAL = {
    "codeBlock": ("code_lang",), "imageBlock": ("title", "attr_group", "attr_lang", "data_attrs"), "container": ("container_type", "container_title"), "gridCell": ("row_span", "col_span"),
    "list": ("start_no",), "listItem": ("task", "item_value"), "link": ("title", "download", "attr_lang", "data_attrs"), "inlineImage": ("title", "attr_group", "attr_lang", "data_attrs"),
    "metadataSpan": ("attr_lang", "data_attrs"), "downloadBlock": ("title", "attr_lang", "data_attrs"), "errorBlock": ("value",),
} | {f"{kind}Block": ("title", "attr_group", "attr_lang", "attr_preview", "data_attrs") for kind in ("video", "audio", "embed")}
ANYWHERE = ("block_id", "quote_level")
#: Spans that don't nest directly in their own kind, and those whose delimiter can't stand beside a word.
SPANS = ("em", "strong", "deletion", "obsolete", "insert", "mark", "metadataSpan")
FLANKED = ("deletion", "obsolete", "insert", "mark")
#: Budgets of a document: its nodes and its deepest nesting.
MOST_NODES, MOST_FRAMES = 100_000, 5_000
WHITE = r"[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def shape_violations(nodes: DataFrame) -> DataFrame:
    """Unknown types, required fields that are null, and values out of range."""
    missing = F.lit(False)
    for kind, fields in REQUIRED.items():
        for f in fields:
            missing = missing | ((F.col("type") == kind) & F.col(f).isNull())
    known = F.col("type").isin(*REQUIRED, *PLAIN)
    ranges = (F.col("level").isNotNull() & ~F.col("level").between(1, 6)) | (F.col("item_value") < 0) | (F.col("start_no") < 0) | (F.col("row_span") < 2) | (F.col("col_span") < 2)
    rule = F.when(~known, "unknown type").when(missing, "missing field").when(F.coalesce(ranges, F.lit(False)), "value out of range")
    return nodes.select("doc_id", "node_id", rule.alias("rule")).where("rule is not null")


def closed_violations(nodes: DataFrame) -> DataFrame:
    """Fields that are there and that the node's type doesn't have."""
    allowed = {t: {*REQUIRED.get(t, ()), *OPTIONAL.get(t, ()), *ANYWHERE} for t in (*REQUIRED, *PLAIN)}
    extra = F.lit(False)
    for field in (f for f in NODE_FIELDS if f not in ANYWHERE and f in nodes.columns):
        extra = extra | (F.col(field).isNotNull() & ~F.col("type").isin(*[t for t, fields in allowed.items() if field in fields]))
    return nodes.where(F.col("type").isin(*allowed) & extra).select("doc_id", "node_id", F.lit("field of another type").alias("rule"))


def _siblings() -> Window:
    return Window.partitionBy("doc_id", "parent_id", "slot").orderBy("pos")


def whitespace_violations(nodes: DataFrame) -> DataFrame:
    """White space at the outer edges of paragraphs, headings and cells, and beside breaks."""
    w = _siblings()
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    inline = nodes.where("slot in ('children', 'alt', 'label', 'caption', 'attribution')").withColumns({"_before": F.lag("type").over(w), "_after": F.lead("type").over(w)})
    texts = paired(inline.where("type = 'text'"), parents, ["doc_id", "parent_id"])
    outer = F.col("parent_type").isin("paragraph", "heading", "tableCell")
    breaks = ("softBreak", "hardBreak")
    bad = (
        (outer & F.col("_before").isNull() & F.col("value").rlike("^" + WHITE)) | (outer & F.col("_after").isNull() & F.col("value").rlike(WHITE + r"\z"))
        | (F.col("_before").isin(*breaks) & F.col("value").rlike("^" + WHITE)) | (F.col("_after").isin(*breaks) & F.col("value").rlike(WHITE + r"\z"))
    )
    return texts.where(bad).select("doc_id", "node_id", F.lit("white space at an edge").alias("rule"))


def text_violations(nodes: DataFrame) -> DataFrame:
    """Empty texts, texts side by side, and blanks before a footnote reference."""
    w = _siblings()
    marked = nodes.withColumns({"_type": F.lag("type").over(w), "_value": F.lag("value").over(w)})
    rule = (
        F.when((F.col("type") == "text") & (F.col("value") == ""), "empty text").when((F.col("type") == "text") & (F.col("_type") == "text"), "adjacent texts")
        .when((F.col("type") == "footnoteReference") & (F.col("_type") == "text") & F.col("_value").rlike(r"[ \t]\z"), "blank before a reference")
    )
    return marked.select("doc_id", "node_id", rule.alias("rule")).where("rule is not null")


def table_violations(nodes: DataFrame) -> DataFrame:
    """Rows whose number of cells differs from the table's alignments."""
    tables = nodes.where("type = 'table'").select("doc_id", F.col("node_id").alias("table_id"), F.size("alignments").alias("width"))
    rows = nodes.where("type = 'tableRow'").select("doc_id", F.col("parent_id").alias("table_id"), F.col("node_id").alias("row_id"))
    cells = nodes.where("type = 'tableCell'").groupBy("doc_id", F.col("parent_id").alias("row_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = paired(paired(rows, tables, ["doc_id", "table_id"]), cells, ["doc_id", "row_id"], "left")
    return joined.where(F.coalesce("n", F.lit(0)) != F.col("width")).select("doc_id", F.col("row_id").alias("node_id"), F.lit("table width").alias("rule"))


def quote_violations(nodes: DataFrame) -> DataFrame:
    """Quote levels that don't start at 1 or rise by more than one."""
    parents = nodes.where("type = 'quoteRegion'").select("doc_id", F.col("node_id").alias("parent_id"))
    kids = paired(nodes.where("slot = 'children'"), parents, ["doc_id", "parent_id"]).withColumn("_before", F.coalesce(F.lag("quote_level").over(_siblings()), F.lit(0)))
    return kids.where("quote_level is null or quote_level > _before + 1").select("doc_id", "node_id", F.lit("quote level").alias("rule"))


def list_violations(nodes: DataFrame) -> DataFrame:
    """Starts of 1 or on unordered lists, values on first items or that don't deviate, tasks in definitions."""
    lists = nodes.where("type = 'list'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("list_kind"))
    starts = nodes.where("type = 'list' and (start_no = 1 or kind <> 'ordered' and start_no is not null)").select("doc_id", "node_id", F.lit("list start").alias("rule"))
    items = paired(nodes.where("type = 'listItem'"), lists, ["doc_id", "parent_id"])
    odd = items.where("item_value is not null and (pos = 0 or list_kind <> 'ordered') or task is not null and list_kind = 'definition'").select("doc_id", "node_id", F.lit("list item").alias("rule"))
    numbered = ordinals(nodes).withColumn("_before", F.lag("number").over(Window.partitionBy("doc_id", "parent_id").orderBy("pos")))
    same = paired(numbered, nodes.where("item_value is not null").select("doc_id", "node_id"), ["doc_id", "node_id"]).where("number = _before + 1").select("doc_id", "node_id", F.lit("list value").alias("rule"))
    return starts.unionByName(odd).unionByName(same)


def grid_slots(nodes: DataFrame) -> DataFrame:
    """``(doc_id, grid_id, part, r, c, cell_id)``: every slot that an anchor covers."""
    rows = nodes.where("type = 'gridRow'").select("doc_id", F.col("parent_id").alias("grid_id"), F.col("slot").alias("part"), F.col("node_id").alias("row_id"), F.col("pos").alias("r0"))
    cells = nodes.where("type = 'gridCell'").select("doc_id", F.col("parent_id").alias("row_id"), F.col("node_id").alias("cell_id"), F.col("grid_col"), F.coalesce("row_span", F.lit(1)).alias("h"), F.coalesce("col_span", F.lit(1)).alias("w"))
    joined = paired(cells, rows, ["doc_id", "row_id"])
    down = joined.select("*", F.explode(F.sequence(F.col("r0"), F.col("r0") + F.col("h") - 1)).alias("r"))
    return down.select("doc_id", "grid_id", "part", "cell_id", "r", F.explode(F.sequence(F.col("grid_col"), F.col("grid_col") + F.col("w") - 1)).alias("c"))


def grid_violations(nodes: DataFrame) -> DataFrame:
    """Slots that two anchors cover, or none, or outside of the grid."""
    sizes = nodes.where("type = 'grid'").select("doc_id", F.col("node_id").alias("grid_id"), "grid_columns")
    heights = nodes.where("type = 'gridRow'").groupBy("doc_id", F.col("parent_id").alias("grid_id"), F.col("slot").alias("part")).agg(F.count(F.lit(1)).alias("height"))
    held = grid_slots(nodes).groupBy("doc_id", "grid_id", "part", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    sums = held.groupBy("doc_id", "grid_id", "part").agg(F.count(F.lit(1)).alias("slots"), F.max("n").alias("most"), F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    bad = paired(paired(sums, heights, ["doc_id", "grid_id", "part"]), sizes, ["doc_id", "grid_id"]).where("most > 1 or slots <> height * grid_columns or last_r >= height or last_c > grid_columns")
    return bad.select("doc_id", F.col("grid_id").alias("node_id"), F.lit("grid geometry").alias("rule")).distinct()


def nesting_violations(nodes: DataFrame) -> DataFrame:
    """Links in labels, breaks in one-line spans, and spans right inside one of their kind."""
    def inside(tops: str, kids: str, rule: str) -> DataFrame:
        return below(nodes, F.expr(tops)).where(F.col("inside") & F.expr(kids)).select("doc_id", "node_id", F.lit(rule).alias("rule"))

    labels = inside("type in ('link', 'inlineImage')", "type in ('link', 'autolink', 'footnoteReference')", "link in a label")
    lines = inside("type in ('obsolete', 'insert', 'mark', 'heading', 'tableCell', 'footnoteDefinition')", "type in ('softBreak', 'hardBreak')", "break in one line")
    spans = nodes.where(F.col("type").isin(*SPANS))
    parents = spans.select("doc_id", F.col("node_id").alias("parent_id"), "type")
    same = paired(spans, parents, ["doc_id", "parent_id", "type"], "left_semi").select("doc_id", "node_id", F.lit("same kind inside").alias("rule"))
    return labels.unionByName(lines).unionByName(same)


def flank_violations(nodes: DataFrame) -> DataFrame:
    """Spans whose delimiter can't stand beside a word, with a text at their side that ends or begins in one.

    A word is made of letters, decimal digits and underscores.
    """
    w = _siblings()
    value = F.when(F.col("type") == "text", F.col("value"))
    marked = nodes.withColumns({"_left": F.lag(value).over(w), "_right": F.lead(value).over(w)})
    beside = F.col("_left").rlike(r"[\p{L}\p{Nd}_]\z") | F.col("_right").rlike(r"^[\p{L}\p{Nd}_]")
    return marked.where(F.col("type").isin(*FLANKED) & beside).select("doc_id", "node_id", F.lit("delimiter beside a word").alias("rule"))


def budget_violations(nodes: DataFrame, most_nodes: int = MOST_NODES, most_frames: int = MOST_FRAMES) -> DataFrame:
    """Documents with more nodes or deeper nesting than the budgets, named at their root."""
    sizes = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deep"))
    rule = F.when(F.col("n") > most_nodes, "node budget").when(F.col("deep") > most_frames, "frame budget")
    return sizes.select("doc_id", F.lit(0).alias("node_id"), rule.alias("rule")).where("rule is not null")


RULES = (shape_violations, closed_violations, budget_violations, whitespace_violations, flank_violations, text_violations, table_violations, quote_violations, list_violations, grid_violations, nesting_violations)


def violations(nodes: DataFrame) -> DataFrame:
    """All rules over one node table; store the table first, as every rule reads it."""
    return reduce(DataFrame.unionByName, (rule(nodes) for rule in RULES))


def stored_violations(nodes: DataFrame) -> DataFrame:
    """``violations``, each rule run and stored before the next, so that the driver holds one rule's plan at a time."""
    return reduce(DataFrame.unionByName, [stored(rule(nodes), rule.__name__) for rule in RULES])
