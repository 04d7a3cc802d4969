"""Queries of the markup operators, each with the SQL that knows its answer from the relational rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sqlfuncs as S
from ..functions.sqlfuncs import language_tag_ok, slug
from ..operators import documents as D
from ..operators import fixtures as X
from ..operators import lines as L
from ..operators import relations as R
from ..operators import reports as P
from ..operators import transport as T
from ..operators import validation as V
from ..sources.render import each, joined, table
from ..store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries whose answers SQL can't express; tests hold them against brute force.
UNSTATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# transport and lines


@query("""
SELECT doc_id, n AS line_no, l AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents)
WHERE n < m OR l <> ''""")
def physical_lines(spark, sf):
    return L.quick_lines(table(spark, sf, "documents"))


_VARIANTS = "case doc_id % 4 when 0 then concat(char(65279), text) when 1 then replace(text, '\n', '\r\n') when 2 then concat(text, '\n\n') else text end"


@query("""
SELECT doc_id, doc_id % 4 = 0 AS had_bom,
  CASE WHEN doc_id % 4 = 1 THEN CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) ELSE 0 END AS crlf_count,
  CAST(0 AS BIGINT) AS lone_cr_count,
  CAST(length(text) - length(rtrim(text, chr(10))) + CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 0 END AS BIGINT) AS trailing_lf
FROM documents""")
def transport_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_VARIANTS.replace("char(65279)", "'﻿'")).alias("text"))
    return T.with_report(docs).select("doc_id", "had_bom", "crlf_count", "lone_cr_count", "trailing_lf")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents),
s AS (SELECT doc_id, n, m, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(l) - 1 AS s FROM l)
SELECT doc_id, n AS line_no, CAST(s AS BIGINT) AS start_off, CAST(s + length(l) AS BIGINT) AS end_off, n < m AS terminated FROM s WHERE n < m OR l <> ''""")
def line_spans(spark, sf):
    return L.lines(table(spark, sf, "documents")).drop("line")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(l) - 1 AS s FROM l)
SELECT doc_id, n AS line_no, CAST(s + n - 1 AS BIGINT) AS source_off FROM s""")
def offset_projection(spark, sf):
    """Line starts of texts with CRLF line ends, in the raw text: each end before adds one."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr("replace(text, '\n', '\r\n')").alias("text"))
    held = docs.select("doc_id", T.crlf_offsets(F.col("text")).alias("crlf"), F.lit(False).alias("bom"))
    rows = held.select("doc_id", "crlf", "bom", F.posexplode(F.concat(F.array(F.lit(-1)), "crlf")).alias("p", "at"))
    return rows.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), T.to_source(F.col("at") + 1, F.col("crlf"), F.col("bom")).cast("bigint").alias("source_off"))


@query("""
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS source_bytes, octet_length(encode(text)) > 4096 AS over_budget FROM documents""")
def size_budget(spark, sf):
    return T.over_budget(table(spark, sf, "documents"), max_bytes=4096).select("doc_id", "source_bytes", "over_budget")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, CAST(n_nationkey // 2 + n_regionkey + 1 AS BIGINT) AS frames FROM nation""")
def structural_frames(spark, sf):
    docs = each(table(spark, sf, "nation"), "n_nationkey", "concat(repeat(' ', n_nationkey), repeat('> ', n_regionkey), '- ', n_name)")
    return T.over_budget(docs).select("doc_id", "frames")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(l) - 1 AS s FROM l)
SELECT doc_id, CAST(s + length(l) // 2 AS BIGINT) AS off, n AS line_no, CAST(length(l) // 2 + 1 AS BIGINT) AS column_no FROM s WHERE l <> ''""")
def offset_positions(spark, sf):
    """Line and column of the middle of every line: an as-of join of offsets with line starts."""
    own = L.lines(table(spark, sf, "documents"))
    asked = own.where("line <> ''").select("doc_id", (F.col("start_off") + F.floor(F.length("line") / 2)).alias("off"))
    return L.positions(own, asked)


# single-line blocks, natively


@query("""
SELECT o_orderkey::BIGINT AS doc_id, CAST(1 + o_custkey % 6 AS BIGINT) AS level, 'Order ' || o_orderkey || ' of ' || o_orderpriority AS heading, 'o-' || o_orderkey AS block_id FROM orders""")
def headings(spark, sf):
    text = "concat(repeat(' ', cast(o_orderkey % 4 as int)), repeat('#', cast(1 + o_custkey % 6 as int)), '  Order ', o_orderkey, ' of ', o_orderpriority, if(o_orderkey % 2 = 0, ' ##', ''), ' {#o-', o_orderkey, '}\n')"
    return L.headings(L.quick_lines(each(table(spark, sf, "orders"), "o_orderkey", text))).select("doc_id", "level", "heading", "block_id")


@query("""
SELECT o_orderkey::BIGINT AS doc_id, CAST(1 + o_custkey % 6 AS INTEGER) AS level, 'o-' || o_orderkey AS block_id FROM orders""")
def heading_nodes(spark, sf):
    text = "concat(repeat('#', cast(1 + o_custkey % 6 as int)), ' Order ', o_orderkey, ' {#o-', o_orderkey, '}\n\nText.\n')"
    return D.node_table(each(table(spark, sf, "orders"), "o_orderkey", text)).where("type = 'heading'").select("doc_id", "level", "block_id")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, n_nationkey % 3 = 2 AS mixed FROM nation""")
def thematic_breaks(spark, sf):
    text = "concat(n_name, '\n\n', element_at(array('---', '* * *', '--*'), cast(n_nationkey % 3 + 1 as int)), '\n\nend\n')"
    return L.thematic_breaks(L.quick_lines(each(table(spark, sf, "nation"), "n_nationkey", text))).select("doc_id", "mixed")


@query("""
SELECT p_partkey::BIGINT AS doc_id, 'sql' AS code_lang, p_type || chr(10) || '# ' || p_brand AS value FROM part""")
def code_fences(spark, sf):
    text = "concat('before\n', repeat('`', cast(3 + p_partkey % 3 as int)), 'sql\n', p_type, '\n# ', p_brand, '\n', repeat('`', cast(3 + p_partkey % 3 as int)), '\n')"
    return D.node_table(each(table(spark, sf, "part"), "p_partkey", text)).where("type = 'codeBlock'").select("doc_id", "code_lang", "value")


@query("""
SELECT p_partkey::BIGINT AS doc_id, CAST(4 AS BIGINT) AS literal_lines, CAST(2 AS BIGINT) AS other_lines FROM part""")
def literal_regions(spark, sf):
    """Lines in code fences, found by a native fold over the lines of a row."""
    text = "concat('# ', p_name, '\n', repeat('~', cast(3 + p_partkey % 3 as int)), '\n# not a heading\n```\n', repeat('~', cast(3 + p_partkey % 3 as int)), '\nafter\n')"
    rows = L.literal_state(each(table(spark, sf, "part"), "p_partkey", text))
    return rows.groupBy("doc_id").agg(F.count_if("literal").alias("literal_lines"), F.count_if(~F.col("literal")).alias("other_lines"))


@query("""
SELECT s_suppkey::BIGINT AS doc_id, s_name || ' = ' || s_nationkey AS value FROM supplier""")
def math_blocks(spark, sf):
    text = "concat('~~~math\n', s_name, ' = ', s_nationkey, '\n~~~\n')"
    return D.node_table(each(table(spark, sf, "supplier"), "s_suppkey", text)).where("type = 'mathBlock'").select("doc_id", "value")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, ' ' || n_name || chr(10) || n_regionkey || ' ' AS value FROM nation""")
def comments(spark, sf):
    text = "concat('<!-- ', n_name, '\n', n_regionkey, ' -->\n\ntext\n')"
    return D.node_table(each(table(spark, sf, "nation"), "n_nationkey", text)).where("type = 'commentBlock'").select("doc_id", "value")


@query("""
SELECT o_orderkey::BIGINT AS doc_id, 'syntax' AS category FROM orders WHERE o_orderkey % 10 = 0""")
def setext_errors(spark, sf):
    text = "concat('Order ', o_orderkey, '\n', case when o_orderkey % 10 <> 0 then 'plain' when o_orderkey % 20 = 0 then '=====' else '---' end, '\n')"
    return D.finding_table(each(table(spark, sf, "orders"), "o_orderkey", text)).where("severity = 'error'").select("doc_id", "category")


@query("""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
b AS (SELECT *, regexp_full_match(l, '[ \\t]*') AS blank FROM l),
o AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY n), true) AS opens FROM b),
r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM o)
SELECT doc_id, island::BIGINT AS island, min(n)::BIGINT AS first_line, count(*) AS n_lines, string_agg(trim(l), chr(10) ORDER BY n) AS paragraph
FROM r WHERE NOT blank GROUP BY doc_id, island""")
def paragraph_runs(spark, sf):
    """The raw lines of all documents, joined in runs between blank lines."""
    return L.paragraphs(L.quick_lines(table(spark, sf, "documents")))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, CAST(CASE WHEN n_nationkey % 6 >= 4 THEN 1 ELSE 0 END AS BIGINT) AS n FROM nation""")
def indent_advisory(spark, sf):
    docs = each(table(spark, sf, "nation"), "n_nationkey", "concat(repeat(' ', n_nationkey % 6), n_name, '\n')")
    found = D.finding_table(docs).where("category = 'advisory'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(0)).alias("n"))


# containers, lists, quotes


@query("""
SELECT r_regionkey::BIGINT AS doc_id, 'lined' AS form, split_part(r_name, ' ', 1) AS container_type, substr(r_name || ' no. ' || r_regionkey, length(split_part(r_name, ' ', 1)) + 2) AS container_title, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_children FROM region""")
def lined_containers(spark, sf):
    return _containers(spark, sf, "concat(r_name, ' no. ', r_regionkey, '\n____\n\n')", "'\n\n____\n'")


@query("""
SELECT r_regionkey::BIGINT AS doc_id, 'fenced' AS form, split_part(r_name, ' ', 1) AS container_type, substr(r_name || ' no. ' || r_regionkey, length(split_part(r_name, ' ', 1)) + 2) AS container_title, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_children FROM region""")
def fenced_containers(spark, sf):
    return _containers(spark, sf, "concat(':::: ', r_name, ' no. ', r_regionkey, '\n')", "'\n::::::\n'")


def _containers(spark, sf, before, after):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    nodes = D.node_table(joined(rows, "r_regionkey", "n_nationkey", "concat('Nation ', n_name)", "\n\n", before, after))
    tops = nodes.where("type = 'container'")
    kids = nodes.where("type = 'paragraph'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return tops.join(kids, ["doc_id", "node_id"]).select("doc_id", "form", "container_type", "container_title", "n_children")


@query("""
SELECT c_nationkey::BIGINT AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS item_no, c_name AS value FROM customer""")
def list_items(spark, sf):
    nodes = D.node_table(joined(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "concat('*  ', c_name)"))
    items = nodes.where("type = 'listItem'").select("doc_id", F.col("node_id").alias("i"), (F.col("pos") + 1).cast("bigint").alias("item_no"))
    paragraphs = nodes.where("type = 'paragraph'").select("doc_id", F.col("parent_id").alias("i"), F.col("node_id").alias("p"))
    texts = nodes.where("type = 'text'").select("doc_id", F.col("parent_id").alias("p"), "value")
    return items.join(paragraphs, ["doc_id", "i"]).join(texts, ["doc_id", "p"]).select("doc_id", "item_no", "value")


@query("""
SELECT c_nationkey::BIGINT AS doc_id, CASE WHEN c_acctbal < 0 THEN 'done' ELSE 'open' END AS task, count(*) AS n FROM customer GROUP BY ALL""")
def task_items(spark, sf):
    docs = joined(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "concat('- ', if(c_acctbal < 0, '[X] ', '[ ] '), c_name)")
    return D.node_table(docs).where("type = 'listItem'").groupBy("doc_id", "task").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_nationkey::BIGINT AS doc_id, c_mktsegment AS content, 'definition' AS kind FROM customer""")
def list_marker_lines(spark, sf):
    """List markers found line by line, natively."""
    docs = joined(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "concat(': ', c_mktsegment)")
    return L.list_markers(L.quick_lines(docs)).select("doc_id", "content", "kind")


@query("""
SELECT c_nationkey::BIGINT AS doc_id, CAST(c_custkey AS INTEGER) AS item_value FROM (
  SELECT *, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL AND c_custkey <> b + 1""")
def ordered_deviation(spark, sf):
    docs = joined(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "concat(c_custkey, ') ', c_name)")
    return D.node_table(docs).where("type = 'listItem' and item_value is not null").select("doc_id", "item_value")


@query("""SELECT c_nationkey::BIGINT AS doc_id, c_custkey::BIGINT AS number FROM customer""")
def item_numbers(spark, sf):
    """The visible number of every item, from the start, the values that deviate and the distance to them."""
    docs = joined(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "concat(c_custkey, '. ', c_name)")
    return R.ordinals(D.node_table(docs)).select("doc_id", "number")


@query("""SELECT p_partkey::BIGINT AS doc_id, 'definition' AS kind, CAST(2 AS BIGINT) AS n_items FROM part""")
def definition_items(spark, sf):
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", "concat(': ', p_name, '\n:   ', p_brand, '\n')"))
    items = nodes.where("type = 'listItem'").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return nodes.where("type = 'list'").join(items, ["doc_id", "node_id"]).select("doc_id", "kind", "n_items")


_NESTED = """concat('- ', n_name, '\n', repeat(' ', n_nationkey % 2 * 2 + 2), '- ', c, '\n', repeat(' ', n_nationkey % 2 * 2 + 4), '- deep')"""


@query("""
SELECT n_regionkey::BIGINT AS doc_id, d.depth::INTEGER AS list_depth, count(*) AS n_items FROM nation, (SELECT unnest([1, 2, 3]) AS depth) d GROUP BY ALL""")
def nested_lists(spark, sf):
    """Items by nesting depth; nested markers stand at two or four columns."""
    rows = table(spark, sf, "nation").withColumn("c", F.lit("inner"))
    nodes = D.node_table(joined(rows, "n_regionkey", "n_nationkey", _NESTED))
    items = nodes.where("type = 'listItem'").select("doc_id", "node_id", "depth")
    return items.groupBy("doc_id", ((F.col("depth")) / 2).cast("int").alias("list_depth")).agg(F.count(F.lit(1)).alias("n_items"))


@query("""
SELECT conv_id::BIGINT AS doc_id, CAST((rn - 1) % 3 + 1 AS INTEGER) AS quote_level, count(*) AS n_blocks FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY ALL""")
def quote_levels(spark, sf):
    docs = joined(_turns(spark, sf), "conv_id", "rn", "concat(repeat('>', (rn - 1) % 3 + 1), if(rn % 2 = 0, ' ', ''), 'turn ', rn, ' ', role)")
    nodes = D.node_table(docs).where("quote_level is not null")
    return nodes.groupBy("doc_id", "quote_level").agg(F.count(F.lit(1)).alias("n_blocks"))


def _turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


@query("""
SELECT conv_id::BIGINT AS doc_id, CAST((rn - 1) % 3 + 1 AS BIGINT) AS depth, 'turn ' || rn AS content FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)""")
def quote_lines(spark, sf):
    docs = joined(_turns(spark, sf), "conv_id", "rn", "concat(repeat('> ', (rn - 1) % 3 + 1), 'turn ', rn)")
    return L.quote_depths(L.quick_lines(docs)).select("doc_id", "depth", "content")


@query("""SELECT conv_id::BIGINT * 1000 + turn AS doc_id, role AS value FROM conversations""")
def quote_attribution(spark, sf):
    docs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr("concat('> said in turn ', turn, '\n-- ', role, '\n')").alias("text"))
    nodes = D.node_table(docs)
    return nodes.where("type = 'text' and slot = 'attribution'").select("doc_id", "value")


# tables


_ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_NUMBERED_SQL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"


def _items(spark, sf):
    return table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER)))


@query(f"""
SELECT l_orderkey::BIGINT AS doc_id, rn::BIGINT AS row_no, c.col::BIGINT AS col_no, CASE c.col WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_returnflag ELSE l_linestatus END AS cell
FROM (SELECT *, {_NUMBERED_SQL} AS rn FROM lineitem), (SELECT unnest([1, 2, 3]) AS col) c""")
def table_cells(spark, sf):
    """Cells of one pipe table for each order, natively."""
    rows = L.table_rows(L.quick_lines(_order_tables(spark, sf)))
    first = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.select("doc_id", F.dense_rank().over(first).cast("bigint").alias("row_no"), "col_no", "cell")


def _order_tables(spark, sf):
    head = "'| part | flag | status |\n|:---|:---:|---:|\n'"
    return joined(_items(spark, sf), "l_orderkey", "rn", "concat('| ', l_partkey, ' | ', l_returnflag, ' | ', l_linestatus, ' |')", "\n", head, "'\n'")


@query(f"""
SELECT l_orderkey::BIGINT AS doc_id, count(*) + 1 AS n_rows, 3 * count(*) + 3 AS n_cells FROM lineitem GROUP BY ALL""")
def table_nodes(spark, sf):
    nodes = D.node_table(_order_tables(spark, sf))
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("type") == "tableRow").alias("n_rows"), F.count_if(F.col("type") == "tableCell").alias("n_cells"))


@query("""
SELECT DISTINCT l_orderkey::BIGINT AS doc_id, c.col::BIGINT AS col_no, CASE c.col WHEN 1 THEN 'left' WHEN 2 THEN 'center' ELSE 'right' END AS alignment FROM lineitem, (SELECT unnest([1, 2, 3]) AS col) c""")
def table_alignment(spark, sf):
    nodes = D.node_table(_order_tables(spark, sf)).where("type = 'table'")
    return nodes.select("doc_id", F.posexplode("alignments").alias("p", "alignment")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("col_no"), "alignment")


@query("""
SELECT DISTINCT l_orderkey::BIGINT AS doc_id, c.col::BIGINT AS col_no, CASE c.col WHEN 1 THEN 'left' WHEN 2 THEN 'center' ELSE 'right' END AS alignment FROM lineitem, (SELECT unnest([1, 2, 3]) AS col) c""")
def separator_alignments(spark, sf):
    """Alignments from the separator lines of canonical tables, natively."""
    rows = L.quick_lines(_order_tables(spark, sf)).withColumn("line", F.replace("line", F.lit("|:---|:---:|---:|"), F.lit("| :--- | :---: | ---: |")))
    return L.alignments(rows).select("doc_id", "col_no", "alignment")


@query("""SELECT p_partkey::BIGINT AS doc_id, p_brand || '|' || p_size AS value FROM part""")
def table_escaped_pipes(spark, sf):
    r"""A pipe behind a backslash is part of its cell, in text and in code."""
    text = r"concat('| a | b |\n|---|---|\n| ', p_brand, '\\|', p_size, ' | `', p_brand, '\\|', p_size, '` |\n')"
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", text))
    return nodes.where("type = 'inlineCode'").select("doc_id", "value")


@query("""SELECT o_orderkey::BIGINT AS doc_id, 'table row cell count differs from the header' AS message FROM orders WHERE o_orderkey % 7 = 0""")
def table_ragged_errors(spark, sf):
    text = "concat('| a | b |\n|---|---|\n| ', o_orderkey, if(o_orderkey % 7 = 0, '', concat(' | ', o_custkey)), ' |\n')"
    return D.finding_table(each(table(spark, sf, "orders"), "o_orderkey", text)).where("severity = 'error'").select("doc_id", "message")


# ids


@query("""SELECT o_custkey::BIGINT AS doc_id, count(*) AS n_ids FROM orders GROUP BY ALL""")
def block_ids(spark, sf):
    docs = joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "concat('Order ', o_orderkey, '\n{#o', o_orderkey, '}')", "\n\n")
    return D.node_table(docs).where("block_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_ids"))


@query("""SELECT o_custkey::BIGINT AS doc_id, o_orderstatus AS block_id, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark, sf):
    docs = joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "concat('## Order ', o_orderkey, ' {#', o_orderstatus, '}')", "\n\n")
    return R.duplicate_ids(D.node_table(docs))


@query("""SELECT n_nationkey::BIGINT AS doc_id, 'semantic' AS category FROM nation WHERE n_nationkey % 3 < 2""")
def id_scope_errors(spark, sf):
    text = "concat(element_at(array('> ', '- ', ''), n_nationkey % 3 + 1), n_name, '\n', element_at(array('> ', '  ', ''), n_nationkey % 3 + 1), '{#n', n_nationkey, '}\n')"
    return D.finding_table(each(table(spark, sf, "nation"), "n_nationkey", text)).where("severity = 'error'").select("doc_id", "category")


# inline


_KINDS = ("strong", "em", "deletion", "obsolete", "insert", "mark")


@query("""
SELECT c_custkey::BIGINT AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'strong' WHEN 1 THEN 'em' WHEN 2 THEN 'deletion' WHEN 3 THEN 'obsolete' WHEN 4 THEN 'insert' ELSE 'mark' END AS type, c_mktsegment AS value FROM customer""")
def inline_emphasis(spark, sf):
    mark = "element_at(array('__', '_', '~~', '--', '++', '=='), cast(c_custkey % 6 + 1 as int))"
    nodes = D.node_table(each(table(spark, sf, "customer"), "c_custkey", f"concat('In ', {mark}, c_mktsegment, {mark}, ' of ', c_name, '.\n')"))
    spans = nodes.where(F.col("type").isin(*_KINDS)).select("doc_id", "type", F.col("node_id").alias("s"))
    return spans.join(nodes.where("type = 'text'").select("doc_id", F.col("parent_id").alias("s"), "value"), ["doc_id", "s"]).select("doc_id", "type", "value")


@query("""SELECT p_partkey::BIGINT AS doc_id, p_type || ' `' || p_size AS value FROM part""")
def code_spans(spark, sf):
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", "concat('Code ``', p_type, ' `', p_size, '`` here.\n')"))
    return nodes.where("type = 'inlineCode'").select("doc_id", "value")


@query("""SELECT p_partkey::BIGINT AS doc_id, 'x_' || p_size || ' < ' || p_partkey AS value FROM part""")
def inline_math(spark, sf):
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", "concat('So $`x_', p_size, ' < ', p_partkey, '`$ holds.\n')"))
    return nodes.where("type = 'inlineMath'").select("doc_id", "value")


@query("""SELECT s_suppkey::BIGINT AS doc_id, 'https://s.example/(' || s_suppkey || ')?n=' || s_nationkey || '&x' AS dest, 'No "' || s_nationkey || '"' AS title FROM supplier""")
def links(spark, sf):
    text = r"""concat('See [', s_name, '](https://s.example/(', s_suppkey, ')?n=', s_nationkey, '&amp;x \'No "', s_nationkey, '"\').\n')"""
    return D.node_table(each(table(spark, sf, "supplier"), "s_suppkey", text)).where("type = 'link'").select("doc_id", "dest", "title")


@query("""SELECT s_suppkey::BIGINT AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'imageBlock' ELSE 'inlineImage' END AS type, 'i/' || s_suppkey || ' a.png' AS dest FROM supplier""")
def images(spark, sf):
    text = "concat(if(s_suppkey % 2 = 0, '', 'At '), '![', s_name, '](<i/', s_suppkey, ' a.png>)\n')"
    return D.node_table(each(table(spark, sf, "supplier"), "s_suppkey", text)).where("dest is not null").select("doc_id", "type", "dest")


@query("""
SELECT page_id::BIGINT AS doc_id, form, 'url' AS kind, CASE WHEN form = 'angle' THEN url ELSE regexp_replace(regexp_replace(url, '[?!.,:*_~]+$', ''), '&[0-9A-Za-z]+;$', '') END AS value
FROM pages, (VALUES ('angle'), ('bare')) f(form)""")
def all_autolinks(spark, sf):
    """Every page's url in angle brackets and bare before a full stop; the bare form ends before trailing punctuation."""
    pages = table(spark, sf, "pages")
    forms = [D.node_table(each(pages, "page_id", text)).where("type = 'autolink'").select("doc_id", F.lit(form).alias("form"), "kind", "value")
             for form, text in (("angle", "concat('At <', url, '>\n')"), ("bare", "concat('At ', url, '.\n')"))]
    return forms[0].unionByName(forms[1])


@query("""SELECT page_id::BIGINT AS doc_id, 'a<b & "c" © ' || chr(8364) || ' &nosuch; ' || page_id AS value FROM pages""")
def entities(spark, sf):
    nodes = D.node_table(each(table(spark, sf, "pages"), "page_id", "concat('a&lt;b &amp; &quot;c&quot; &copy; &#8364; &nosuch; ', page_id, '\n')"))
    return nodes.where("type = 'text'").select("doc_id", "value")


@query("""SELECT p_partkey::BIGINT AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'sup' ELSE 'sub' END AS type, p_size::VARCHAR AS value FROM part""")
def sup_sub(spark, sf):
    text = "concat('m', if(p_partkey % 2 = 0, '^', '~'), p_size, if(p_partkey % 2 = 0, '^', '~'), ' of it\n')"
    return D.node_table(each(table(spark, sf, "part"), "p_partkey", text)).where("type in ('sup', 'sub')").select("doc_id", "type", "value")


@query("""SELECT r_regionkey::BIGINT AS doc_id, CAST(2 AS BIGINT) AS n FROM region""")
def tag_like_advisory(spark, sf):
    found = D.finding_table(each(table(spark, sf, "region"), "r_regionkey", "concat('A <div>', r_name, '</div> tag.\n')"))
    return found.where("category = 'advisory'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# resources and grids


@query("""
SELECT p_partkey::BIGINT AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'embed' ELSE 'download' END || 'Block' AS type, 'm/' || p_partkey AS dest, 'de-at' AS attr_lang, p_size::VARCHAR AS size FROM part""")
def resources(spark, sf):
    text = "concat('<m ', element_at(array('video', 'audio', 'embed', 'download'), cast(p_partkey % 4 + 1 as int)), ' data-size=', p_size, ' lang=\"de-AT\">[', p_name, '](m/', p_partkey, ')</m>\n')"
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", text)).where("dest is not null")
    return nodes.select("doc_id", "type", "dest", "attr_lang", F.element_at("data_attrs", "size").alias("size"))


@query("""SELECT p_partkey::BIGINT AS doc_id, p_brand AS attr_group, 'Seen in ' || p_size AS caption FROM part""")
def resource_captions(spark, sf):
    text = r"concat('<m group=\"', p_brand, '\">![', p_name, '](p.png)\\\n*Seen in ', p_size, '*</m>\n')".replace("\\\\\\n", "\\\\\n")
    nodes = D.node_table(each(table(spark, sf, "part"), "p_partkey", text))
    captions = nodes.where("slot = 'caption' and type = 'text'").select("doc_id", F.col("parent_id").alias("node_id"), F.col("value").alias("caption"))
    return nodes.where("type = 'imageBlock'").join(captions, ["doc_id", "node_id"]).select("doc_id", "attr_group", "caption")


@query("""
SELECT tag, ok FROM (VALUES ('de', true), ('de-AT', true), ('zh-Hant-TW', true), ('en-a-bbb-x-a', true), ('x-private', true), ('sl-rozaj-biske', true), ('', false), ('de-', false), ('d', false), ('en-a-bb-a-cc', false), ('abcdefghi', false), ('en-x', false), ('zh-cmn-Hans-CN', true), ('de-1996', true), ('1a', false)) t(tag, ok)""")
def bcp47(spark, sf):
    tags = "de de-AT zh-Hant-TW en-a-bbb-x-a x-private sl-rozaj-biske  de- d en-a-bb-a-cc abcdefghi en-x zh-cmn-Hans-CN de-1996 1a".split(" ")
    return spark.createDataFrame([(t,) for t in tags], "tag string").select("tag", language_tag_ok(F.col("tag")).alias("ok"))


_GRID = """concat('::: grid\n', a, '\n--\n', b, '\n::\n', n_name, '\n--\n', '<', '\n==\n', '^', '\n--\n', '<', '\n==\nlast\n--\n', n_nationkey, '\n:::\n')"""


@query("""
SELECT n_nationkey::BIGINT AS doc_id, g.part, g.r::BIGINT AS r, g.c::BIGINT AS c, g.high::INTEGER AS row_span, g.wide::INTEGER AS col_span FROM nation,
(VALUES ('header', 0, 1, NULL, NULL), ('header', 0, 2, NULL, NULL), ('rows', 0, 1, 2, 2), ('rows', 2, 1, NULL, NULL), ('rows', 2, 2, NULL, NULL)) g(part, r, c, high, wide)""")
def grid_geometry(spark, sf):
    docs = each(table(spark, sf, "nation").selectExpr("*", "'a' as a", "'b' as b"), "n_nationkey", _GRID)
    nodes = D.node_table(docs)
    rows = nodes.where("type = 'gridRow'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("slot").alias("part"), F.col("pos").cast("bigint").alias("r"))
    cells = nodes.where("type = 'gridCell'").select("doc_id", "parent_id", F.col("grid_col").cast("bigint").alias("c"), "row_span", "col_span")
    return cells.join(rows, ["doc_id", "parent_id"]).select("doc_id", "part", "r", "c", "row_span", "col_span")


@query("""SELECT n_nationkey::BIGINT AS doc_id, CAST(8 AS BIGINT) AS n_slots, CAST(0 AS BIGINT) AS n_bad FROM nation""")
def grid_slots(spark, sf):
    """Every slot is covered once: anchors exploded over their spans."""
    nodes = D.node_table(each(table(spark, sf, "nation").selectExpr("*", "'a' as a", "'b' as b"), "n_nationkey", _GRID))
    held = V.grid_slots(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_slots"))
    bad = V.grid_violations(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    return held.join(bad, "doc_id", "left").select("doc_id", "n_slots", F.coalesce("m", F.lit(0)).alias("n_bad"))


@query("""
SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 'rowspan in first row' WHEN 1 THEN 'colspan in first column' WHEN 2 THEN 'ragged grid' ELSE 'non-rectangular grid span' END AS message FROM nation""")
def grid_errors(spark, sf):
    bodies = "element_at(array('^\n--\nb\n==\nc\n--\nd', 'a\n--\nb\n==\n<\n--\nd', 'a\n--\nb\n==\nc', 'a\n--\n<\n==\n^\n--\nd'), n_nationkey % 4 + 1)"
    docs = each(table(spark, sf, "nation"), "n_nationkey", f"concat(':::\n', {bodies}, '\n:::\n')")
    return D.finding_table(docs).where("seq = 0").select("doc_id", "message")  # the first fault is the verdict


# footnotes and anchors


def _notes(spark, sf, keep="true", twice="false"):
    """Orders that refer to parts in the order of their items, and define what ``keep`` leaves."""
    rows = _items(spark, sf)
    refs = joined(rows, "l_orderkey", "rn", "concat('[^p', l_partkey, ']')", " and ", "'Parts '", "'.\n\n'")
    parts = rows.select("l_orderkey", "l_partkey").distinct().where(keep)
    notes = joined(parts, "l_orderkey", "concat('p', l_partkey)", f"concat('[^p', l_partkey, ']: Part ', l_partkey, if({twice}, concat('\n[^p', l_partkey, ']: again'), ''))")
    extra = F.when(F.col("doc_id") % 3 == 0, "\n[^zz]: never used").otherwise("")
    return refs.join(notes.withColumnRenamed("text", "notes"), "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("notes", F.lit("")), extra, F.lit("\n")).alias("text"))


@query(f"""
WITH r AS (SELECT l_orderkey AS doc_id, 'p' || l_partkey AS identifier, min(rn) AS f, count(*) AS n FROM (SELECT *, {_NUMBERED_SQL} AS rn FROM lineitem) GROUP BY ALL
UNION ALL SELECT DISTINCT l_orderkey, 'zz', NULL, 0 FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT doc_id::BIGINT AS doc_id, identifier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f NULLS LAST, identifier) AS BIGINT) AS position, n::BIGINT AS n_refs FROM r""")
def footnote_order(spark, sf):
    return R.footnote_order(D.node_table(_notes(spark, sf)))


@query("""SELECT DISTINCT l_orderkey::BIGINT AS doc_id, 'p' || l_partkey AS identifier FROM lineitem WHERE l_partkey % 5 = 0""")
def footnote_dangling(spark, sf):
    return R.dangling_references(D.node_table(_notes(spark, sf, keep="l_partkey % 5 <> 0"))).select("doc_id", "identifier")


@query("""SELECT DISTINCT l_orderkey::BIGINT AS doc_id, 'zz' AS identifier FROM lineitem WHERE l_orderkey % 3 = 0""")
def footnote_unused(spark, sf):
    return R.unused_definitions(D.node_table(_notes(spark, sf)))


@query("""SELECT l_orderkey::BIGINT AS doc_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey % 11 = 0 GROUP BY ALL""")
def footnote_duplicates(spark, sf):
    found = D.finding_table(_notes(spark, sf, twice="l_partkey % 11 = 0")).where("message like 'duplicate footnote%'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey::BIGINT AS doc_id, 'o' || o_orderkey AS block_id FROM orders WHERE o_orderkey % 4 = 0""")
def anchor_dangling(spark, sf):
    part = "concat('[go](#o', o_orderkey, ') there.', if(o_orderkey % 4 = 0, '', concat('\n{#o', o_orderkey, '}')))"
    return R.dangling_anchors(D.node_table(joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", part, "\n\n")))


# validation


@query("""SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'value out of range' ELSE 'missing field' END AS rule FROM nation""")
def shape_violations(spark, sf):
    """One broken heading in each tree: a level of nine or none."""
    nodes = D.node_table(each(table(spark, sf, "nation"), "n_nationkey", "concat('# ', n_name, '\n')"))
    broken = nodes.withColumn("level", F.when((F.col("type") == "heading") & (F.col("doc_id") % 2 == 0), 9).when(F.col("type") != "heading", F.col("level")).cast("int"))
    return V.shape_violations(broken).select("doc_id", "rule")


@query("""SELECT n_nationkey::BIGINT AS doc_id, 'white space at an edge' AS rule FROM nation WHERE n_nationkey % 3 = 0""")
def whitespace_violations(spark, sf):
    nodes = D.node_table(each(table(spark, sf, "nation"), "n_nationkey", "concat(n_name, '\n')"))
    broken = nodes.withColumn("value", F.when((F.col("type") == "text") & (F.col("doc_id") % 3 == 0), F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return V.whitespace_violations(broken).select("doc_id", "rule")


@query("""SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) AS n_docs, CAST(0 AS BIGINT) AS n_violations""")
def rule_violations(spark, sf):
    """No rule is broken by what the reader makes of a mixed corpus, whose nodes are stored once for all rules; the rules run one after another."""
    nodes = stored(D.node_table(_mixed(spark, sf)), "nodes")
    both = V.stored_violations(nodes).select("doc_id", F.lit(1).alias("v")).unionByName(nodes.where("parent_id is null").select("doc_id", F.lit(0).alias("v")))
    return both.agg(F.count_if(F.col("v") == 0).alias("n_docs"), F.count_if(F.col("v") == 1).alias("n_violations"))


@query("""SELECT c_custkey::BIGINT AS doc_id, 'field of another type' AS rule FROM customer WHERE c_custkey % 3 = 0""")
def closed_violations(spark, sf):
    """A paragraph with a heading's field in a third of the trees."""
    nodes = D.node_table(each(table(spark, sf, "customer"), "c_custkey", "concat('# ', c_name, '\n\n', c_mktsegment, '\n')"))
    broken = nodes.withColumn("level", F.when((F.col("type") == "paragraph") & (F.col("doc_id") % 3 == 0), 2).otherwise(F.col("level")))
    return V.closed_violations(broken).select("doc_id", "rule")


@query("""SELECT c_custkey::BIGINT AS doc_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 20 < 7 THEN 'frame budget' ELSE 'node budget' END AS rule FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 20 > 10""")
def budget_violations(spark, sf):
    """Budgets of 22 nodes and 4 levels, over documents of one paragraph for each unit of their size, some with a nested list."""
    text = "concat(repeat('word\n\n', cast(c_custkey % 20 as int)), if(c_custkey % 2 = 0, '- a\n  - b\n', 'end\n'))"
    return V.budget_violations(D.node_table(each(table(spark, sf, "customer"), "c_custkey", text)), 22, 4).select("doc_id", "rule")


@query("""SELECT s_suppkey::BIGINT AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'delimiter beside a word' ELSE 'same kind inside' END AS rule FROM supplier WHERE s_suppkey % 3 < 2""")
def span_violations(spark, sf):
    """Marks that touch a word in a third of the trees, and emphasis right inside emphasis in another."""
    nodes = D.node_table(each(table(spark, sf, "supplier"), "s_suppkey", "concat('In ==', s_name, '== *so __on__* and\n')"))
    text = (F.col("type") == "text") & (F.col("pos") == 0) & (F.col("depth") == 2)
    broken = nodes.withColumn("value", F.when(text & (F.col("doc_id") % 3 == 0), F.lit("In")).otherwise(F.col("value")))
    broken = broken.withColumn("type", F.when((F.col("type") == "strong") & (F.col("doc_id") % 3 == 1), F.lit("em")).otherwise(F.col("type")))
    return V.flank_violations(broken).select("doc_id", "rule").unionByName(V.nesting_violations(broken).select("doc_id", "rule"))


@query("""SELECT o_orderkey::BIGINT AS doc_id, 'o' || o_orderkey AS block_id FROM orders WHERE o_orderkey % 2 = 0""")
def scope_violations(spark, sf):
    """Ids put on paragraphs of half the trees, where the paragraph lies in a list item."""
    nodes = D.node_table(each(table(spark, sf, "orders"), "o_orderkey", "concat('- ', o_orderstatus, '\n\ntext\n')"))
    broken = nodes.withColumn("block_id", F.when((F.col("type") == "paragraph") & ((F.col("doc_id") % 2 == 0) | (F.col("depth") == 1)), F.concat(F.lit("o"), "doc_id")))
    return R.scope_violations(broken).select("doc_id", "block_id")


# canonical texts


_TOLERANT = """concat('Order ', o_orderkey, '\n\n*  one\n*  two\n\n', repeat('~', 4), 'sql\nselect\n', repeat('~', 5), '\n\n***\n\n##  Status   ', o_orderstatus, ' ##\n\n>quoted\n>text\n\n a|b\n-|:-:\n', o_custkey, '|x\n')"""
_CANONICAL = """concat('Order ', o_orderkey, '\n\n- one\n- two\n\n```sql\nselect\n```\n\n---\n\n## Status   ', o_orderstatus, '\n\n> quoted\n> text\n\n| a | b |\n| --- | :---: |\n| ', o_custkey, ' | x |\n')"""


@query("""
SELECT o_orderkey::BIGINT AS doc_id, 'Order ' || o_orderkey || E'\\n\\n- one\\n- two\\n\\n```sql\\nselect\\n```\\n\\n---\\n\\n## Status   ' || o_orderstatus || E'\\n\\n> quoted\\n> text\\n\\n| a | b |\\n| --- | :---: |\\n| ' || o_custkey || E' | x |\\n' AS canonical FROM orders""")
def canonical_text(spark, sf):
    return D.parse_documents(each(table(spark, sf, "orders"), "o_orderkey", _TOLERANT), nodes=False).select("doc_id", "canonical")


@query("""SELECT o_orderkey::BIGINT AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'canonical' ELSE 'noncanonical' END AS verdict FROM orders""")
def canonical_verdict(spark, sf):
    return D.canonical_verdicts(each(table(spark, sf, "orders"), "o_orderkey", f"if(o_orderkey % 2 = 0, {_CANONICAL}, {_TOLERANT})")).select("doc_id", "verdict")


def canonical_groups(spark, sf):
    """All documents of one meaning, whatever they hold: the canonical text is what the grammar makes of each."""
    return R.semantic_groups(D.parse_documents(table(spark, sf, "documents"), nodes=False)).select("first_doc", "n_docs")


UNSTATED["canonical_groups"] = canonical_groups


@query("""SELECT o_orderkey::BIGINT AS doc_id FROM orders""")
def semantic_equality_pairs(spark, sf):
    """Two spellings of each order meet on the hash of their canonical text."""
    orders = table(spark, sf, "orders")
    a, b = (D.parse_documents(each(orders, "o_orderkey", t), nodes=False).select("doc_id", "canonical_hash") for t in (_TOLERANT, _CANONICAL))
    return a.join(b, ["doc_id", "canonical_hash"]).select("doc_id")


@query("""SELECT o_orderkey::BIGINT AS doc_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS added_ids FROM orders""")
def adopt_ids(spark, sf):
    text = "concat('# Order ', o_orderkey, if(o_orderkey % 2 = 0, ' {#own}', ''), '\n\ntext\n\n- item\n\n<!-- none -->\n')"
    return D.adopt_documents(each(table(spark, sf, "orders"), "o_orderkey", text)).select("doc_id", "added_ids")


@query("""SELECT o_orderkey::BIGINT AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS exit_code FROM orders""")
def command_check(spark, sf):
    text = "concat('Order ', o_orderkey, if(o_orderkey % 3 = 0, ' `open', ''), '\n')"
    return D.run_command(each(table(spark, sf, "orders"), "o_orderkey", text), "check").select("doc_id", "exit_code")


# laws and reports


def _mixed(spark, sf):
    """A corpus of several kinds of documents with distinct ids."""
    orders, nation, part = (table(spark, sf, t) for t in ("orders", "nation", "part"))
    grids = each(nation.selectExpr("*", "'a' as a", "'b' as b"), "n_nationkey", _GRID)
    parts = each(part.withColumn("k", F.col("p_partkey") + 1_000_000), "k", "concat('<m video data-size=', p_size, '>[', p_name, '](m/', p_partkey, ')</m>\n\nIn **', p_brand, '** and `', p_type, '`[^1], see http://x.example/a_b.\n\n[^1]: _note_ &amp; more\n')")
    tolerant = each(orders.withColumn("k", F.col("o_orderkey") + 100_000_000), "k", _TOLERANT)
    return tolerant.unionByName(grids).unionByName(parts)


@query("SELECT CAST(0 AS BIGINT) AS law_roundtrip, CAST(0 AS BIGINT) AS law_idempotent, CAST(0 AS BIGINT) AS law_strict, CAST(0 AS BIGINT) AS not_ok")
def laws(spark, sf):
    """Violations of the laws: the canonical text means the same, is its own canonical text, and passes strictly."""
    return P.law_report(_mixed(spark, sf)).select("law_roundtrip", "law_idempotent", "law_strict", "not_ok")


@query("""
SELECT type, count(*) AS n FROM (SELECT unnest(['document', 'heading', 'text', 'paragraph', 'text']) AS type FROM nation) GROUP BY ALL""")
def node_histogram(spark, sf):
    return R.histogram(D.node_table(each(table(spark, sf, "nation"), "n_nationkey", "concat('# ', n_name, '\n\ntext\n')")))


@query("""SELECT * FROM (VALUES ('heading', 25::BIGINT, 0::BIGINT), ('horizontalRule', 0::BIGINT, 25::BIGINT), ('text', 50::BIGINT, 25::BIGINT)) t(type, n_left, n_right)""")
def histogram_diff(spark, sf):
    nation = table(spark, sf, "nation")
    a = D.node_table(each(nation, "n_nationkey", "concat('# ', n_name, '\n\ntext\n')"))
    return R.histogram_difference(a, D.node_table(each(nation, "n_nationkey", "'---\n\ntext\n'")))


@query("""SELECT * FROM (VALUES ('list', 50::BIGINT), ('listItem', 75::BIGINT), ('paragraph', 75::BIGINT), ('text', 75::BIGINT)) t(type, n)""")
def descendant_types(spark, sf):
    rows = table(spark, sf, "nation").withColumn("c", F.lit("inner"))
    return R.descendant_types(D.node_table(joined(rows, "n_regionkey", "n_nationkey", _NESTED)), "list")


@query("""
SELECT status, kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'invalid' ELSE 'ok' END AS status, o_orderstatus AS kind FROM orders) GROUP BY ROLLUP(status, kind)""")
def compat_rollup(spark, sf):
    """Totals of verdicts by kind, by verdict and over all."""
    orders = table(spark, sf, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('Order ', o_orderkey, if(o_orderkey % 3 = 0, ' `open', ''), '\n')").alias("text"))
    parsed = D.parse_documents(docs, nodes=False).select("doc_id", "status").join(orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("kind")), "doc_id")
    return parsed.rollup("status", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT status, kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'invalid' ELSE 'ok' END AS status, o_orderstatus AS kind FROM orders) GROUP BY CUBE(status, kind)""")
def verdict_cube(spark, sf):
    """Totals of verdicts by every combination of verdict and kind."""
    orders = table(spark, sf, "orders")
    docs = orders.select(F.concat_ws("/", "o_orderstatus", "o_orderkey").alias("doc_id"), F.expr("concat('Order ', o_orderkey, if(o_orderkey % 3 = 0, ' `open', ''), '\n')").alias("text"))
    parsed = D.parse_documents(docs, nodes=False).select("status", F.substring_index("doc_id", "/", 1).alias("kind"))
    return parsed.cube("status", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey::BIGINT AS doc_id, 3 * count(*) + 3 AS n_cells FROM lineitem GROUP BY l_orderkey ORDER BY n_cells DESC, doc_id LIMIT 20""")
def largest_tables(spark, sf):
    """The twenty documents with the most table cells."""
    cells = D.node_table(_order_tables(spark, sf)).where("type = 'tableCell'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return cells.orderBy(F.desc("n_cells"), "doc_id").limit(20)


@query("""SELECT 'both' AS side, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'left', count(*) FROM orders WHERE o_orderkey % 2 <> 0""")
def shared_meanings(spark, sf):
    """Canonical texts that two spellings of a corpus have in common, and those of the first alone."""
    orders = table(spark, sf, "orders")
    a = D.parse_documents(each(orders, "o_orderkey", _TOLERANT), nodes=False).select("canonical")
    b = D.parse_documents(each(orders.where("o_orderkey % 2 = 0"), "o_orderkey", _CANONICAL), nodes=False).select("canonical")
    return R.shared_values(a, b, "canonical")


@query("""SELECT o_orderkey::BIGINT AS doc_id, CASE WHEN o_orderkey % 4 = 2 THEN 'syntax' ELSE 'semantic' END AS category, CASE WHEN o_orderkey % 4 = 2 THEN 0 ELSE length('Order ' || o_orderkey) + 1 END::BIGINT AS at FROM orders WHERE o_orderkey % 4 > 1""")
def finding_records(spark, sf):
    """Findings as JSON records, read again by path: the first error of each document and where it stands."""
    text = "concat('Order ', o_orderkey, element_at(array('', '\n\n***', ' `open', ' [^no]'), cast(o_orderkey % 4 + 1 as int)), '\n')"
    found = D.finding_table(each(table(spark, sf, "orders"), "o_orderkey", text)).where("severity = 'error'")
    records = found.select("doc_id", F.to_json(F.struct("category", F.struct("start_off", "end_off").alias("span"))).alias("j"))
    return records.select("doc_id", F.get_json_object("j", "$.category").alias("category"), F.get_json_object("j", "$.span.start_off").cast("bigint").alias("at"))


@query("""
SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'canonical' WHEN o_orderkey % 4 = 1 THEN 'noncanonical' WHEN o_orderkey % 4 = 2 THEN 'syntax' ELSE 'semantic' END AS outcome, count(*) AS n FROM orders GROUP BY ALL""")
def triage_buckets(spark, sf):
    text = "concat('Order ', o_orderkey, element_at(array('', '\n\n***', ' `open', ' [^no]'), cast(o_orderkey % 4 + 1 as int)), '\n')"
    return P.triage(each(table(spark, sf, "orders"), "o_orderkey", text))


@query("""
SELECT category, count(*) AS n FROM (SELECT CASE r WHEN 0 THEN 'normalised' WHEN 1 THEN 'resolved' WHEN 2 THEN 'content-dropped' END AS category FROM (SELECT s_suppkey % 3 AS r FROM supplier)) GROUP BY ROLLUP(category)""")
def import_loss_report(spark, sf):
    text = "concat(element_at(array(concat(s_name, '\n====='), concat('See [', s_name, '][k].\n\n[k]: http://k.example'), concat('<div>', s_name, '</div>\n\ntext')), cast(s_suppkey % 3 + 1 as int)), '\n')"
    return P.imported(each(table(spark, sf, "supplier"), "s_suppkey", text)).select(F.explode("losses.category").alias("category")).rollup("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey::BIGINT AS doc_id, 'See [' || s_name || '](http://k.example/' || s_suppkey || E').\\n' AS canonical FROM supplier""")
def reference_links(spark, sf):
    text = "concat('See [', s_name, '][ Key  ', s_nationkey, '].\n\n[key ', s_nationkey, ']: http://k.example/', s_suppkey, '\n')"
    return P.imported(each(table(spark, sf, "supplier"), "s_suppkey", text)).select("doc_id", "canonical")


@query(r"""
WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part)
SELECT p_partkey::BIGINT AS doc_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)""")
def heading_slugs(spark, sf):
    """Slugs of part types, numbered where they repeat."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("doc_id"), slug(F.col("p_type")).alias("s"))
    return R.numbered(rows, "s", "doc_id").select("doc_id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat_ws("-", "s", "n")).alias("slug"))


@query("SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS law_roundtrip, CAST(0 AS BIGINT) AS law_idempotent, CAST(0 AS BIGINT) AS law_strict FROM customer")
def soak_summary(spark, sf):
    """A seeded random document for each customer held against the laws; invalid ones only have to be read to the end."""
    return P.law_report(P.soak_documents(table(spark, sf, "customer"), "c_custkey")).select("n_docs", "law_roundtrip", "law_idempotent", "law_strict")


@query("SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS law_closure FROM customer")
def tree_soak(spark, sf):
    """A seeded random tree for each customer, written and read back."""
    return P.tree_report(table(spark, sf, "customer"), "c_custkey")


@query("""
SELECT (SELECT count(*) FROM orders) AS n_docs, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS n_ok, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n_invalid""")
def corpus_evidence(spark, sf):
    text = "concat('Order ', o_orderkey, if(o_orderkey % 3 = 0, ' `open', ''), '\n')"
    return P.evidence(each(table(spark, sf, "orders"), "o_orderkey", text)).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "invalid").alias("n_invalid"))


# the tables' own texts

_TEXTS = (("benchmark", "item_id", "text"), ("conversations", "conv_id", "text"), ("documents", "doc_id", "text"), ("pages", "page_id", "html"))
_COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t, _, _ in _TEXTS)


def _texts(spark, sf):
    """The texts of four tables under the name of each: prose, turns, test questions and raw web pages."""
    parts = [table(spark, sf, t).select(F.lit(t).alias("doc_id"), F.col(c).alias("text")) for t, _, c in _TEXTS]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT source, n AS n_docs, CAST(0 AS BIGINT) AS law_roundtrip, CAST(0 AS BIGINT) AS law_idempotent, CAST(0 AS BIGINT) AS law_strict FROM ({_COUNTED})")
def corpus_laws(spark, sf):
    """Every text of four tables is read, and what is valid is written and read again: violations of the laws."""
    return P.laws_held(_texts(spark, sf)).groupBy(F.col("doc_id").alias("source")).agg(*P.law_counts()).select("source", "n_docs", "law_roundtrip", "law_idempotent", "law_strict")


@query(f"SELECT source, n AS n_docs, CAST(0 AS BIGINT) AS n_unstable FROM ({_COUNTED})")
def import_laws(spark, sf):
    """Every text of four tables is imported, and the result is canonical as it stands."""
    again = D.canonical_verdicts(P.imported(_texts(spark, sf)).select("doc_id", F.col("canonical").alias("text")))
    return again.groupBy(F.col("doc_id").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("verdict") != "canonical").alias("n_unstable"))


@query("SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_again, CAST(0 AS BIGINT) AS n_noncanonical FROM documents")
def adopt_laws(spark, sf):
    """Adopted documents have nothing left to adopt, and their texts are canonical."""
    adopted = stored(D.adopt_documents(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("adopted").alias("text")), "adopted")
    again = D.adopt_documents(adopted).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("added_ids") > 0).alias("n_again"))
    return again.crossJoin(D.canonical_verdicts(adopted).agg(F.count_if(F.col("verdict") != "canonical").alias("n_noncanonical")))  # a row each


@query("""
WITH l AS (SELECT conv_id::BIGINT * 1000 + turn AS doc_id, unnest(string_split(text, chr(10))) AS l FROM conversations)
SELECT doc_id, count(*) AS n_texts, sum(length(trim(l)))::BIGINT AS n_chars FROM l WHERE trim(l) <> '' GROUP BY doc_id""")
def turn_texts(spark, sf):
    """Lines and characters of every turn of a conversation, from the nodes that the reader makes of it."""
    docs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    nodes = D.node_table(docs).where("type = 'text'")
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("value")).alias("n_chars"))


@query(r"""
SELECT doc_id::BIGINT AS doc_id, CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1) AS INTEGER) AS fence,
  CAST(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INTEGER) AS units FROM documents""")
def text_measures(spark, sf):
    """The fence that each document would need as a code block, and its length in UTF-16."""
    return table(spark, sf, "documents").select("doc_id", F.length(S.safe_fence(F.col("text"))).alias("fence"), S.utf16_units(F.col("text")).alias("units"))


# imports


@query("""SELECT c_custkey::BIGINT AS doc_id, '- ' || c_name || E'\n- ' || c_mktsegment || E'\n  lazy\n\n3. x\n' || (7 + c_nationkey) || '. ' || c_custkey || E'\n' AS canonical FROM customer""")
def import_lists(spark, sf):
    """Lists of other bullets are one, lazy lines join their item, and numbers that deviate stay."""
    text = "concat('* ', c_name, '\n\n+ ', c_mktsegment, '\nlazy\n\n3) x\n', 7 + c_nationkey, ') ', c_custkey, '\n')"
    return P.imported(each(table(spark, sf, "customer"), "c_custkey", text)).select("doc_id", "canonical")


@query("""SELECT s_suppkey::BIGINT AS doc_id, '| name | nation |' || E'\n| :--- | ---: |\n| ' || s_name || E' |  |\n| ' || s_name || ' | ' || s_nationkey || E' |\n' AS canonical, CAST(1 AS BIGINT) AS n_fitted, CAST(1 AS BIGINT) AS n_dropped FROM supplier""")
def import_tables(spark, sf):
    """Rows that are too short or too long are fitted to the header."""
    text = "concat('name|nation\n:-|-:\n', s_name, '\n', s_name, '|', s_nationkey, '|more\n')"
    count = lambda c: F.size(F.filter("losses", lambda x: x["category"] == c)).cast("bigint")
    return P.imported(each(table(spark, sf, "supplier"), "s_suppkey", text)).select("doc_id", "canonical", count("normalised").alias("n_fitted"), count("content-dropped").alias("n_dropped"))


@query("""SELECT o_orderkey::BIGINT AS doc_id, '> ' || o_orderstatus || E'\n> lazy\n> > ' || o_orderpriority || E'\n' AS canonical FROM orders""")
def import_quotes(spark, sf):
    """Quotes with lazy lines and a deeper level."""
    return P.imported(each(table(spark, sf, "orders"), "o_orderkey", "concat('>', o_orderstatus, '\nlazy\n>\n>> ', o_orderpriority, '\n')")).select("doc_id", "canonical")


@query("""SELECT p_partkey::BIGINT AS doc_id, 'See[^p] and \\[^q].' || E'\n\n[^p]: ' || p_name || ' more ' || p_size || E'\n' AS canonical, 'semantic-degradation source-structure-loss' AS lost FROM part""")
def import_footnotes(spark, sf):
    """Footnotes of several blocks become one line, and references to none become text."""
    text = "concat('See[^p] and [^q].\n\n[^p]: ', p_name, '\n\n    more ', p_size, '\n')"
    return P.imported(each(table(spark, sf, "part"), "p_partkey", text)).select("doc_id", "canonical", F.array_join("losses.category", " ").alias("lost"))


@query("""SELECT page_id::BIGINT AS doc_id, 'At <' || url || '> or <p' || page_id || E'@x.example>\n' AS canonical FROM pages""")
def import_autolinks(spark, sf):
    """Links whose text is their target become autolinks."""
    text = "concat('At [', url, '](', url, ') or [p', page_id, '@x.example](mailto:p', page_id, '@x.example)\n')"
    return P.imported(each(table(spark, sf, "pages"), "page_id", text)).select("doc_id", "canonical")


@query(r"""SELECT p_partkey::BIGINT AS doc_id, lower(p_brand) || ' ' || p_partkey AS label FROM part""")
def normal_labels(spark, sf):
    rows = each(table(spark, sf, "part"), "p_partkey", "concat('  ', p_brand, ' \t\n ', p_partkey, ' ')")
    return rows.select("doc_id", S.label(F.col("text")).alias("label"))


# migration and fixtures


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'clean' WHEN 3 THEN 'unrepresentable' ELSE 'mapped' END AS bucket FROM part) GROUP BY ROLLUP(bucket)""")
def migration_gate(spark, sf):
    text = "concat('Part ', p_partkey, element_at(array('.', ' [x]{lang: de} here.', ' [x]{n: 1}', ' `open'), cast(p_partkey % 4 + 1 as int)), '\n')"
    return X.gate(P.migrated(each(table(spark, sf, "part"), "p_partkey", text)).select("bucket"))


@query("""
WITH s AS (SELECT o_custkey AS doc_id, lower(o_orderstatus) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS heading_no, CASE WHEN k = 1 THEN s ELSE s || '-' || k END AS slug FROM s""")
def document_slugs(spark, sf):
    docs = joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "concat('## ', o_orderstatus)", "\n\n")
    return P.document_slugs(docs)


def _cases(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("group"), F.expr("concat('c-', p_partkey div 2)").alias("id"), F.expr("concat('1, ', p_size)").alias("spec"), F.expr("concat(p_name, if(p_partkey % 9 = 0, '\n\n', '\n'))").alias("source"), F.expr("p_partkey % 3 = 0").alias("valid"))


@query("""SELECT 'c-' || p_partkey // 2 AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def fixture_repeated_ids(spark, sf):
    return X.repeated_ids(_cases(spark, sf))


@query("""SELECT 'c-' || p_partkey // 2 AS id, 'final line feed' AS fault FROM part WHERE p_partkey % 9 = 0""")
def fixture_source_faults(spark, sf):
    return X.source_faults(_cases(spark, sf)).select("id", "fault")


@query("""SELECT s::VARCHAR AS section FROM (SELECT unnest(range(1, 61)) AS s) WHERE s <> 1 AND s NOT IN (SELECT p_size FROM part)""")
def fixture_uncovered_sections(spark, sf):
    return X.uncovered_sections(_cases(spark, sf), spark.range(1, 61).select(F.col("id").cast("string").alias("section")))


@query("""
SELECT p_brand AS "group", CAST(7 AS BIGINT) AS n_expected, count(*) AS n_cases FROM part GROUP BY p_brand HAVING count(*) <> 7""")
def fixture_count_faults(spark, sf):
    cases = _cases(spark, sf)
    return X.count_faults(cases, cases.select("group").distinct().withColumn("n", F.lit(7)))


@query("""SELECT 'c-' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'quotes' ELSE 'lists' END AS construct FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT 'c-' || p_partkey, 'marker indentation' FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 <> 0 UNION ALL SELECT 'c-' || p_partkey, 'html' FROM part WHERE p_partkey % 3 = 2""")
def section_routing(spark, sf):
    """Cases of three sections, routed by section or by what the corpus's reader found in them."""
    rows = table(spark, sf, "part").select(F.expr("concat('c-', p_partkey)").alias("id"), F.expr("element_at(array('Lists', 'List items', 'HTML blocks'), cast(p_partkey % 3 + 1 as int))").alias("section"), F.expr("if(p_partkey % 5 = 0, array('blockquote', 'list'), array('paragraph'))").alias("kinds"))
    return X.routed(rows).select("id", "construct")


@query("""SELECT 'c-' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'reject' WHEN 2 THEN 'structural' WHEN 3 THEN CASE WHEN p_size > 20 THEN 'import-only' ELSE 'fail' END ELSE 'n/a' END AS status FROM part""")
def case_statuses(spark, sf):
    """Cases against a catalogue of sections and behaviours."""
    cases = table(spark, sf, "part").select(F.expr("concat('c-', p_partkey)").alias("id"), F.expr("concat('s', p_partkey % 5)").alias("section"), F.lit("list").alias("skeleton"), F.expr("if(p_partkey % 5 = 0, 'list', 'paragraph')").alias("expected"), F.expr("p_size > 20").alias("stable"))
    catalogue = spark.createDataFrame([("s1", "reject"), ("s2", "structural"), ("s3", "import"), ("s4", "none")], "section string, behaviour string")
    return X.classified(cases, catalogue).select("id", "status")


@query("""SELECT 'c-' || o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0""")
def promoted_cases(spark, sf):
    """Candidates whose text is canonical, by their verdicts."""
    docs = table(spark, sf, "orders").select(F.expr("concat('c-', o_orderkey)").alias("doc_id"), F.expr("concat('Order ', o_orderkey, element_at(array('', '\n\n***', ' `open', ' [^no]'), cast(o_orderkey % 4 + 1 as int)), '\n')").alias("text"))
    verdicts = D.canonical_verdicts(docs).select(F.col("doc_id").alias("id"), F.col("verdict").alias("outcome"))
    return X.promoted(docs.select(F.col("doc_id").alias("id"), "text"), verdicts).select("id")


@query("""SELECT count(*) AS n_cases, count(DISTINCT p_brand) AS n_groups, count_if(p_partkey % 3 = 0)::BIGINT AS n_valid FROM part""")
def corpus_facts(spark, sf):
    return X.facts(_cases(spark, sf))
