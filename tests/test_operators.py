"""Operators on small tables: edge cases, sources, streams, SQL functions."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import sqlfuncs
from loomtext.operators import documents, lines, relations, reports, transport, validation
from loomtext.sources import files
from loomtext.streaming import parsed_stream, stream_documents, verdict_counts, write_stream

EDGES = [(1, None), (2, ""), (3, "a\n"), (3, "a\n"), (None, "\ufeffb\r\nc"), (5, "x" * 200_000), (6, "`open"), (7, "a\rb")]


def table(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("status", F.lit("mine"))


def test_parse_edges_and_empty(spark):
    got = documents.parse_documents(table(spark))
    assert [r["status"] for r in got.orderBy("doc_id").collect()] == ["ok", "ok", "ok", "ok", "ok", "ok", "invalid", "invalid"]
    assert documents.parse_documents(table(spark, [])).count() == 0
    assert documents.node_table(table(spark)).where("type = 'errorBlock'").count() == 2
    stored = got.cache()
    assert documents.exploded(stored, "nodes").count() == stored.agg(F.sum("n_nodes")).first()[0]
    assert documents.exploded(stored, "findings").where("category = 'syntax'").count() == 2
    resource = documents.parse_documents(table(spark, [(1, "- - a")]), max_bytes=2).first()
    assert resource["status"] == "resource"


def test_transport_and_lines(spark):
    got = {r["doc_id"]: r for r in transport.with_report(table(spark)).collect()}
    assert got[None]["had_bom"] and got[None]["crlf_count"] == 1 and got[7]["lone_cr_count"] == 1 and got[3]["transport_canonical"]
    rows = lines.lines(table(spark, [(1, "a\n\nbc\n"), (2, ""), (3, None), (4, "x")])).orderBy("doc_id", "line_no").collect()
    assert [(r["doc_id"], r["line"], r["start_off"], r["terminated"]) for r in rows] == [(1, "a", 0, True), (1, "", 2, True), (1, "bc", 3, True), (4, "x", 0, False)]
    assert lines.literal_state(table(spark, [(1, "a\n```\n# b\n```\nc <!-- x\n<!-- y\nz -->\n")])).where("literal").count() == 5


def test_commands_and_validation(spark):
    docs = table(spark, [(1, "*a*\n"), (2, "_a_\n"), (3, "`a\n"), (4, "[x](#no)\n")])
    assert [r["exit_code"] for r in documents.run_command(docs, "check").orderBy("doc_id").collect()] == [0, 0, 1, 0]
    assert [r["exit_code"] for r in documents.run_command(docs, "check", strict=True).orderBy("doc_id").collect()] == [0, 1, 1, 0]
    formatted = documents.run_command(docs, "format").orderBy("doc_id").collect()
    assert [r["new_content"] for r in formatted] == ["*a*\n", "*a*\n", None, "[x](#no)\n"]
    assert formatted[2]["output"].startswith("1:1: error[syntax]")
    checked = {r["doc_id"]: r for r in documents.validation_table(docs).collect()}
    assert checked[4]["findings"][0]["category"] == "advisory" and checked[3]["status"] == "invalid"
    assert documents.validation_table(docs, identity=True).where("status = 'ok'").count() == 0


def test_rules_find_broken_trees(spark):
    nodes = documents.node_table(table(spark, [(1, "3. a\n4. b\n\n> c\n> > d\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")])).cache()
    assert validation.violations(nodes).count() == 0
    same = nodes.withColumn("item_value", F.when((F.col("type") == "listItem") & (F.col("pos") == 1), 4))
    assert [r["rule"] for r in validation.list_violations(same).collect()] == ["list value"]
    deep = nodes.withColumn("quote_level", F.when(F.col("quote_level") == 2, 3).otherwise(F.col("quote_level")))
    assert validation.quote_violations(deep).count() == 1
    assert validation.table_violations(nodes.where("not (type = 'tableCell' and pos = 1)")).count() == 2
    assert relations.skeletons(nodes).first()["skeleton"].startswith("list")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# a\n")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path / "*.md")).collect()}
    assert got["a.md"]["text"] == "# a\n" and got["b.md"]["text"] is None and not got["b.md"]["valid_utf8"]
    (tmp_path / "c.json").write_text('{"group": "g", "cases": [{"id": "1", "source": "a"}, {"id": "2", "source": "b"}]}')
    assert files.read_cases(spark, str(tmp_path / "c.json")).select("group", "id").count() == 2
    files.write_texts(table(spark, [(1, "a")]), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "a"
    one = table(spark, [(1, "---\nt: 1\n---\nbody\n")]).select(files.strip_front_matter(F.col("text")).alias("b"), files.front_matter(F.col("text")).alias("h")).first()
    assert one["b"] == "body\n" and one["h"] == "---\nt: 1\n---\n"


def test_stream_and_sql(spark, tmp_path):
    table(spark, [(1, "_a_"), (2, "`a")]).select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    write_stream(parsed_stream(stream_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    assert {r["doc_id"]: r["canonical"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "*a*\n", 2: None}
    sqlfuncs.register(spark)
    row = spark.sql("select canonical_text('_a_') c, parse_status('`a') s, nfc('e\u0301') n, html_entity('&amp;') e, trailing_lf('a\n\n') t, is_blank_line(' ') b").first()
    assert (row["c"], row["s"], row["n"], row["e"], row["t"], row["b"]) == ("*a*\n", "invalid", "\u00e9", "&", 2, True)
    assert [r["type"] for r in spark.sql("select * from blocks('# a\n\nb')").collect()] == ["heading", "paragraph"]


def test_windowed_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{i}:30:00", "a" if i % 2 else "`a") for i in range(6)]
    spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = stream_documents(spark, str(tmp_path / "in"), "ts timestamp, text string")
    query = verdict_counts(stream, "ts").writeStream.format("memory").queryName("verdicts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["status"], r["count"]) for r in spark.table("verdicts").collect()} == {("ok", 1), ("invalid", 1)} and spark.table("verdicts").count() == 6


def test_reports(spark):
    docs = table(spark, [(1, "a\n"), (2, "a"), (3, "`a"), (4, "x[^a]")])
    assert {r["outcome"]: r["n"] for r in reports.triage(docs).collect()} == {"canonical": 1, "noncanonical": 1, "syntax": 1, "semantic": 1}
    assert reports.evidence(docs).where("import_stable").count() >= 3
    assert reports.law_report(table(spark, [])).first()["n_docs"] == 0


def test_line_ends_of_other_kinds(spark):
    """Line separators that are no line feeds stay inside a line, and don't end a pattern."""
    for mark in "\x85  ":
        docs = table(spark, [(1, f"a{mark}\n{mark}\n# h{mark}\n- x{mark}y\n")])
        rows = lines.quick_lines(docs)
        assert [r["line"] for r in rows.orderBy("line_no").collect()] == [f"a{mark}", mark, f"# h{mark}", f"- x{mark}y"]
        assert rows.where(lines.is_blank(F.col("line"))).count() == 0
        assert lines.headings(rows).first()["heading"] == f"h{mark}" and lines.list_markers(rows).first()["content"] == f"x{mark}y"
        sqlfuncs.register(spark)
        row = spark.createDataFrame([(f"a\n\n{mark}", mark)], "t string, b string").selectExpr("trailing_lf(t) t", "is_blank_line(b) b").first()
        assert row["t"] == 0 and not row["b"]
        assert transport.with_report(table(spark, [(1, f"a\n{mark}")])).first()["trailing_lf"] == 0


def test_command_flags(spark):
    docs = table(spark, [(1, "*a*\n"), (2, "_a_\n")])
    for command, flags in (("format", {"check": True, "stdout": True}), ("check", {"check": True}), ("check", {"stdout": True}), ("adopt", {"strict": True}), ("lint", {})):
        with pytest.raises(ValueError):
            documents.run_command(docs, command, **flags)
    assert [r["new_content"] for r in documents.run_command(docs, "format", stdout=True).orderBy("doc_id").collect()] == ["*a*\n", "*a*\n"]
    assert [r["exit_code"] for r in documents.run_command(docs, "format", check=True).orderBy("doc_id").collect()] == [0, 1]
    assert [r["exit_code"] for r in documents.run_command(docs, "format", strict=True).orderBy("doc_id").collect()] == [0, 1]


def test_numbers_of_a_common_value(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"v{i}", i) for i in range(3000)], "s string, k int")
    got = relations.numbered(rows, "s", "k").collect()
    assert sorted(r["n"] for r in got if r["s"] == "hot") == list(range(1, 2001))
    assert [r["n"] for r in sorted(got, key=lambda r: r["k"]) if r["s"] == "hot"] == list(range(1, 2001)) and all(r["n"] == 1 for r in got if r["s"] != "hot")


def test_spread_deals_out_small_inputs(spark):
    one = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).coalesce(1)
    assert documents.spread(one).rdd.getNumPartitions() > 1


def test_rules_stored_one_by_one(spark):
    """The same violations as from one plan of all rules, and nothing of the rules is left in the plan of what follows."""
    nodes = documents.node_table(table(spark, [(1, "3. a\n4. b\n\n> c\n> > d\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")])).cache()
    broken = nodes.where("not (type = 'tableCell' and pos = 1)").withColumn("quote_level", F.when(F.col("quote_level") == 2, 3).otherwise(F.col("quote_level")))
    found = validation.stored_violations(broken)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, validation.violations(broken).collect())) and found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_no_rule_broadcasts_a_stored_table(spark, tmp_path):
    """Whatever the files' size promises: joins that grow with the nodes don't go through the driver."""
    documents.node_table(table(spark, [(i, "3. a\n4. b\n\n> c\n> > d\n\n| a | b |\n|---|---|\n| 1 | *2* |\n") for i in range(20)])).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    for rule in validation.RULES:
        found = rule(nodes)
        assert found.count() == 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString(), rule.__name__
