"""Queries over whole tables, where the known-answer queries take the rows that SQL can tell."""

from collections import Counter

from loomtext.grammar import api
from loomtext.operators import relations
from loomtext.plans import catalogue


def test_canonical_groups(spark, tmp_path):
    """Texts with lists, accents, digits, links and faults are grouped as parsing them one by one does."""
    texts = ["Plain words.", "* one\n* two\n", "- one\n- two", "## Größe 12 ##\n", "## Größe 12\n", "`open", "> a\n> b", ">a\n>b\n", "_x_ (c) 2024", "*x* (c) 2024", "", "Plain words.\n", "a|b\n-|-\n1|2\n", "| a | b |\n| --- | --- |\n| 1 | 2 |\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    groups: list[list[int]] = []
    for i, t in enumerate(texts):
        if api.canonical_text(t) is None:
            continue
        for g in groups:
            if api.equal(texts[g[0]], t):
                g.append(i)
                break
        else:
            groups.append([i])
    got = Counter((r["first_doc"], r["n_docs"]) for r in catalogue.canonical_groups(spark, str(tmp_path)).collect())
    assert got == Counter((g[0], len(g)) for g in groups) and sum(len(g) > 1 for g in groups) >= 5


def test_all_autolinks(spark, tmp_path):
    urls = ["http://a.example/", "https://a.example/x?utm_source=feed", "http://a.example/_b_/~c/", "http://a.example/*d*e", "http://a.example/f?!", "http://a.example/g_"]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["doc_id"], r["form"]): r["value"] for r in catalogue.all_autolinks(spark, str(tmp_path)).collect()}
    bare = [*urls[:4], "http://a.example/f", "http://a.example/g"]
    assert {i: got[i, "bare"] for i in range(6)} == dict(enumerate(bare))
    assert {i: got[i, "angle"] for i in range(6)} == dict(enumerate(urls))


def test_paragraph_runs(spark, tmp_path):
    spark.createDataFrame([(1, "a\n  b\n\n \t\nc\n"), (2, "\n\nd"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalogue.paragraph_runs(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 1, 2, "a\nb"), (1, 2, 5, 1, "c"), (2, 1, 3, 1, "d")]


def test_shared_meanings(spark, tmp_path):
    """Each text is read once, and a side without texts is there with none."""
    rows = [(1, 7, "O"), (3, 8, "F"), (5, 7, "P")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.shared_meanings(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("both", 0), ("left", 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_shared_values(spark):
    """Repeated and null values count as intersect and exceptAll count them."""
    a, b = (spark.createDataFrame([(v,) for v in vs], "v string") for vs in (["x", "x", "x", "y", None, None, "z", "z"], ["x", None, "w", "z", "z", "z"]))
    got = dict(map(tuple, relations.shared_values(a, b, "v").collect()))
    assert got == {"both": a.intersect(b).count(), "left": a.exceptAll(b).count()} == {"both": 3, "left": 4}
