"""The grammar: verdicts, canonical texts and the four laws."""

import random

import pytest

from loomtext.grammar.api import adopt, canonical_text, check_canonical, equal, validate
from loomtext.grammar.chars import entity, language_tag_ok
from loomtext.grammar.document import read_document, transport_of
from loomtext.grammar.importer import import_text
from loomtext.grammar.tree import rows_of, same
from loomtext.grammar.writer import write_document
from loomtext.operators.reports import random_text, random_tree

CANONICAL = [
    ("", "\n"), ("a", "a\n"), ("# a #", "# a\n"), ("##  a  {#x}", "## a {#x}\n"), ("* * *", "---\n"), ("~~~py\nx\n~~~", "```py\nx\n```\n"),
    ("````\n```\n````", "````\n```\n````\n"), ("* a\n* b", "- a\n- b\n"), ("1) a\n1) b", "1. a\n1. b\n"), ("3. a\n4. b", "3. a\n4. b\n"),
    ("- a\n    - b", "- a\n  - b\n"), ("- [X] a", "- [x] a\n"), (">a\n>>b", "> a\n> > b\n"), ("> a\n-- b", "> a\n-- b\n"),
    ("a|b\n-|-:\n1|2", "| a | b |\n| --- | ---: |\n| 1 | 2 |\n"), ("T x\n____\na\n____", "T x\n___\n\na\n___\n"), (":::: T\na\n:::::", "::: T\na\n:::\n"),
    (":::\na\n--\nb\n==\n<x\n--\n^\n:::", ":::\na\n--\nb\n==\n<x\n--\n^\n:::\n"), ("_a_ __b__ <i>c</i>", "*a* **b** *c*\n"), ("a  \nb", "a\\\nb\n"),
    ("&amp;copy;", "\\&copy;\n"), ("see http://x.y.", "see <http://x.y>.\n"), ("[a](<b c> 't')", "[a](<b c> \"t\")\n"), ("x[^a]\n\n[^a]: n", "x[^a]\n\n[^a]: n\n"),
    ("a\n{#id}", "a\n{#id}\n"), ("2*3", "2*3\n"), ("![a](b)", "![a](b)\n"), ("<m video data-b=1 lang=DE>[a](b)</m>", "<m video lang=de data-b=1>[a](b)</m>\n"),
    ("\ufeffa\r\nb", "a\nb\n"), ("x^2^ ~1~", "x^2^ ~1~\n"), ("$`a`$", "$`a`$\n"), ("`` a`b ``", "`` a`b ``\n"),
]
INVALID = [
    ("a\n===", "syntax"), ("#", "syntax"), ("```\nx", "syntax"), ("<!-- a", "syntax"), ("`a", "syntax"), ("--*", "syntax"), ("a\rb", "syntax"), ("-x", "syntax"),
    ("x[^a]", "semantic"), ("# a {#b}\n\n# c {#b}", "semantic"), ("___\n___", "semantic"), (":::\na\n--\nb\n==\nc\n:::", "semantic"), ("| a | b |\n|---|\n", "syntax"),
    ("> > a", "syntax"), ("- # a", "semantic"), ("[a]()b](c)", None), ("<m lang=x_y>a</m>", "semantic"), ("{#a}", "syntax"), ("*a **b* c**", "syntax"), ("<i></i>", "syntax"),
]


@pytest.mark.parametrize(("text", "canonical"), CANONICAL)
def test_canonical(text, canonical):
    assert canonical_text(text) == canonical
    assert check_canonical(canonical)[0] == "canonical"
    assert same(read_document(text).tree, read_document(canonical).tree)


@pytest.mark.parametrize(("text", "category"), INVALID)
def test_invalid(text, category):
    parsed = read_document(text)
    errors = [f.category for f in parsed.findings if f.severity == "error"]
    assert (errors[:1] == [category]) if category else parsed.status == "ok"


def test_laws_on_random_documents():
    valid = 0
    for seed in range(400):
        parsed = read_document(random_text(seed))
        if parsed.status != "ok" or canonical_text(random_text(seed)) is None:
            continue
        valid += 1
        text = write_document(parsed.tree)
        back = read_document(text)
        assert back.status == "ok" and same(back.tree, parsed.tree) and write_document(back.tree) == text, seed
        assert validate(parsed.tree)[0] == "ok"
    assert valid > 100


def test_transport_and_budgets():
    found = transport_of("\ufeffa\r\nb\rc\n\n")
    assert (found.had_bom, found.crlf, found.lone_cr, found.final_lf) == (True, [1], [3], 2)
    assert found.to_source(2) == 4
    assert read_document("- a", max_bytes=2).status == "resource"
    assert read_document(" " * 4000 + "x").status == "resource"
    assert read_document(None).status == "ok"
    assert read_document("a\n\nb\n\nc", max_nodes=4).status == "resource"


def test_node_rows_are_nested_sets():
    rows = rows_of(read_document("- a\n  - b\n\n> *c*").tree)
    for r in rows:
        inside = [x for x in rows if r["node_id"] < x["node_id"] <= r["subtree_end"]]
        assert all(x["depth"] > r["depth"] for x in inside)
        assert [x["node_id"] for x in rows if x["parent_id"] == r["node_id"]] == [x["node_id"] for x in inside if x["depth"] == r["depth"] + 1]


def test_adoption_keeps_ids_and_is_repeatable():
    first, second = (read_document("# a {#x}\n\nb\n\n- c\n\n<!-- d -->").tree for _ in range(2))
    assert adopt(first, 7) == 2 and adopt(second, 7) == 2 and write_document(first) == write_document(second)
    assert adopt(first, 7) == 0
    with pytest.raises(ValueError):
        adopt(read_document("a").tree, 1, lambda n, k: "no id")


def test_equality_entities_tags_and_import():
    assert equal("*a*", "_a_") and not equal("*a*", "a") and not equal("`a", "`a")
    assert entity("&amp;", 0, 5) == ("&", 5) and entity("&#0;", 0, 4) is None and entity("&nosuch;", 0, 8) is None
    assert language_tag_ok("zh-Hant-TW") and not language_tag_ok("en-a-bb-a-cc")
    text, losses = import_text("Title\n=====\n\n    code\n\nSee [x][k] <b>y</b>.\n\n[k]: /u\n\n<div>\nraw\n</div>\n")
    assert text == "# Title\n\n```\ncode\n```\n\nSee [x](/u) y.\n"
    assert sorted({x.category for x in losses}) == ["content-dropped", "normalised", "resolved"]


def test_deep_and_long_texts_end():
    deep = "\n".join(" " * (2 * i) + "- x" for i in range(300))
    assert read_document(deep).status == "ok"
    assert read_document("*a " * 20_000).status == "invalid"
    assert read_document("[" * 3000).status == "ok"


TASK_LIKE = ["- \\[ \\]", "- \\[ ] a", "* \\[X] a", "1. a\n   - \\[x\\] *b*", "3. \\[ ]\n   - b", "> - \\[x] a", "- [&#120;](/a)", "- [&#32;](/a) b"]


@pytest.mark.parametrize("text", TASK_LIKE)
def test_text_like_a_task_stays_text(text):
    """Written so that no item becomes a task, or an error, when it is read again."""
    parsed = read_document(text)
    written = write_document(parsed.tree)
    assert parsed.status == "ok" and check_canonical(written)[0] == "canonical" and same(parsed.tree, read_document(written).tree)
    assert canonical_text("- [ ] [ ] a\n- [x] b\n\n: \\[x] c\n") == "- [ ] [ ] a\n- [x] b\n\n: [x] c\n"


@pytest.mark.parametrize("seed", (10905, 17939, 41916, 55080, 69097))
def test_laws_on_seeds_with_task_like_texts(seed):
    parsed = read_document(random_text(seed))
    back = read_document(write_document(parsed.tree))
    assert parsed.status == back.status == "ok" and same(parsed.tree, back.tree) and back.transport.canonical


@pytest.mark.parametrize("mark", ("=", "+"))
@pytest.mark.parametrize("size", range(1, 8))
def test_runs_of_marks_stay_text(mark, size):
    """Before a span of the same mark, whatever stands around the run."""
    for text in (f"{a}{('\\' + mark) * size}{b} {mark * 2}c{mark * 2} d" for a in ("", "a", "a ", "a[", "é") for b in ("", "n", " n", ".")):
        parsed = read_document(text)
        written = write_document(parsed.tree)
        assert parsed.status == "ok" and check_canonical(written)[0] == "canonical" and same(parsed.tree, read_document(written).tree), (text, written)


def test_seeded_tree_with_a_run_of_marks():
    tree = random_tree(89254)
    back = read_document(write_document(tree))
    assert back.status == "ok" and same(tree, back.tree)


@pytest.mark.parametrize("seed", (167141, 648831, 840635, 1251459))
def test_laws_on_seeds_with_lines_of_backslashes(seed):
    parsed = read_document(random_text(seed))
    back = read_document(write_document(parsed.tree))
    assert parsed.status == back.status == "ok" and same(parsed.tree, back.tree) and back.transport.canonical


BACKSLASHES = [
    ("\\ \\\na", "\\ \\\na\n"), ("\\  \na", "\\ \\\na\n"), ("\\\\\\\\ \\\na", "\\\\\\\\ \\\na\n"), ("> a\n> \\ \\\n> b", "> a\n> \\ \\\n> b\n"), ("- \\ \\\n  a", "- \\ \\\n  a\n"), ("\\\na", "\\\na\n"),
    ("*a*\\\\\nb", "*a*\\\\\nb\n"), ("*a*\\\\\\\nb", "*a*\\\\\\\nb\n"), ("*\\\\\na*", "*\\\\\na*\n"), ("*a\\\\*", "*a\\\\*\n"), ("[a\\\\](/b)", "[a\\\\](/b)\n"), ("~~a\\\\~~", "~~a\\\\~~\n"),
]


@pytest.mark.parametrize("text,canonical", BACKSLASHES)
def test_backslashes_before_breaks_and_closers(text, canonical):
    """A line of backslashes keeps its hard break, and none that ends a text hides what follows it."""
    parsed = read_document(text + "\n")
    assert parsed.status == "ok" and write_document(parsed.tree) == canonical and check_canonical(canonical)[0] == "canonical" and same(parsed.tree, read_document(canonical).tree)
