"""Cost, budgets, seeded trees and imports, without Spark."""

import pytest

from loomtext.grammar.api import canonical_text
from loomtext.grammar.document import read_document
from loomtext.grammar.importer import import_text
from loomtext.grammar.tree import Exhausted, same
from loomtext.grammar.writer import write_document
from loomtext.operators.reports import linearity, random_text, random_tree

UNITS = ("::: A\n", "T\n___\n", "[", "<a ", "word **b** `c`\n", "plain words in a row\n", "> q\n", "| a | b |\n|---|---|\n| 1 | 2 |\n\n", "[a](x) ", "![", "*a* ", "^ ", "http://a.b ", "- a\n  - b\n", random_text(3) + "\n" + random_text(8) + "\n")


@pytest.mark.parametrize("unit", UNITS)
def test_cost_of_a_byte_stays(unit):
    scale = max(1, 400 // len(unit))  # so that the least size takes measurable time
    held = [linearity(unit * scale, rounds=3)[0] for _ in range(2)]
    assert any(held)


def test_many_nodes_are_counted_once():
    assert read_document("word\n\n" * 4000, max_nodes=100_000).status == "ok"
    assert read_document("word\n\n" * 60, max_nodes=100).status == "resource"
    assert linearity("word\n\n", (256, 1024, 4096), rounds=2)[0]


def test_slots():
    grid = ":::\na\n--\nb\n==\nc\n--\nd\n:::\n"
    assert read_document(grid).status == "ok" and read_document(grid, max_slots=3).status == "resource"
    with pytest.raises(ValueError):
        read_document(grid, max_slots=1_000_001)


def test_trees_read_back():
    for seed in range(400):
        tree = random_tree(seed)
        back = read_document(write_document(tree))
        assert back.status == "ok" and same(tree, back.tree)
    with pytest.raises(Exhausted):
        same(tree, tree, most_nodes=2)


@pytest.mark.parametrize(("text", "canonical", "lost"), [
    ("* a\n* b\n\n- c\n", "- a\n- b\n- c\n", []),
    ("1) a\n2) b\n\n7. c\n", "1. a\n2. b\n7. c\n", []),
    ("- a\nlazy\n  - in\n", "- a\n  lazy\n  - in\n", []),
    ("- # head\n- ok\n", "- `# head`\n- ok\n", ["unrepresentable"]),
    ("text\n2. more\n", "text\n2\\. more\n", []),
    ("> a\nlazy\n>\n> - x\n>   y\n", "> a\n> lazy\n>\n> - x\n>   y\n", []),
    ("> > deep\n", "> deep\n", ["source-structure-loss"]),
    ("a|b\n-|:-:\n1\n1|2|3\n", "| a | b |\n| --- | :---: |\n| 1 |  |\n| 1 | 2 |\n", ["normalised", "content-dropped"]),
    ("x[^1]\n\n[^1]: note\n\n    more\n", "x[^1]\n\n[^1]: note more\n", ["source-structure-loss"]),
    ("x[^no]\n", "x\\[^no]\n", ["semantic-degradation"]),
    ("[http://x.y](http://x.y)\n", "<http://x.y>\n", []),
    ("a ==b== x^2^\n", "a \\==b== x\\^2^\n", []),
    ("***\n\na\n", "---\n\na\n", ["normalised"]),
])
def test_imports(text, canonical, lost):
    out, losses = import_text(text)
    assert out == canonical and [x.category for x in losses] == lost and canonical_text(out) == out
