"""Corpus reports: triage, laws, imports and evidence, as operators over document tables."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import per_document


#: The outcomes of a triage: two that read well, three refusals, a used-up budget, and four broken laws.
OUTCOMES = ("canonical", "noncanonical", "syntax", "semantic", "refused-noncanonical", "resource", "unwritable", "strict", "closure", "idempotence")


def triage(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents by outcome, most frequent first.

    A text that can be read is written and read again: ``unwritable`` has no canonical text,
    ``strict`` is refused in canonical form, ``closure`` means something else then, and
    ``idempotence`` is written in another way the second time.
    """
    def read(_, body):
        from ..grammar.document import read_document
        from ..grammar.tree import Exhausted, Unwritable, same
        from ..grammar.writer import write_document

        parsed = read_document(body)
        if parsed.status == "resource":
            return [("resource",)]
        if parsed.status != "ok":
            first = next((f for f in parsed.findings if f.severity == "error"), None)
            return [({"semantic": "semantic", "noncanonical": "refused-noncanonical"}.get(first.category if first else "", "syntax"),)]
        try:
            canonical = write_document(parsed.tree)
            back = read_document(canonical)
            if back.status != "ok" or not back.transport.canonical:
                return [("strict",)]
            if not same(parsed.tree, back.tree):
                return [("closure",)]
            if write_document(back.tree) != canonical:
                return [("idempotence",)]
        except (Unwritable, RecursionError):
            return [("unwritable",)]
        except Exhausted:
            return [("resource",)]
        return [("canonical" if canonical == body else "noncanonical",)]

    outcomes = per_document(df, read, {"outcome": "string"}, [pa.string()], key, text)
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")


def laws_held(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ok, same, again, strict)``: whether a document is valid, and the laws that hold for it.

    Its canonical text means the same, is its own canonical text, and passes strictly; an
    invalid document only has to be read to its end.
    """
    def read(_, body):
        from ..grammar.document import read_document
        from ..grammar.tree import Unwritable, same
        from ..grammar.writer import write_document

        parsed = read_document(body)
        if parsed.status != "ok":
            return [(False, True, True, True)]
        try:
            canonical = write_document(parsed.tree)
        except Unwritable:
            return [(False, True, True, True)]
        back = read_document(canonical)
        if back.status != "ok":
            return [(True, False, False, False)]
        again = write_document(back.tree) == canonical
        return [(True, same(parsed.tree, back.tree), again, again and back.transport.canonical)]

    return per_document(df, read, dict.fromkeys(("ok", "same", "again", "strict"), "boolean"), [pa.bool_()] * 4, key, text)


def law_counts() -> list[Column]:
    """Aggregates over ``laws_held``: documents, those not valid, and the violations of each law."""
    return [
        F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("ok")).alias("not_ok"), F.count_if(~F.col("same")).alias("law_roundtrip"),
        F.count_if(~F.col("again")).alias("law_idempotent"), F.count_if(~F.col("strict")).alias("law_strict"),
    ]


def law_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``law_counts``."""
    return laws_held(df, key, text).agg(*law_counts())


def imported(df: DataFrame, raw_html: str = "drop", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, canonical, losses)``: CommonMark-style text as canonical text, with the record of what was lost."""
    fields = {"canonical": "string", "losses": "array<struct<category:string,message:string,line:int>>"}
    loss = pa.list_(pa.struct([("category", pa.string()), ("message", pa.string()), ("line", pa.int32())]))

    def read(_, body):
        from ..grammar.importer import import_text

        canonical, losses = import_text(body, raw_html)
        return [(canonical, [{"category": x.category, "message": x.message, "line": x.line} for x in losses])]

    return per_document(df, read, fields, [pa.string(), loss], key, text)


def migrated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, canonical, bucket, steps)``: texts of the older dialect, by how well they came over."""
    step = pa.list_(pa.struct([("category", pa.string()), ("message", pa.string())]))

    def read(_, body):
        from ..grammar.migrate import migrate_text

        canonical, bucket, steps = migrate_text(body)
        return [(canonical, bucket, [{"category": s.category, "message": s.message} for s in steps])]

    return per_document(df, read, {"canonical": "string", "bucket": "string", "steps": "array<struct<category:string,message:string>>"}, [pa.string(), pa.string(), step], key, text)


def document_slugs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, heading_no, slug)``: slugs of the headings of each document, unique in it."""
    def read(_, body):
        from ..grammar.document import read_document
        from ..grammar.migrate import slugs

        tree = read_document(body).tree
        found = [n for n in tree.walk() if n.type == "heading"] if tree else []
        return list(enumerate(slugs(["".join(t.data["value"] for t in n.walk() if "value" in t.data) for n in found]), start=1))

    return per_document(df, read, {"heading_no": "bigint", "slug": "string"}, [pa.int64(), pa.string()], key, text)


def evidence(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, source_bytes, status, import_stable, node_types)`` for each document."""
    fields = {"source_bytes": "bigint", "status": "string", "import_stable": "boolean", "node_types": "array<string>"}

    def read(_, body):
        from ..grammar.document import read_document
        from ..grammar.importer import import_text, is_stable

        parsed = read_document(body)
        types = sorted({n.type for n in parsed.tree.walk()}) if parsed.tree else []
        return [(len((body or "").encode("utf-8", "replace")), parsed.status, is_stable(import_text(body)[0]), types)]

    return per_document(df, read, fields, [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())], key, text)


def random_text(seed: int) -> str:
    """A document made of a seeded mix of constructs, some of them broken on purpose."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghijklmnoprstuw") for _ in range(r.randint(1, 8)))
    bits = (
        word, lambda: f"**{word()}**", lambda: f"_{word()}_", lambda: f"`{word()}`", lambda: f"~~{word()} {word()}~~", lambda: f"[{word()}](/{word()} '{word()}')",
        lambda: f"<http://{word()}.example>", lambda: f"http://{word()}.example/{word()}", lambda: f"x^{word()}^", lambda: "&amp;", lambda: r.choice("*_~+-=^$[]<>|\\#!&{}:"), lambda: f"<i>{word()}</i>", lambda: f"==a {word()}==", lambda: f"\\{r.choice('*_[]`<&')}",
    )
    line = lambda n=6: " ".join(r.choice(bits)() for _ in range(r.randint(1, n)))
    blocks = (
        lambda: "\n".join(line() for _ in range(r.randint(1, 3))), lambda: "#" * r.randint(1, 6) + " " + line(4), lambda: r.choice(("---", "***", "- - -")),
        lambda: "\n".join(f"{r.choice('-*+')} {line(3)}" for _ in range(r.randint(1, 4))), lambda: "\n".join(f"{i + r.randint(1, 3)}. {line(3)}\n   - {line(2)}" for i in range(r.randint(1, 3))),
        lambda: f"```{r.choice(('', 'py', 'math'))}\n{line()}\n```", lambda: "\n".join(f"> {line(3)}" for _ in range(r.randint(1, 3))),
        lambda: f"| a | {word()} |\n|---|:-:|\n" + "\n".join(f"| {word()} | `{word()}` |" for _ in range(r.randint(0, 3))), lambda: f"::: {word()} {word()}\n{line()}\n:::",
        lambda: f":::\n{word()}\n--\n{word()}\n==\n{r.choice(('^', word()))}\n--\n{word()}\n:::", lambda: f"![{word()}](/{word()}.png)", lambda: f"<m video lang=de>[{word()}](/{word()})</m>", lambda: f"<!-- {word()} -->",
        lambda: f"{word()}\n___\n\n{line()}\n\n___",
    )
    return "\n\n".join(r.choice(blocks)() for _ in range(r.randint(1, 6))) + "\n"


def random_tree(seed: int):
    """A seeded valid document tree, built without reading a text."""
    from ..grammar.tree import Node

    r = random.Random(seed)
    letters = lambda marks="": "".join(r.choice("abcdeghijklmnoprstuw" + marks) for _ in range(r.randint(1, 8))) + "x"
    word = lambda: "a" + letters("*_[`<&=~")

    def inline(depth: int = 0, breaks: bool = True) -> list[Node]:
        out: list[Node] = [Node("text", {"value": word() + " "})]
        for _ in range(r.randint(0, 3)):
            kind = r.choice(("em", "strong", "inlineCode", "link", "mark", "softBreak", "sup"))
            if kind == "softBreak" and (not breaks or out[-1].type == "softBreak"):
                continue
            if kind == "softBreak":
                out[-1].data["value"] = out[-1].data["value"].rstrip()
                out += [Node("softBreak"), Node("text", {"value": word()})]
                continue
            if kind in ("inlineCode", "sup"):
                node = Node(kind, {"value": "".join(r.choice("abcxyz") for _ in range(3))})
            elif kind == "link":
                node = Node("link", {"dest": f"/{r.randint(0, 99)}"}, {"children": [Node("text", {"value": letters()})]})
            else:
                node = Node(kind, {}, {"children": [Node("text", {"value": letters()})]})
            out[-1].data["value"] = out[-1].data["value"].rstrip() + " "
            out += [node, Node("text", {"value": " " + word()})]
        out[-1].data["value"] = out[-1].data["value"].rstrip()
        return out

    def paragraph() -> Node:
        return Node("paragraph", {}, {"children": inline()})

    def items(depth: int) -> Node:
        kind, own = r.choice(("unordered", "ordered")), []
        for _ in range(r.randint(1, 3)):
            kids = [paragraph()]
            if depth < 3 and r.random() < 0.4:
                kids.append(items(depth + 1))
            own.append(Node("listItem", {"task": r.choice(("open", "done"))} if r.random() < 0.2 else {}, {"children": kids}))
        start = r.randint(2, 20) if kind == "ordered" and r.random() < 0.3 else None
        return Node("list", {"kind": kind} | ({"start_no": start} if start else {}), {"items": own})

    def table() -> Node:
        width = r.randint(1, 3)
        row = lambda: Node("tableRow", {}, {"cells": [Node("tableCell", {}, {"children": inline(breaks=False)}) for _ in range(width)]})
        return Node("table", {"alignments": [r.choice(("default", "left", "right", "center")) for _ in range(width)]}, {"head": [row()], "body": [row() for _ in range(r.randint(0, 2))]})

    def quote() -> Node:
        kids = [paragraph(), *([table()] if r.random() < 0.3 else [])]
        for k in kids:
            k.data["quote_level"] = 1
        return Node("quoteRegion", {}, {"children": kids})

    blocks = (paragraph, lambda: Node("heading", {"level": r.randint(1, 6)}, {"children": inline(breaks=False)}), lambda: items(1), table, quote, lambda: Node("horizontalRule"), lambda: Node("codeBlock", {"value": word() + "\n" + word()}))
    made: list[Node] = []
    for _ in range(r.randint(1, 6)):
        node = r.choice(blocks)()
        if not (made and made[-1].type == node.type and node.type in ("list", "quoteRegion")):
            made.append(node)
    return Node("document", {}, {"children": made, "footnotes": []})


def linearity(unit: str, sizes: tuple[int, ...] = (8, 16, 32, 64, 128, 256), rounds: int = 5, most: float = 3.0) -> tuple[bool, list[float]]:
    """Whether the cost of reading a byte stays within ``most`` times its least over growing repeats of a text; the costs."""
    import time

    from ..grammar.document import read_document

    costs: list[float] = []
    read_document(unit * sizes[0])
    for n in sizes:
        body, best = unit * n, float("inf")
        for _ in range(rounds):
            began = time.perf_counter()
            read_document(body)
            best = min(best, (time.perf_counter() - began) / len(body))
        costs.append(best)
    return all(c <= most * min(costs[:i + 1]) for i, c in enumerate(costs)), costs


def soak_documents(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A seeded document for each row of an integer key, made where it is read."""
    own = rows.select(F.col(key).cast("bigint").alias("doc_id"), F.lit("").alias("text"))
    return per_document(own, lambda i, _: [(random_text(seed + i),)], {"text": "string"}, [pa.string()])


def tree_report(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row: seeded trees, one for each row of an integer key, and those whose text doesn't read back the same."""
    def read(i, _):
        from ..grammar.document import read_document
        from ..grammar.tree import same
        from ..grammar.writer import write_document

        tree = random_tree(seed + i)
        back = read_document(write_document(tree))
        return [(back.status == "ok" and same(tree, back.tree),)]

    own = rows.select(F.col(key).cast("bigint").alias("doc_id"), F.lit("").alias("text"))
    return per_document(own, read, {"closed": "boolean"}, [pa.bool_()]).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("closed")).alias("law_closure"))
