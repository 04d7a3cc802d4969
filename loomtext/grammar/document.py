"""Whole documents: transport, budgets, the block loop with recovery, and the relations between blocks."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from dataclasses import dataclass, field

from .blocks import HARD_SLOTS, MOST_SLOTS, BlockReader, is_blank, suffix_of
from .chars import is_identifier
from .tree import Exhausted, Fault, Finding, Node

sys.setrecursionlimit(max(sys.getrecursionlimit(), 40_000))
_FRAME = re.compile(r"( *)((?:> ? *)*)(?=([-*+:0-9])?)")
MOST_FRAMES = 1000
#: The children that may hold references, in document order: slots are kept in this order by the readers.
FOOTNOTE_FREE = ("codeBlock", "mathBlock", "commentBlock")


@dataclass
class Transport:
    """What the raw text carries besides its lines."""

    text: str
    had_bom: bool
    crlf: list[int]
    lone_cr: list[int]
    final_lf: int

    @property
    def canonical(self) -> bool:
        return not self.had_bom and not self.crlf and not self.lone_cr and self.final_lf == 1

    def to_source(self, at: int) -> int:
        """A code-point offset of the normalised text in the raw one."""
        return at + self.had_bom + bisect_left(self.crlf, at)


def transport_of(raw: str) -> Transport:
    """One leading mark is dropped and line ends become LF; offsets are those of the normalised text."""
    body = raw[1:] if raw.startswith("\ufeff") else raw
    crlf, lone = [], []
    for n, m in enumerate(re.finditer("\r\n?", body)):
        if m[0] == "\r\n":
            crlf.append(m.start() - len(crlf))
        else:
            lone.append(m.start() - len(crlf))
    text = body.replace("\r\n", "\n").replace("\r", "\n") if crlf or lone else body
    return Transport(text, body is not raw, crlf, lone, len(text) - len(text.rstrip("\n")))


def structural_frames(text: str) -> int:
    """The most frames that any line could open: indentation by twos, quote marks and one list marker."""
    most = 0
    for line in text.split("\n"):
        m = _FRAME.match(line)
        most = max(most, len(m[1]) // 2 + m[2].count(">") + (m[3] is not None))
    return most


@dataclass
class Parsed:
    """The outcome of reading a document; ``tree`` is its document or, where it is invalid, what was recovered."""

    status: str
    tree: Node | None = None
    findings: list[Finding] = field(default_factory=list)
    transport: Transport | None = None


def read_document(raw: str | None, max_bytes: int | None = None, max_frames: int = MOST_FRAMES, max_nodes: int | None = None, max_slots: int = MOST_SLOTS) -> Parsed:
    """Reads a document to the end; every fault becomes an error block, and the first one is the verdict.

    Null counts as the empty text.  A used-up budget gives the status ``resource``.
    """
    if not 0 < max_slots <= HARD_SLOTS:
        raise ValueError(f"max_slots is at least 1 and at most {HARD_SLOTS}")
    raw = raw or ""
    found = transport_of(raw)

    def exhausted(why: str) -> Parsed:
        return Parsed("resource", None, [Finding("resource", why)], found)

    if max_bytes is not None and len(raw.encode("utf-8", "replace")) > max_bytes:
        return exhausted("source byte budget exceeded")
    if structural_frames(found.text) > max_frames:
        return exhausted("structural frame budget exceeded")
    half = None if found.text.isascii() else re.search("[\ud800-\udfff]", found.text)
    if found.lone_cr or half:
        why, at = ("lone CR is not valid transport", found.lone_cr[0]) if found.lone_cr else ("a lone surrogate is not a Unicode scalar value", half.start())
        whole = Node("errorBlock", {"reason": why, "value": found.text}, span=(0, len(found.text)))
        tree = Node("recoveryDocument", {}, {"children": [whole]}, (0, len(found.text)))
        return Parsed("invalid", tree, [Finding("syntax", why, at, at + 1)], found)
    try:
        return _read(found, max_nodes, max_slots)
    except Exhausted as e:
        return exhausted(str(e))
    except RecursionError:
        return exhausted("structural frame budget exceeded")


def _read(found: Transport, max_nodes: int | None, max_slots: int) -> Parsed:
    text, findings = found.text, []
    reader = BlockReader(text, note=lambda why, a, b: findings.append(Finding("advisory", why, a, b)), most_slots=max_slots)
    kids: list[Node] = []
    notes: list[Node] = []
    failed, after_blank, count, counted = False, True, 0, (0, 0)

    def fail(fault: Fault, begin: int) -> Node:
        nonlocal failed
        failed = True
        findings.append(Finding(fault.category, fault.message, fault.start, fault.end))
        return Node("errorBlock", {"reason": fault.message, "value": text[begin:fault.end]}, span=(begin, fault.end))

    while (line := reader.line()) is not None:
        if is_blank(line):
            reader.at += 1
            after_blank = True
            continue
        first = reader.at
        try:
            if (own := suffix_of(line)) is not None:
                reader.at += 1
                raise reader.fault("block id after blank line" if own and after_blank else "invalid block id suffix", first)
            if (note := reader.definition()) is not None:
                notes.append(note)
                following = reader.line()
                if following is not None and (own := suffix_of(following)) is not None:
                    reader.at += 1
                    if not own:
                        raise reader.fault("invalid block id suffix", reader.at - 1)
                    note.data["block_id"] = own
            else:
                node = reader.block("document", lambda k: False)
                kids.append(node)
                reader.attach(node, True, "syntax")
        except Fault as f:
            if reader.at == first:
                reader.at += 1
            kids.append(fail(f, min(reader.begin(first), f.start)))
        after_blank = False
        if max_nodes is not None:
            new = kids[counted[0]:] + notes[counted[1]:]
            counted = (len(kids), len(notes))
            count += sum(1 for k in new for _ in k.walk())
            if count > max_nodes:
                raise Exhausted("node budget exceeded")
    ordered, doubled = _relations(kids, notes, findings)
    failed |= any(f.severity == "error" for f in findings)
    kids += [Node("errorBlock", {"reason": f"duplicate footnote definition [^{n.data['identifier']}]", "value": text[slice(*n.span)]}, span=n.span) for n in doubled]
    tree = Node("recoveryDocument" if failed else "document", {}, {"children": kids, "footnotes": ordered}, (0, len(text)))
    return Parsed("invalid" if failed else "ok", tree, findings, found)


def references(nodes: list[Node]) -> list[Node]:
    """Footnote references in document order."""
    return [n for top in nodes for n in top.walk() if n.type == "footnoteReference"]


def footnote_order(kids: list[Node], notes: list[Node], refs: list[Node] | None = None) -> tuple[list[str], list[str]]:
    """Defined identifiers by first reference, then the unused ones in ASCII order."""
    defined = {n.data["identifier"] for n in notes}
    used = list(dict.fromkeys(r.data["identifier"] for r in (references(kids) if refs is None else refs)))
    return [i for i in used if i in defined], sorted(defined.difference(used))


def _relations(kids: list[Node], notes: list[Node], findings: list[Finding]) -> tuple[list[Node], list[Node]]:
    by: dict[str, list[Node]] = {}
    for n in notes:
        by.setdefault(n.data["identifier"], []).append(n)
    for name, group in by.items():
        if len(group) > 1:
            findings.append(Finding("semantic", f"duplicate footnote definition [^{name}]", *group[1].span))
    seen, refs = set(), references(kids)
    for r in refs:
        if (name := r.data["identifier"]) not in seen and name not in by:
            findings.append(Finding("semantic", f"footnote reference [^{name}] has no definition", *(r.span or (None, None))))
        seen.add(name)
    used, unused = footnote_order(kids, notes, refs) if refs or notes else ([], [])
    for name in unused:
        findings.append(Finding("advisory", f"unused footnote definition [^{name}]", *by[name][0].span))
    ids = set()
    for node in (*_with_scope(kids), *notes):
        own = node.data.get("block_id")
        if own is not None:
            if not is_identifier(own) or own in ids:
                findings.append(Finding("semantic", f"duplicate block id {{#{own}}}", *(node.span or (None, None))))
            ids.add(own)
    return [by[name][0] for name in (*used, *unused)], [n for group in by.values() for n in group[1:]]


def _with_scope(kids: list[Node]):
    """Blocks that may carry ids: those of the document and, directly, of containers."""
    for node in kids:
        yield node
        if node.type == "container":
            yield from _with_scope([k for k in node.kids() if k.type != "grid"])
