"""The seven computations over one document: read, write, check, validate, compare, adopt, with their verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from .chars import is_identifier, is_white
from .document import Parsed, footnote_order, read_document, references
from .tree import Exhausted, Finding, Node, Unwritable, same
from .writer import write_document

MOST_ATTEMPTS = 1000
NO_OWN_ID = ("commentBlock", "grid")


def canonical_text(raw: str | None) -> str | None:
    """The canonical text of a valid document, None for others and for those without one."""
    parsed = read_document(raw)
    return _written(parsed)


def _written(parsed: Parsed) -> str | None:
    try:
        return write_document(parsed.tree) if parsed.status == "ok" else None
    except (Unwritable, RecursionError):
        return None


def check_canonical(raw: str | None) -> tuple[str, str | None, list[Finding]]:
    """canonical, noncanonical (with the text to have), invalid or resource, and the reasons."""
    parsed = read_document(raw)
    if parsed.status != "ok":
        return parsed.status, None, parsed.findings
    text = _written(parsed)
    if text is None:
        return "invalid", None, [Finding("semantic", "cannot format document")]
    own = parsed.transport
    if own.canonical and text == raw:
        return "canonical", text, []
    why = [w for w, so in (("input has a UTF-8 BOM", own.had_bom), ("input uses CRLF line endings", own.crlf), ("input does not end with exactly one newline", own.final_lf != 1)) if so]
    return "noncanonical", text, [Finding("noncanonical", w) for w in why or ["surface differs from the canonical form"]]


def validate(doc: Node, identity: bool = False) -> tuple[str, list[Finding]]:
    """Ids and scopes, footnotes, anchors, edge white space, and that the canonical text reads back the same."""
    found: list[Finding] = []
    ids: set[str] = set()
    for node, scope in _scoped(doc):
        own = node.data.get("block_id")
        if own is None:
            if identity and scope in ("document", "container") and node.type not in NO_OWN_ID:
                found.append(Finding("semantic", f"block id required at {scope} scope for {node.type}"))
        elif scope not in ("document", "container"):
            found.append(Finding("semantic", f"block id {{#{own}}} not permitted at {scope} scope"))
        elif not is_identifier(own) or own in ids:
            found.append(Finding("semantic", f"{'duplicate' if own in ids else 'invalid'} block id {{#{own}}}"))
        else:
            ids.add(own)
    names = [n.data["identifier"] for n in doc.kids("footnotes")]
    found += [Finding("semantic", f"duplicate footnote definition [^{n}]") for n in dict.fromkeys(names) if names.count(n) > 1]
    used = dict.fromkeys(r.data["identifier"] for r in references(doc.kids()))
    found += [Finding("semantic", f"footnote reference [^{n}] has no definition") for n in used if n not in names]
    found += [Finding("advisory", f"footnote definition [^{n}] is never referenced") for n in dict.fromkeys(names) if n not in used]
    for node in doc.walk():
        dest = node.data.get("dest") or ""
        if node.type == "link" and dest.startswith("#") and is_identifier(dest[1:]) and dest[1:] not in ids:
            found.append(Finding("advisory", f"link to unresolved document anchor {dest}"))
    found += [Finding("semantic", why) for node in doc.walk() for why in _white_faults(node)]
    if not any(f.severity == "error" for f in found):
        try:
            back = read_document(write_document(doc))
            if back.status != "ok" or not same(back.tree, doc):
                found.append(Finding("semantic", "the tree has no canonical surface"))
        except Unwritable as e:
            found.append(Finding("semantic", f"cannot format document: {e}"))
        except (Exhausted, RecursionError):
            return "resource", [*found, Finding("resource", "formatter frame budget exceeded")]
    return "invalid" if any(f.severity == "error" for f in found) else "ok", found


def _scoped(doc: Node):
    """Every block with the scope it stands in."""
    stack = [(b, "document") for b in reversed([*doc.kids("footnotes"), *doc.kids()])]
    while stack:
        node, scope = stack.pop()
        if node.type not in ("grid", "gridRow", "gridCell", "listItem"):
            yield node, scope
        inner = {"container": "container", "quoteRegion": "quoteRegion", "listItem": "listItem", "gridCell": "gridCell"}.get(node.type, scope)
        if node.type in ("container", "quoteRegion", "list", "listItem", "grid", "gridRow", "gridCell"):
            stack += [(k, inner) for slot, kids in node.slots.items() if slot != "attribution" for k in reversed(kids)]


def _white_faults(node: Node):
    """White space at the edges of inline content and beside breaks."""
    for slot, kids in node.slots.items():
        text = [k.data.get("value", "") if k.type == "text" else "" for k in kids]
        outer = node.type in ("heading", "paragraph", "tableCell") and slot == "children"
        if outer and kids and (is_white(text[0][:1]) or is_white(text[-1][-1:])):
            yield f"{node.type}: inline content begins or ends with white space"
        for i, k in enumerate(kids):
            if k.type in ("softBreak", "hardBreak") and (i and is_white(text[i - 1][-1:]) or i + 1 < len(kids) and is_white(text[i + 1][:1])):
                yield f"{node.type}: white space beside a line break"


def adopt(doc: Node, doc_id, new_id: Callable[[int, int], str] | None = None) -> int:
    """Gives every eligible block without an id a fresh one and says how many; ids that exist stay.

    Ids are made from the document's key and the block's number, so a run can be repeated.
    """
    def default(number: int, attempt: int) -> str:
        return "b" + hashlib.sha256(f"{doc_id}:{number}:{attempt}".encode()).hexdigest()[:12]

    make, taken, added = new_id or default, {n.data["block_id"] for n in doc.walk() if "block_id" in n.data}, 0
    for number, (node, scope) in enumerate(_scoped(doc)):
        if scope not in ("document", "container") or node.type in NO_OWN_ID or "block_id" in node.data:
            continue
        for attempt in range(MOST_ATTEMPTS):
            own = make(number, attempt)
            if not is_identifier(own):
                raise ValueError(f"{own!r} is not a block identifier")
            if own not in taken:
                break
        else:
            raise ValueError(f"no fresh identifier within {MOST_ATTEMPTS} attempts")
        taken.add(own)
        node.data["block_id"] = own
        added += 1
    return added


def equal(a: str | None, b: str | None) -> bool:
    """Whether two valid texts mean the same; False where one is invalid."""
    x, y = read_document(a), read_document(b)
    return x.status == y.status == "ok" and same(x.tree, y.tree)


__all__ = ["adopt", "canonical_text", "check_canonical", "equal", "footnote_order", "read_document", "validate"]
