"""Nodes, faults and findings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


class Fault(Exception):
    """An error that makes a document invalid; offsets are code points of the text at hand."""

    def __init__(self, message: str, start: int, end: int, category: str = "syntax"):
        super().__init__(message)
        self.message, self.start, self.end, self.category = message, start, end, category


class Exhausted(Exception):
    """A budget is used up: the document is neither valid nor invalid."""


class Unwritable(Exception):
    """A tree without a canonical text."""


@dataclass(slots=True)
class Node:
    """A tree node: ``data`` holds its scalar fields, ``slots`` its children by slot, in document order."""

    type: str
    data: dict = field(default_factory=dict)
    slots: dict[str, list[Node]] = field(default_factory=dict)
    span: tuple[int, int] | None = None

    def kids(self, slot: str = "children") -> list[Node]:
        return self.slots.get(slot, [])

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.slots:
                for kids in reversed(node.slots.values()):
                    stack.extend(reversed(kids))


@dataclass(slots=True)
class Finding:
    """A diagnostic: category syntax, semantic, advisory, resource or noncanonical."""

    category: str
    message: str
    start: int | None = None
    end: int | None = None

    @property
    def severity(self) -> str:
        return "warning" if self.category == "advisory" else "error"


#: Budgets of a comparison: nodes in all, and pairs that wait.
MOST_COMPARED, MOST_WAITING = 20_000_000, 200_000


def same(a: Node, b: Node, most_nodes: int = MOST_COMPARED, most_waiting: int = MOST_WAITING) -> bool:
    """Semantic equality: types, fields and children; spans don't count.  Exhausted beyond the budgets."""
    stack, compared = [(a, b)], 0
    while stack:
        compared += 1
        if compared > most_nodes or len(stack) > most_waiting:
            raise Exhausted("comparison budget exceeded")
        x, y = stack.pop()
        if x.type != y.type or x.data != y.data:
            return False
        mine, other = ({k: v for k, v in n.slots.items() if v} for n in (x, y))
        if mine.keys() != other.keys():
            return False
        for slot, kids in mine.items():
            if len(kids) != len(other[slot]):
                return False
            stack.extend(zip(kids, other[slot], strict=True))
    return True


#: Columns of the node table that come from ``Node.data``, with their types.
NODE_FIELDS = {
    "level": "int", "quote_level": "int", "kind": "string", "form": "string", "task": "string", "start_no": "int", "item_value": "int",
    "value": "string", "dest": "string", "title": "string", "identifier": "string", "block_id": "string", "container_type": "string",
    "container_title": "string", "code_lang": "string", "alignments": "array<string>", "grid_columns": "int", "grid_col": "int",
    "row_span": "int", "col_span": "int", "download": "boolean", "attr_group": "string", "attr_lang": "string", "attr_preview": "string",
    "data_attrs": "map<string,string>", "reason": "string",
}


def rows_of(root: Node, project=None) -> list[dict]:
    """The tree as rows in pre-order with nested-set intervals, so that an ancestor is a range."""
    out: list[dict] = []
    stack: list = [(root, None, 0, None, 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, int):
            out[item]["subtree_end"] = len(out) - 1
            continue
        node, parent, depth, slot, pos = item
        own = len(out)
        span = node.span and (project(node.span[0]), project(node.span[1])) if project else node.span
        out.append({"node_id": own, "parent_id": parent, "subtree_end": own, "depth": depth, "slot": slot, "pos": pos, "type": node.type, **node.data, "start_off": span and span[0], "end_off": span and span[1]})
        stack.append(own)
        for name, kids in reversed(list(node.slots.items())):
            for i in range(len(kids) - 1, -1, -1):
                stack.append((kids[i], own, depth + 1, name, i))
    return out
