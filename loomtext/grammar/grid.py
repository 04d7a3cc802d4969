"""Two-dimensional grids in fenced containers."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from .blocks import GRID_MARK, Literal, slots_guard
from .tree import Node

if TYPE_CHECKING:
    from .blocks import BlockReader

_TICKS_OR_ESCAPE = re.compile(r"\\.|`+", re.S)


def code_state(line: str, run: int) -> int:
    """The run of backticks that is open after a line, 0 if none."""
    for m in _TICKS_OR_ESCAPE.finditer(line):
        if m[0][0] == "\\":
            if run and len(m[0]) == 2 and m[0][1] == "`":  # inside code a backslash hides nothing
                run = 0 if run == 1 else run
            continue
        size = len(m[0])
        run = size if not run else 0 if size == run else run
    return run


def _events(reader: BlockReader, last: int) -> list[tuple[str, list[int]]] | None:
    """Separators, continuations and content slots of a body; None if no separator is there."""
    literal, code, slot, pending = Literal(), 0, [], None
    out: list[tuple[str, list[int]]] = []
    opened = None

    def flush(empty: bool) -> None:
        nonlocal slot, pending
        if pending is not None:
            out.append((reader.rows[pending][0], [pending]))
        elif slot or empty:
            out.append(("content", slot))
        slot, pending = [], None

    for k in range(reader.at, last):
        row = reader.rows[k]
        if code:
            code, mark = code_state(row, code), None
        elif literal.step(row):
            mark = None
        else:
            code = code_state(row, 0)
            mark = None if code else GRID_MARK.match(row)
        if mark and mark[1] in ("^", "<") and not slot and pending is None:
            pending, opened = k, None
        elif mark is None or mark[1] in ("^", "<"):
            if pending is not None:
                slot, pending = [pending], None
            slot.append(k)
            opened = None if not code and not literal.inside else opened
        else:
            flush(mark[1] != "::" or bool(out))
            out.append((mark[1], []))
            opened = mark[1]
    flush(opened is not None and opened != "::")
    return out if any(kind in ("::", "==", "--") for kind, _ in out) else None


def read_grid(reader: BlockReader, first: int, last: int) -> list[Node] | None:
    """The grid between two container fences; None if the body is an ordinary one."""
    events = _events(reader, last)
    if events is None:
        return None

    def bad(why: str, category: str = "semantic"):
        return reader.fault(why, first, last, category)

    rows: list[list[tuple[str, list[int]]]] = [[]]
    header = 0
    for kind, lines in events:
        if kind == "::":
            if header:
                raise bad("duplicate grid header separator", "syntax")
            header = len(rows)
            rows.append([])
        elif kind == "==":
            rows.append([])
        elif kind != "--":
            rows[-1].append((kind, lines))
    if header and not any(rows[:header]):
        raise bad("empty grid header", "syntax")
    if header and not any(rows[header:]):
        raise bad("empty grid body", "syntax")
    width = len(rows[0])
    if any(len(r) != width for r in rows):
        raise bad("ragged grid")
    if any(kind == "content" and not lines for r in rows for kind, lines in r):
        raise bad("empty grid cell")
    if not header and width == 1 and len(rows) == 1:
        raise bad("headerless 1x1 grid")
    slots_guard(width, len(rows), reader.most_slots)
    made: list[tuple[Node, list[int]]] = []
    parts = {}
    for name, part in (("header", rows[:header]), ("rows", rows[header:])):
        if part:
            parts[name] = _region(reader, part, width, bad, made)
    for cell, lines in made:
        reader.at = lines[0]
        cell.slots["children"] = reader.sequence("grid-cell", lambda k, stop=lines[-1] + 1: k >= stop)
    grid = Node("grid", {"grid_columns": width}, parts)
    return [reader._span(grid, first + 1, last - 1)]


def _region(reader: BlockReader, rows, width: int, bad, made) -> list[Node]:
    """Owners of all slots, spans of the anchors, and the test that each span is a rectangle."""
    owner: dict[tuple[int, int], int] = {}
    cells: list[tuple[int, int, Node]] = []
    for r, row in enumerate(rows):
        for c, (kind, lines) in enumerate(row):
            if kind == "content":
                owner[r, c] = len(cells)
                node = reader._span(Node("gridCell", {"grid_col": c + 1}), lines[0], lines[-1])
                cells.append((r, c, node))
                made.append((node, lines))
            elif kind == "^":
                if r == 0:
                    raise bad("rowspan in first row")
                owner[r, c] = owner[r - 1, c]
            else:
                if c == 0:
                    raise bad("colspan in first column")
                owner[r, c] = owner[r, c - 1]
    held: dict[int, list[tuple[int, int]]] = {}
    for place, own in owner.items():
        held.setdefault(own, []).append(place)
    for own, places in held.items():
        high, wide = (max(p[i] for p in places) - min(p[i] for p in places) + 1 for i in (0, 1))
        if len(places) != high * wide:
            raise bad("non-rectangular grid span")
        cells[own][2].data |= ({"row_span": high} if high > 1 else {}) | ({"col_span": wide} if wide > 1 else {})
    out = []
    for r, row in enumerate(rows):
        node = Node("gridRow", {}, {"cells": [n for rr, _, n in cells if rr == r]})
        out.append(reader._span(node, row[0][1][0], row[-1][1][-1]))
    return out
