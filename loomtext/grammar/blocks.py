"""The block reader: lines in, block nodes out."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from .attributes import context_fault, read_opener
from .chars import REFERENCE, WHITE, char, is_identifier, kind_of
from .inline import Scope, atom_end, read_inline, read_link
from .tree import Exhausted, Fault, Node

_BLANKS = " \t"
HEADING = re.compile(r" {0,3}(#{1,6})(?= |\Z)")
RULE = re.compile(r" {0,3}(?=[-*])[-* \t]+\Z")
SETEXT = re.compile(r" {0,3}(?:=+|-{3,})[ \t]*\Z")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*\Z)|~{3,})")
COMMENT = re.compile(r" {0,3}<!--")
LINED = re.compile(r"(_{3,})[ \t]*\Z")
COLONS = re.compile(r":{3,}")
QUOTE = re.compile(r"(?:> ?)+")
DEFINITION = re.compile(r"\[\^([A-Za-z0-9_-]+)\]: (?=.)", re.S)
SUFFIX = re.compile(r"\{.*\}\Z", re.S)
MARKER = re.compile(r"(?P<mark>[-*+:]|[0-9]+[.)])")
_ROW_MARK = re.compile(r"[|\\`$\[!<&]|h(?=ttp)")
_OPENERS = frozenset(" \t#-*+:0123456789>`~_![<={") | {""}
GRID_MARK = re.compile(r"(::|==|--|\^|<)[ \t]*\Z")
NOT_TYPE = re.compile(rf"[{WHITE}\x00-\x1f\x7f-\x9f<>\[\]{{}}|\\`]")
INTRODUCER = re.compile(r"#{1,6}(?: |\Z)|>|[-+*](?: |\Z)|!\[|<|[0-9]+[.)](?: |\Z)|`{3}|~{3}|:{3}|_{3,}\Z|(?=(?:[ \t]*[-*]){3})[-* \t]+\Z")
WITH_ID = frozenset(("paragraph", "codeBlock", "mathBlock", "imageBlock", "videoBlock", "audioBlock", "embedBlock", "downloadBlock", "quoteRegion", "list", "table", "container"))
CLOSED = ("list-item", "quote", "grid-cell")
#: Slots of a grid, unless a caller allows other; no caller may allow more than the second number.
MOST_SLOTS, HARD_SLOTS = 100_000, 1_000_000


def trim_end(text: str) -> str:
    return text.rstrip(_BLANKS)


def is_prose(line: str, following: str | None) -> bool:
    """Whether a line can only be paragraph text: no opener at its start, no pipe, no fence of underscores below."""
    return line[:1] not in _OPENERS and "|" not in line and not (following or "").startswith("___")


def is_blank(text: str) -> bool:
    return not text.strip(_BLANKS)


def split_id(line: str) -> tuple[str, str | None]:
    """A line without its `` {#id}`` tail, and the id; the id is not checked."""
    body = trim_end(line)
    if body.endswith("}") and (at := body.rfind(" {#", 0, len(body))) >= 0 and at + 2 < len(body):
        return body[:at], body[at + 3:-1]
    return body, None


def suffix_of(line: str) -> str | None:
    """The id of a line that is only ``{…}``; an empty text for a malformed one, None for other lines."""
    if line[:1] != "{":
        return None
    body = trim_end(line)
    if not (body.endswith("}") and len(body) > 1):
        return None
    own = body[2:-1] if body.startswith("{#") else ""
    return own if is_identifier(own) else ""


def is_rule(line: str) -> bool:
    return RULE.match(body := split_id(line)[0]) is not None and sum(map(body.count, "-*")) >= 3


def list_marker(line: str) -> dict | str | None:
    """Kind, number, task, indent and content column of a list line; a text says what is wrong with it."""
    body = line.lstrip(" ")
    if body.startswith("\t"):
        return "tab in list indentation" if list_marker_at(body.lstrip(_BLANKS), 1) is not None else None
    return list_marker_at(body, len(line) - len(body))


def list_marker_at(body: str, indent: int) -> dict | str | None:
    m = MARKER.match(body)
    if m is None:
        return None
    mark, rest = m["mark"], body[m.end():]
    number = None
    if mark[0].isdigit():
        if rest[:1].isascii() and rest[:1].isdigit():
            return None
        if len(mark[:-1].lstrip("0")) > 9:
            return "ordered list number exceeds range"
        kind, number = "ordered", int(mark[:-1])
    else:
        if mark == "-" and rest.startswith("-") or mark in "*+" and rest and rest[0] != " ":
            return None
        if mark == ":" and indent == 0 and (run := COLONS.match(body)) and body[run.end():run.end() + 1] not in ("", " ", "\t"):
            return "a fenced container's name follows its fence after a space"
        kind = "definition" if mark == ":" else "unordered"
    if not rest.startswith(" "):
        return "list marker requires a space after it"
    content = rest.lstrip(" ")
    if not content:
        return "empty list item"
    column, task = indent + len(body) - len(content), None
    if kind != "definition" and re.match(r"\[[ xX]\]", content):
        if content[3:4] != " " or len(content) <= 4:
            return "task marker requires one space and content"
        task, column = "open" if content[1] == " " else "done", column + 4
    return {"kind": kind, "number": number, "task": task, "indent": indent, "column": column}


class RowScan:
    """A table row cut at the pipes that no escape and no inline token hides."""

    def __init__(self, line: str):
        row, self.cells, self.live = trim_end(line), [], False
        if "|" not in row:
            self.cells = [self._trim(row, 0, len(row))]
            return
        at = begin = 1 if row.startswith("|") else 0
        self.live, end = begin == 1, len(row)
        while m := _ROW_MARK.search(row, at, end):
            at = m.start()
            if row[at] == "\\":
                at += 2 if at + 1 < end else 1
            elif row[at] == "|":
                self.live = True
                if at + 1 == end:
                    end -= 1
                    break
                self.cells.append(self._trim(row, begin, at))
                begin = at = at + 1
            else:
                at = max(at + 1, atom_end(row, at, len(row), at > 0 and kind_of(row[at - 1]) == "W"))
        self.cells.append(self._trim(row, begin, end))

    @staticmethod
    def _trim(row: str, a: int, b: int) -> tuple[int, int]:
        while a < b and row[a] in _BLANKS:
            a += 1
        while b > a and row[b - 1] in _BLANKS:
            b -= 1
        return a, b

    def alignments(self, line: str) -> list[str] | None:
        """What the cells say if the row is a separator."""
        out = []
        for a, b in self.cells:
            m = re.fullmatch(r"(:?)-+(:?)", line[a:b])
            if m is None:
                return None
            out.append(("default", "left", "right", "center")[bool(m[1]) + 2 * bool(m[2])])
        return out


def starts_table(line: str, following: str | None) -> bool:
    return following is not None and "|" in line and "|" in following and RowScan(line).live and (sep := RowScan(following)).live and sep.alignments(following) is not None


class Literal:
    """Whether lines lie in a code fence or comment, line by line."""

    def __init__(self):
        self.inside: tuple[str, int] | None = None

    def step(self, line: str) -> bool:
        """Takes the next line and says whether it is part of a literal region."""
        if self.inside:
            mark, size = self.inside
            if mark == "<" and "-->" in line or mark != "<" and re.match(rf" {{0,3}}{re.escape(mark)}{{{size},}}[ \t]*\Z", line):
                self.inside = None
            return True
        if m := FENCE.match(line):
            self.inside = (m[2][0], len(m[2]))
            return True
        if m := COMMENT.match(line):
            self.inside = None if "-->" in line[m.end():] else ("<", 0)
            return True
        return False


class BlockReader:
    """Reads the blocks of a text; ``project`` maps its offsets to those of the document."""

    def __init__(self, text: str, project: Callable[[int], int] | None = None, note=None, most_slots: int = MOST_SLOTS):
        self.text, self.note, self.outer, self.most_slots = text, note, project is None, most_slots
        self.project = project or (lambda at: at)
        self.rows = text.split("\n")
        self.starts = [0]
        for row in self.rows:
            self.starts.append(self.starts[-1] + len(row) + 1)
        if self.rows[-1] == "":
            self.rows.pop()
        self.at = 0
        self.scans: dict[str, tuple[int, list[tuple[int, int]], bytearray, dict[int, list[int]]]] = {}
        self.last_pair: int | None = None

    # lines

    def line(self, ahead: int = 0) -> str | None:
        return self.rows[self.at + ahead] if self.at + ahead < len(self.rows) else None

    def begin(self, k: int) -> int:
        return self.starts[k]

    def end(self, k: int) -> int:
        return self.starts[k] + len(self.rows[k])

    def fault(self, why: str, first: int, last: int | None = None, category: str = "syntax") -> Fault:
        last = first if last is None else last
        return Fault(why, self.project(self.begin(first)), self.project(self.end(min(last, len(self.rows) - 1))), category)

    def _inline(self, a: int, b: int, first: int, last: int, **more) -> list[Node]:
        note = self.note and (lambda why, x, y: self.note(why, self.project(x), self.project(y)))
        try:
            nodes = read_inline(self.text, a, b, Scope(note=note, **more))
        except Fault as f:
            raise self.fault(f.message, first, last, f.category) from None
        return self._placed(nodes)

    def _placed(self, nodes: list[Node]) -> list[Node]:
        for top in () if self.outer else nodes:
            for n in top.walk():
                n.span = n.span and (self.project(n.span[0]), self.project(n.span[1]))
        return nodes

    def _span(self, node: Node, first: int, last: int) -> Node:
        node.span = (self.project(self.begin(first)), self.project(self.end(last)))
        return node

    # sequences

    def sequence(self, context: str, stop: Callable[[int], bool] = lambda k: False) -> list[Node]:
        """Blocks up to a boundary, with their ids."""
        blocks, after_blank, closed = [], True, context in CLOSED
        category = "semantic" if closed else "syntax"
        while (line := self.line()) is not None:
            if is_blank(line):
                self.at += 1
                after_blank = True
                continue
            if stop(self.at):
                break
            if (own := suffix_of(line)) is not None:
                self.at += 1
                raise self.fault("block id after blank line" if own and after_blank else "invalid block id suffix", self.at - 1, category=category)
            node = self.block(context, stop)
            if closed and "block_id" in node.data:
                raise Fault(f"block id not permitted at {context} scope", *node.span, "semantic")
            self.attach(node, not closed, category)
            blocks.append(node)
            after_blank = False
        return blocks

    def attach(self, node: Node, allowed: bool, category: str) -> None:
        """Takes an id line right below a block."""
        line = self.line()
        if line is None or (own := suffix_of(line)) is None:
            return
        self.at += 1
        if not (own and allowed and node.type in WITH_ID):
            raise self.fault("invalid block id suffix", self.at - 1, category=category)
        node.data["block_id"] = own
        node.span = (node.span[0], self.project(self.end(self.at - 1)))

    def block(self, context: str, stop: Callable[[int], bool]) -> Node:
        """The block that starts on this line."""
        line = self.line()
        if is_prose(line, self.line(1)):
            return self._paragraph(context, stop)
        for reader in (self._lined, self._fenced):
            if node := reader(context):
                return node
        if COMMENT.match(line):
            return self._comment()
        if FENCE.match(line):
            return self._fence()
        first = self.at
        if node := self._heading(line) or self._rule(line):
            if context == "list-item":
                raise self.fault(f"{node.type} not permitted in list item", first, category="semantic")
            return node
        return self._list(line) or self._quote(line, stop) or self._table(line) or self._resource(line) or self._paragraph(context, stop)

    # leaves

    def _comment(self) -> Node:
        first = self.at
        begin = self.begin(first) + COMMENT.match(self.rows[first]).end()
        close = self.text.find("-->", begin)
        last = bisect_right(self.starts, close) - 1 if close >= 0 else len(self.rows) - 1
        self.at = last + 1
        if close < 0:
            raise self.fault("unclosed comment", first, last)
        if not is_blank(self.text[close + 3:self.end(last)]):
            raise self.fault("content after comment closer", first, last)
        return self._span(Node("commentBlock", {"value": self.text[begin:close]}), first, last)

    def _fence(self) -> Node:
        first, m = self.at, FENCE.match(self.rows[self.at])
        info = self.rows[first][m.end():].strip(_BLANKS)
        closer = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*\Z")
        last = next((k for k in range(first + 1, len(self.rows)) if closer.match(self.rows[k])), None)
        self.at = len(self.rows) if last is None else last + 1
        if re.search(r"[ \t]", info):
            raise self.fault("code fence info string must be one token", first, self.at - 1)
        if last is None:
            raise self.fault("unclosed code fence", first, self.at - 1)
        data = {"value": "\n".join(self.rows[first + 1:last])} | ({"code_lang": info} if info and info != "math" else {})
        return self._span(Node("mathBlock" if info == "math" else "codeBlock", data), first, last)

    def _heading(self, line: str) -> Node | None:
        m = HEADING.match(line)
        if m is None:
            return None
        first = self.at
        self.at += 1
        body, own = split_id(line)
        if own is not None and not is_identifier(own):
            raise self.fault("invalid block id suffix", first)
        content = trim_end(body[m.end():])
        bare = content.rstrip("#")
        if bare != content and (bare.endswith(" ")):
            content = trim_end(bare)
        skipped = len(content) - len(content.lstrip(" "))
        a = self.begin(first) + m.end() + skipped
        nodes = self._inline(a, a + len(content) - skipped, first, first) if content.strip(" ") else []
        if not nodes:
            raise self.fault("empty heading", first)
        return self._span(Node("heading", {"level": len(m[1])} | ({"block_id": own} if own else {}), {"children": nodes}), first, first)

    def _rule(self, line: str) -> Node | None:
        if not is_rule(line):
            return None
        first = self.at
        self.at += 1
        body, own = split_id(line)
        if own is not None and not is_identifier(own):
            raise self.fault("invalid block id suffix", first)
        if "-" in body and "*" in body:
            raise self.fault("mixed thematic-break characters", first)
        return self._span(Node("horizontalRule", {"block_id": own} if own else {}), first, first)

    def _paragraph(self, context: str, stop: Callable[[int], bool]) -> Node:
        first = self.at
        while (line := self.line()) is not None and not is_blank(line) and not stop(self.at) and suffix_of(line) is None:
            if self.at > first and self._interrupts(first, line, context, stop):
                break
            self.at += 1
        last = self.at - 1
        node = self._span(Node("paragraph", {}, {"children": self._paragraph_inline(first, last)}), first, last)
        if self.note and re.match(r" *\t| {4}", self.rows[first]):
            self.note("leading indentation on this block is dropped", *node.span)
        return node

    def _interrupts(self, first: int, line: str, context: str, stop) -> bool:
        """Whether a line inside a paragraph starts something else; a Setext underline is a fault."""
        following = self.line(1)
        if is_prose(line, following):
            return False
        if context == "document" and DEFINITION.match(line) or self._starts_resource(line) or starts_table(line, following):
            return True
        if LINED.match(line) and INTRODUCER.match(self.rows[first]):
            return True
        if following is not None and not stop(self.at + 1) and LINED.match(following) and not line.startswith(" ") and not LINED.match(line) and not INTRODUCER.match(line):
            return True
        if SETEXT.match(line):
            self.at += 1
            raise self.fault("setext heading not permitted", first, self.at - 1)
        return bool(line.startswith(">") or list_marker(line) is not None or COMMENT.match(line) or FENCE.match(line) or HEADING.match(line) or is_rule(line))

    def _paragraph_inline(self, first: int, last: int) -> list[Node]:
        out: list[Node] = []
        edges = []
        for k in range(first, last + 1):
            row = self.rows[k]
            inner = row.lstrip(WHITE)
            a = self.begin(k) + len(row) - len(inner)
            edges.append((a, a + len(inner.rstrip(WHITE))))
        if first == last:
            body = self.text[slice(*edges[0])]
            if body and not body.strip("="):
                return [Node("text", {"value": body}, span=tuple(map(self.project, edges[0])))]
            if not body:
                raise self.fault("empty paragraph", first, last)
            return self._inline(*edges[0], first, last, paragraph_at=edges[0][0])
        chunk = 0
        for i, (a, b) in enumerate(edges):
            hard, stop = False, b
            if i + 1 < len(edges):
                row, body = self.rows[first + i], self.text[a:b]
                slashes = len(body) - len(body.rstrip("\\"))
                if row.endswith("  ") and not is_blank(body):
                    hard = True
                elif slashes % 2 and not is_blank(body[:-slashes]):
                    hard, stop = True, a + len(body[:-1].rstrip(WHITE))
                if not hard:
                    continue
            breaks = {edges[j][1]: (edges[j + 1][0], self.end(first + j), self.begin(first + j + 1)) for j in range(chunk, i)}
            begin = edges[chunk][0]
            out += self._inline(begin, stop, first, last, breaks=breaks, **({"paragraph_at": begin} if chunk == 0 else {}))
            if hard:
                out.append(Node("hardBreak", span=(self.project(stop), self.project(b))))
                chunk = i + 1
        if not out:
            raise self.fault("empty paragraph", first, last)
        return out

    # quotes and lists

    def _nested(self, pieces: list[tuple[int, int]]) -> tuple[BlockReader, Callable[[int], int]]:
        """A reader over the tails of lines: (line, offset in the text where it starts)."""
        text = "".join(self.text[a:self.begin(k + 1)] for k, a in pieces)
        begins, total = [], 0
        for k, a in pieces:
            begins.append(total)
            total += min(self.begin(k + 1), len(self.text)) - a

        def project(at: int) -> int:
            i = max(0, bisect_right(begins, at) - 1)
            k, a = pieces[i]
            return self.project(min(a + at - begins[i], self.begin(k + 1)))

        return BlockReader(text, project, self.note, self.most_slots), project

    def _quote(self, line: str, stop) -> Node | None:
        if not line.startswith(">"):
            return None
        first, depth, pieces = self.at, 1, []
        while (row := self.line()) is not None and row.startswith(">"):
            m = QUOTE.match(row)
            level, rest = m[0].count(">"), row[m.end():]
            self.at += 1
            if "\t" == row[len(m[0].rstrip(" ")):][:1]:
                raise self.fault("tab in quote prefix", first, self.at - 1)
            if first == self.at - 1 and level != 1:
                raise self.fault("quote must start at depth 1", first)
            if not rest:
                if level > depth:
                    raise self.fault("empty quote line opens a deeper level", first, self.at - 1)
            elif level > depth + 1:
                raise self.fault("quote depth rises by more than one", first, self.at - 1)
            else:
                depth = level
            pieces.append((level, self.at - 1, self.begin(self.at - 1) + m.end()))
        last, kids, i = self.at - 1, [], 0
        while i < len(pieces):
            level, j = pieces[i][0], i
            while j < len(pieces) and pieces[j][0] == level:
                j += 1
            reader, _ = self._nested([(k, a) for _, k, a in pieces[i:j]])
            try:
                found = reader.sequence("quote")
            except Fault as f:
                raise self.fault(f.message, first, last, f.category) from None
            for node in found:
                node.data["quote_level"] = level
            kids += found
            i = j
        if not kids:
            raise self.fault("empty quote region", first, last, "semantic")
        slots = {"children": kids}
        row = self.line()
        if row is not None and row.startswith("-- ") and len(row) > 3:
            self.at += 1
            nodes = self._inline(self.begin(self.at - 1) + 3, self.end(self.at - 1), first, self.at - 1)
            if not nodes:
                raise self.fault("invalid quote attribution", first, self.at - 1, "semantic")
            slots["attribution"], last = nodes, self.at - 1
        elif row is not None and self.note and not is_blank(row) and not stop(self.at) and suffix_of(row) is None:
            self.note("a line without > ends the quote", self.project(self.begin(self.at)), self.project(self.end(self.at)))
        return self._span(Node("quoteRegion", {}, slots), first, last)

    def _list(self, line: str) -> Node | None:
        head = list_marker(line)
        if head is None:
            return None
        first = self.at
        if isinstance(head, str) or head["indent"]:
            self.at += 1
            raise self.fault(head if isinstance(head, str) else "a list that is not nested in a list item starts without indentation", first)
        items, previous = [], head["number"]
        while (row := self.line()) is not None:
            mark = list_marker(row)
            if not isinstance(mark, dict) or mark["indent"] or mark["kind"] != head["kind"]:
                break
            begin, pieces = self.at, self._item_lines(first, mark)
            reader, _ = self._nested(pieces)
            last = pieces[-1][0]
            try:
                kids = reader.sequence("list-item")
            except Fault as f:
                raise self.fault(f.message, first, last, f.category) from None
            if not kids or kids[0].type != "paragraph":
                raise self.fault("list item must begin with inline paragraph", first, last)
            data = {"task": mark["task"]} if mark["task"] else {}
            if items and mark["number"] is not None and mark["number"] != previous + 1:
                data["item_value"] = mark["number"]
            previous = mark["number"]
            items.append(self._span(Node("listItem", data, {"children": kids}), begin, last))
            end = last
        data = {"kind": head["kind"]} | ({"start_no": head["number"]} if head["number"] not in (None, 1) else {})
        return self._span(Node("list", data, {"items": items}), first, end)

    def _item_lines(self, first: int, mark: dict) -> list[tuple[int, int]]:
        """The lines of one item, each with the offset where its content starts.

        Columns stand relative to the item's own marker: a nested list is read at 2, at the
        content column or at 4; what lies two deeper than the last nested marker is its.
        """
        pieces = [(self.at, self.begin(self.at) + mark["column"])]
        own_column = mark["column"] - (4 if mark["task"] else 0)
        base, nested, met, blank = 2, None, False, False
        fence: tuple[str, int, int] | None = None
        comment = False
        self.at += 1
        while (row := self.line()) is not None:
            if row == "":
                blank, strip = True, 0
            else:
                lead = len(row) - len(row.lstrip(" "))
                if fence:
                    mark_char, size, strip = fence
                    if lead < strip:
                        break
                    if re.match(rf" {{0,3}}{re.escape(mark_char)}{{{size},}}[ \t]*\Z", row[strip:]):
                        fence = None
                    pieces.append((self.at, self.begin(self.at) + strip))
                    self.at += 1
                    continue
                found = list_marker(row)
                marked = isinstance(found, dict)
                if marked and not found["indent"]:
                    break
                if marked and not comment and lead >= 2:
                    if nested is not None and lead >= nested + 2:
                        strip = nested
                    elif lead in (2, 4, own_column):
                        base = 2 if lead == 2 else base if met else lead
                        met, nested, strip = True, lead, lead
                    else:
                        self.at += 1
                        raise self.fault("nested list marker on a column that is not read", first, self.at - 1)
                else:
                    if lead < base:
                        break
                    if nested is not None and lead >= nested + 2:
                        strip = nested
                    else:
                        lazy = not blank and not marked and lead <= base + 3
                        strip = lead if lazy else lead - 1 if nested is not None and lead - base >= 2 else base
                        nested = nested if comment else None
                tail = row[strip:]
                if comment:
                    comment = "-->" not in tail
                elif m := FENCE.match(tail):
                    fence = (m[2][0], len(m[2]), base if nested is None else nested)
                elif m := COMMENT.match(tail):
                    comment = "-->" not in tail[m.end():]
            pieces.append((self.at, self.begin(self.at) + strip))
            self.at += 1
        while len(pieces) > 1 and self.rows[pieces[-1][0]] == "":
            pieces.pop()
        return pieces

    # tables and resources

    def _table(self, line: str) -> Node | None:
        following = self.line(1)
        if not starts_table(line, following):
            return None
        first = self.at
        alignments = RowScan(following).alignments(following)
        self.at += 2
        if len(alignments) != len(RowScan(line).cells):
            raise self.fault("table separator cell count differs from the header", first, first + 1)
        body, last = [], first + 1
        head = self._row(first, first)
        while (row := self.line()) is not None and "|" in row and (scan := RowScan(row)).live:
            self.at += 1
            if len(scan.cells) != len(alignments):
                raise self.fault("table row cell count differs from the header", first, self.at - 1)
            last = self.at - 1
            body.append(self._row(last, first))
        return self._span(Node("table", {"alignments": alignments}, {"head": [head], "body": body}), first, last)

    def _row(self, k: int, first: int) -> Node:
        cells, at = [], self.begin(k)
        for a, b in RowScan(self.rows[k]).cells:
            cells.append(Node("tableCell", {}, {"children": self._inline(at + a, at + b, first, k, cell=True)}, (self.project(at + a), self.project(at + b))))
        return self._span(Node("tableRow", {}, {"cells": cells}), k, k)

    def _starts_resource(self, line: str) -> bool:
        row, bare = trim_end(line), line.startswith("![")
        if not bare and not line.startswith("<m"):
            return False
        try:
            opened = None if bare else read_opener(row, 0, len(row))
            if not bare and opened is None:
                return False
            begin, end = opened[2] if opened else 0, len(row) - row.endswith("\\")
            if not bare:
                if row.endswith("</m>") and len(row) - 4 >= begin:
                    end = len(row) - 4
                elif end == len(row):
                    return False
            found = read_link(row, begin, end, Scope(), True) if row.startswith(("[", "!["), begin, end) else None
        except Fault:
            return True
        return found is not None and found.span[1] == end or not bare and opened[0] is not None

    def _resource(self, line: str) -> Node | None:
        bare = line.startswith("![")
        if not bare and not line.startswith("<m"):
            return None
        first, row, base = self.at, trim_end(line), self.begin(self.at)
        try:
            opened = (None, {}, 0) if bare else read_opener(row, 0, len(row))
        except Fault as f:
            self.at += 1
            raise self.fault(f.message, first, category=f.category) from None
        if opened is None:
            return None
        kind, attrs, begin = opened
        end, caption = len(row), None
        below = trim_end(self.line(1)) if self.line(1) is not None else ""
        if not bare and row.endswith("</m>") and len(row) - 4 >= begin:
            end -= 4
        elif row.endswith("\\") and len(row) > begin:
            tail = "*" if bare else "*</m>"
            if below.startswith("*") and below.endswith(tail) and len(below) > len(tail) + (0 if bare else 1):
                caption, end = (1, len(below) - len(tail)), end - 1
            elif bare and below.startswith("*"):
                self.at += 2
                raise self.fault("resource caption is single-line", first, first + 1)
        if not bare and caption is None and end == len(row):
            if kind is None:
                return None
            self.at += 1
            raise self.fault("unclosed <m> wrapper", first)
        last = first + (caption is not None)

        def bad(why: str, category: str = "semantic") -> Fault:
            self.at = last + 1
            return self.fault(why, first, last, category)

        note = self.note and (lambda why, x, y: self.note(why, self.project(x), self.project(y)))
        wants_image = bare or kind is None
        try:
            target = read_link(self.text, base + begin, base + end, Scope(note=note), True) if row.startswith(("[", "!["), begin, end) else None
        except Fault as f:
            raise bad(f.message, f.category) from None
        if target is None or target.span[1] != base + end:
            if wants_image:
                return None
            raise bad("typed resource requires one primary link" if target is None else "extra text in typed resource")
        if wants_image != (target.type == "inlineImage"):
            raise bad("resource primary type conflict")
        if not bare and kind is None and not attrs:
            raise bad("metadata wrapper adds no semantics")
        if why := context_fault(kind or "image", attrs):
            raise bad(why)
        slots = {"alt" if wants_image else "label": self._placed(target.kids("alt" if wants_image else "children"))}
        if caption:
            at = self.begin(first + 1)
            slots["caption"] = self._inline(at + caption[0], at + caption[1], first, last)
            if not slots["caption"]:
                raise bad("invalid resource caption")
        self.at = last + 1
        return self._span(Node(f"{kind or 'image'}Block", target.data | attrs, slots), first, last)

    # containers and grids

    def _header(self, text: str, first: int, last: int) -> dict:
        """TYPE and TITLE of a container."""
        parts = text.strip(_BLANKS)
        if not parts:
            return {"container_type": None, "container_title": None}
        name, _, title = parts.replace("\t", " ").partition(" ")
        if NOT_TYPE.search(name):
            self.at = last + 1
            raise self.fault("invalid TYPE character", first, last)
        return {"container_type": unicodedata.normalize("NFC", name), "container_title": parts[len(name):].strip(_BLANKS) or None}

    def _closer(self, mark: str, size: int) -> int | None:
        """The line that closes a container, code fences and comments skipped.

        One scan finds the closing lines of all openers below its start; it holds for a later
        line too, unless that lies in what the scan took for a literal region.
        """
        scan = self.scans.get(mark)
        if scan is None or self.at < scan[0] or self.at - scan[0] < len(scan[2]) and scan[2][self.at - scan[0]]:
            literal, closing, found, inside = Literal(), re.compile(rf"{mark}{{3,}}[ \t]*\Z"), [], bytearray()
            for k in range(self.at, len(self.rows)):
                inside.append(literal.inside is not None)
                if not literal.step(self.rows[k]) and closing.match(self.rows[k]):
                    found.append((k, self.rows[k].count(mark)))
            scan = self.scans[mark] = (self.at, found, inside, {})
        if size not in scan[3]:
            scan[3][size] = [k for k, n in scan[1] if n >= size]
        lines = scan[3][size]
        i = bisect_left(lines, self.at)
        return lines[i] if i < len(lines) else None

    def _lined(self, context: str) -> Node | None:
        line, following = self.line(), self.line(1)
        own = LINED.match(line)
        below = None if own or following is None or line.startswith(" ") or INTRODUCER.match(line) else LINED.match(following)
        if not own and not below:
            return None
        first = self.at
        if context == "lined-body":
            if below and self._lined_inside():
                raise self.fault("forbidden container nesting", first, first + 1, "semantic")
            return None
        if context != "document":
            raise self.fault("forbidden container nesting", first, first + bool(below), "semantic")
        data = self._header(line if below else "", first, first + 1)
        self.at += 2 if below else 1
        opened = self.at - 1
        last = self._closer("_", len((own or below)[1]))
        if last is None:
            raise self.fault("unclosed lined container", first, opened)
        kids = self.sequence("lined-body", lambda k: k == last)
        if not kids:
            raise self.fault("empty container", first, last, "semantic")
        self.at = last + 1
        return self._span(Node("container", {"form": "lined", **data}, {"children": kids}), first, last)

    def _lined_inside(self) -> bool:
        """Two closing fences in a row after this line, with nothing between: a lined container in a lined one."""
        if self.last_pair is None:
            self.last_pair = -1
            fences = [(k, bool(LINED.match(r))) for k, r in enumerate(self.rows) if not is_blank(r)]
            before = None
            for i, (k, fence) in enumerate(fences):
                closes = fence and not (i + 1 < len(fences) and not fences[i + 1][1])
                if closes and before is not None:
                    self.last_pair = before
                before = k if closes else None
        return self.last_pair >= self.at + 2

    def _fenced(self, context: str) -> Node | None:
        line = self.line()
        m = COLONS.match(line)
        if m is None:
            return None
        first = self.at
        if context in ("fenced-body", *CLOSED):
            raise self.fault("forbidden container nesting", first, category="semantic")
        if line[m.end():m.end() + 1] not in ("", " ", "\t"):
            return None
        data = self._header(line[m.end():], first, first)
        self.at += 1
        last = self._closer(":", m.end())
        if last is None:
            raise self.fault("unclosed fenced container", first)
        from .grid import read_grid

        kids = read_grid(self, first, last)
        if kids is None:
            kids = self.sequence("fenced-body", lambda k: k == last)
        if not kids:
            raise self.fault("empty container", first, last, "semantic")
        self.at = last + 1
        return self._span(Node("container", {"form": "fenced", **data}, {"children": kids}), first, last)

    # the document

    def definition(self) -> Node | None:
        """A footnote definition on this line."""
        line = self.line()
        m = DEFINITION.match(line)
        if m is None:
            return None
        first = self.at
        self.at += 1
        nodes = self._inline(self.begin(first) + m.end(), self.end(first), first, first)
        if not nodes:
            raise self.fault("empty footnote definition", first)
        if any(n.type == "footnoteReference" for top in nodes for n in top.walk()):
            raise self.fault("footnote definition contains a nested footnote reference", first, category="semantic")
        return self._span(Node("footnoteDefinition", {"identifier": m[1]}, {"children": nodes}), first, first)


def slots_guard(columns: int, rows: int, most: int = MOST_SLOTS) -> None:
    if columns * rows > most:
        raise Exhausted("grid matrix slot budget exceeded")


__all__ = ["BlockReader", "REFERENCE", "char"]
