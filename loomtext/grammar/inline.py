"""The inline reader: a stack of open delimiters over one slice of text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .attributes import context_fault, read_destination, read_opener
from .chars import PUNCTUATION, REFERENCE, WHITE, bare_url_end, char, entity, is_email, is_url, kind_of, is_white
from .tree import Fault, Node

#: Where something other than plain text may start; bare URLs are found apart, as their letter is too common.
#: One set comes first, as a search for it is fast; some of it counts only before the right character.
_SIGNIFICANT = re.compile(r"[\\`\[<&*_~^$!\-+=](?:(?<=[\\`\[<&*_~^])|(?<=-)(?=-)|(?<==)(?==)|(?<=\+)(?=\+)|(?<=!)(?=\[)|(?<=\$)(?=`))")
#: What lies before the next ``>`` that no backslash hides.
_BEFORE_ANGLE = re.compile(r"(?:[^>\\]++|\\.)*+", re.S)
_WHITE = re.compile(f"[{WHITE}]")
_DELIMITERS = {"**": "strong", "__": "strong", "~~": "deletion", "--": "obsolete", "++": "insert", "==": "mark", "*": "em", "_": "em"}
_ONE_LINE = ("obsolete", "insert", "mark")
_ESCAPED = re.compile(rf"\\([{PUNCTUATION}])")
_TICKS = re.compile("`+")
_UNDERSCORES = re.compile(r"(?:_|\\_){3,}")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?=[\s/>])")


@dataclass(frozen=True)
class Scope:
    """What holds for a slice: breaks by place, whether it is a label or a table cell, open kinds around it."""

    breaks: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    label: bool = False
    cell: bool = False
    around: frozenset[str] = frozenset()
    note: Callable[[str, int, int], None] | None = None
    paragraph_at: int = -1


def delimiter_at(text: str, at: int, end: int) -> str | None:
    pair = text[at:min(at + 2, end)]
    if pair in _DELIMITERS and len(pair) == 2:
        return None if pair == "--" and "-" in (char(text, at - 1), char(text, at + 2)) else pair
    return pair[:1] if pair[:1] in ("*", "_") else None


def span_close(text: str, at: int, end: int, opener: str, closer: str) -> int:
    """Where the closer of a wrapper stands, inner pairs skipped; -1 if nowhere."""
    depth = 0
    for m in re.compile(f"{opener}|{closer}").finditer(text, at, end):
        if m[0] == opener:
            depth += 1
        elif depth == 0:
            return m.start()
        else:
            depth -= 1
    return -1


def metadata_close(text: str, at: int, end: int) -> int:
    """Where the ``</m>`` of the wrapper opened before a place stands; -1 if nowhere."""
    depth = 0
    while at < end:
        if text.startswith("<m", at, end) and char(text, at + 2) in (" ", "\t", ">"):
            try:
                inner = read_opener(text, at, end)
            except Fault:
                inner = None
            if inner:
                depth, at = depth + 1, inner[2]
                continue
        if text.startswith("</m>", at, end):
            if depth == 0:
                return at
            depth, at = depth - 1, at + 4
            continue
        at += 1
    return -1


def label_end(text: str, at: int, end: int) -> int:
    """The bracket that closes a label; complete links inside are skipped whole."""
    depth = 0
    while at < end:
        c = text[at]
        if c == "\\" and at + 1 < end:
            at += 2
            continue
        if m := REFERENCE.match(text, at, end):
            at = m.end()
            continue
        if text.startswith("![", at, end):
            if m := REFERENCE.match(text, at + 1, end):
                at = m.end()
                if char(text, at) == "(" and not isinstance(found := read_destination(text, at + 1, end), str):
                    at = found[2]
            else:
                depth, at = depth + 1, at + 2
            continue
        if c == "[":
            depth += 1
        elif c == "]":
            found = read_destination(text, at + 2, end) if depth and char(text, at + 1) == "(" else ""
            if isinstance(found, str):
                return at
            depth, at = depth - 1, found[2]
            continue
        at += 1
    return -1


def atom_end(text: str, at: int, end: int, after_word: bool) -> int:
    """The end of a token that hides pipes and delimiters; ``at`` if none starts here."""
    c = text[at]
    if c == "`":
        size = _TICKS.match(text, at, end).end() - at
        return next((m.end() for m in _TICKS.finditer(text, at + size, end) if m.end() - m.start() == size), at)
    if text.startswith("$`", at, end):
        close = text.find("`$", at + 2, end)
        return close + 2 if close > at + 2 else at
    if c == "[" and (m := REFERENCE.match(text, at, end)):
        return m.end()
    if c == "[" or text.startswith("![", at, end):
        close = label_end(text, at + (1 if c == "[" else 2), end)
        if close < 0 or char(text, close + 1) != "(":
            return at
        found = read_destination(text, close + 2, end)
        return at if isinstance(found, str) else found[2]
    if c == "<":
        for tag in ("i", "b"):
            if text.startswith(f"<{tag}>", at, end):
                close = span_close(text, at + 3, end, f"<{tag}>", f"</{tag}>")
                return close + 4 if close > at + 3 else at
        if text.startswith("<m", at, end) and char(text, at + 2) in (" ", "\t", ">"):
            try:
                opened = read_opener(text, at, end)
            except Fault:
                return at
            close = metadata_close(text, opened[2], end) if opened else -1
            return close + 4 if close >= 0 else at
        close = text.find(">", at + 1, end)
        inner = text[at + 1:close] if close >= 0 else ""
        return close + 1 if is_url(inner) or is_email(inner) else at
    if c == "h" and not after_word and (text.startswith("http://", at, end) or text.startswith("https://", at, end)):
        return bare_url_end(text, at, end)
    if c == "&" and (found := entity(text, at, end)):
        return found[1]
    return at


class _Open:
    __slots__ = ("kind", "mark", "at", "nodes")

    def __init__(self, kind: str, mark: str, at: int):
        self.kind, self.mark, self.at, self.nodes = kind, mark, at, []


class InlineReader:
    """Reads one slice; ``read`` returns the nodes or raises a Fault."""

    def __init__(self, text: str, start: int, end: int, scope: Scope):
        self.text, self.start, self.end, self.scope = text, start, end, scope
        self.stack = [_Open("", "", start)]
        self.last_bracket = text.rfind("]", start, end)
        self.angle = (start, start - 1)

    def read(self) -> list[Node]:
        at, text, end = self.start, self.text, self.end
        breaks = self.scope.breaks
        places = self.places = [b for b in sorted(breaks) if b < end]
        following, url, mark = bisect_left(places, at), text.find("http", at, end), -1
        while at < end:
            if breaks and (gap := breaks.get(at)) is not None:
                while self.stack[-1].kind in _ONE_LINE:
                    self._reopen()
                self._add(Node("softBreak", span=(gap[1], gap[2])))
                at = gap[0]
                continue
            if len(self.stack) > 1 and (past := self._close(at)) is not None:
                at = past
                continue
            if mark < at:  # else what was found from before is still ahead
                m = _SIGNIFICANT.search(text, at, end)
                mark = m.start() if m else end
            stop = mark
            if 0 <= url < at:
                url = text.find("http", at, end)
            if 0 <= url < stop:
                stop = url
            while following < len(places) and places[following] <= at:
                following += 1
            if following < len(places) and places[following] < stop:
                stop = places[following]
            if stop > at:
                self._text(text[at:stop], at, stop)
                at = stop
                continue
            at = self._token(at)
        while len(self.stack) > 1:
            self._reopen()
        return self.stack[0].nodes

    def _fault(self, why: str, at: int, category: str = "syntax") -> Fault:
        return Fault(why, at, self.end, category)

    def _add(self, node: Node) -> None:
        self.stack[-1].nodes.append(node)

    def _text(self, value: str, at: int, end: int) -> None:
        nodes = self.stack[-1].nodes
        if nodes and nodes[-1].type == "text":
            nodes[-1].data["value"] += value
            nodes[-1].span = (nodes[-1].span[0], end)
        else:
            nodes.append(Node("text", {"value": value}, span=(at, end)))

    def _reopen(self) -> None:
        """An opener that found no closer becomes text, and its content moves up."""
        open_ = self.stack.pop()
        self._text(open_.mark, open_.at, open_.at + len(open_.mark))
        for node in open_.nodes:
            if node.type == "text":
                self._text(node.data["value"], *node.span)
            else:
                self._add(node)

    def _edges(self, at: int, size: int) -> tuple[str, str]:
        return kind_of(char(self.text, at - 1, self.start, self.end)), kind_of(char(self.text, at + size, self.start, self.end))

    def _close(self, at: int) -> int | None:
        top, text = self.stack[-1], self.text
        if not top.kind or not text.startswith(top.mark, at, self.end):
            return None
        before, after = self._edges(at, len(top.mark))
        if before == "S" or after == "W":
            return None
        longer = delimiter_at(text, at, self.end)
        if longer and longer != top.mark and any(o.mark == longer for o in self.stack[1:-1]):
            run = re.compile(re.escape(text[at]) + "+").match(text, at, self.end)
            if longer[0] != top.mark[0] or run.end() - at < len(longer) + len(top.mark):
                raise self._fault("overlapping inline tokens", at)
        if not top.nodes:
            raise self._fault("empty inline token", at)
        self.stack.pop()
        past = at + len(top.mark)
        self._add(Node(top.kind, slots={"children": top.nodes}, span=(top.at, past)))
        return past

    def _pipes(self, value: str) -> str:
        return value.replace("\\|", "|") if self.scope.cell else value

    def _token(self, at: int) -> int:
        text, end, scope, c = self.text, self.end, self.scope, self.text[at]
        if c == "\\":
            m = _ESCAPED.match(text, at, end)
            self._text(m[1] if m else "\\", at, at + (2 if m else 1))
            return at + (2 if m else 1)
        if c == "`":
            return self._code(at)
        if text.startswith("$`", at, end):
            close = text.find("`$", at + 2, end)
            if close < 0:
                raise self._fault("unclosed inline math", at)
            if bisect_left(self.places, at + 2) < bisect_left(self.places, close):
                raise self._fault("inline math cannot contain a soft break", at)
            if close == at + 2:
                raise self._fault("empty inline math", at)
            self._add(Node("inlineMath", {"value": self._pipes(text[at + 2:close])}, span=(at, close + 2)))
            return close + 2
        if at < self.last_bracket and (c == "[" or text.startswith("![", at, end)):
            if found := read_link(text, at, end, scope):
                self._add(found)
                return found.span[1]
        if c == "<" and (past := self._angle(at)) is not None:
            return past
        if c == "h" and (text.startswith("http://", at, end) or text.startswith("https://", at, end)) and self._edges(at, 0)[0] != "W":
            stop = bare_url_end(text, at, end)
            if stop == at:
                raise self._fault("invalid bare autolink", at)
            if scope.label:
                raise self._fault("nested autolink", at)
            self._add(Node("autolink", {"kind": "url", "value": self._pipes(text[at:stop])}, span=(at, stop)))
            return stop
        if c == "[" and (m := REFERENCE.match(text, at, end)):
            return self._reference(at, m)
        if c == "&" and (found := entity(text, at, end)):
            self._text(found[0], at, found[1])
            return found[1]
        if c == "^" or c == "~" and not text.startswith("~~", at, end):
            close = text.find(c, at + 1, end)
            inner = text[at + 1:close] if close > 0 else ""
            if inner and not any(map(is_white, inner)):
                self._add(Node("sup" if c == "^" else "sub", {"value": self._pipes(inner)}, span=(at, close + 1)))
                return close + 1
            self._text(c, at, at + 1)
            return at + 1
        if c == "_" and (m := _UNDERSCORES.match(text, at, end)) and "\\" in m[0]:
            self._text("_" * m[0].count("_"), at, m.end())
            return m.end()
        if d := delimiter_at(text, at, end):
            before, after = self._edges(at, len(d))
            if before != "S" and after != "W" and any(o.mark == d for o in self.stack[:-1]):
                raise self._fault("overlapping inline tokens", at)
            if after != "S" and before != "W":
                kind, top = _DELIMITERS[d], self.stack[-1].kind
                if top == kind or not top and kind in scope.around:
                    raise self._fault(f"{kind} opens inside {kind}", at)
                self.stack.append(_Open(kind, d, at))
                return at + len(d)
            if len(d) > 1:
                self._text(d, at, at + len(d))
                return at + len(d)
        self._text(c, at, at + 1)
        return at + 1

    def _code(self, at: int) -> int:
        text, size = self.text, _TICKS.match(self.text, at, self.end).end() - at
        for m in _TICKS.finditer(text, at + size, self.end):
            if m.end() - m.start() != size:
                continue
            value, here = "", at + size
            for place in self.places[bisect_left(self.places, here):bisect_left(self.places, m.start())]:
                value, here = f"{value}{text[here:place]} ", self.scope.breaks[place][0]
            value += text[here:m.start()]
            if value.startswith(" ") and value.lstrip(" ").startswith("`"):
                value = value[1:]
            if value.endswith(" ") and value.rstrip(" ").endswith("`"):
                value = value[:-1]
            if not value:
                raise self._fault("empty inline code", at)
            self._add(Node("inlineCode", {"value": self._pipes(value)}, span=(at, m.end())))
            return m.end()
        raise self._fault("unclosed inline code", at)

    def _angle(self, at: int) -> int | None:
        text, end, scope = self.text, self.end, self.scope
        for tag, kind in (("i", "em"), ("b", "strong")):
            if text.startswith(f"<{tag}>", at, end):
                top = self.stack[-1].kind
                if kind in ({top} if top else scope.around):
                    raise self._fault(f"{kind} is open already", at)
                close = span_close(text, at + 3, end, f"<{tag}>", f"</{tag}>")
                if close < 0:
                    raise self._fault("unclosed inline wrapper", at)
                if close == at + 3:
                    raise self._fault("empty inline token", at)
                inner = InlineReader(text, at + 3, close, replace(scope, around=frozenset([kind]), paragraph_at=-1)).read()
                self._add(Node(kind, slots={"children": inner}, span=(at, close + 4)))
                return close + 4
        if (node := self._metadata(at)) is not None:
            self._add(node)
            return node.span[1]
        if not self.angle[0] <= at < self.angle[1]:  # else the one that was found from before is the next
            self.angle = (at, _BEFORE_ANGLE.match(text, at + 1, end).end())
        close = self.angle[1]
        if close >= end or text[close] != ">":
            return None
        value = "" if _WHITE.search(text, at + 1, close) else text[at + 1:close]
        kind = "url" if is_url(value) else "email" if is_email(value) else None
        if kind:
            if scope.label:
                raise self._fault("nested autolink", at)
            self._add(Node("autolink", {"kind": kind, "value": self._pipes(value)}, span=(at, close + 1)))
            return close + 1
        if scope.note and _TAG.match(text, at, end):
            scope.note("tag-like text is shown as written", at, close + 1)
        return None

    def _metadata(self, at: int) -> Node | None:
        text, scope = self.text, self.scope
        opened = read_opener(text, at, self.end)
        if opened is None:
            return None
        kind, attrs, begin = opened
        close = metadata_close(text, begin, self.end)
        if close < 0:
            raise self._fault("unclosed metadata wrapper", at)
        span = (at, close + 4)
        target = read_link(text, begin, close, Scope(cell=scope.cell), empty_label=True) if text.startswith(("[", "!["), begin, close) else None
        whole = target is not None and target.span[1] == close
        if whole and target.type == "inlineImage":
            if kind:
                raise self._fault("resource primary type conflict", at, "semantic")
            if not attrs:
                raise self._fault("metadata wrapper adds no semantics", at, "semantic")
            self._allowed("image", attrs, at)
            return Node("inlineImage", target.data | attrs, target.slots, span)
        if kind:
            if not whole:
                raise self._fault("typed resource requires exactly one primary link", at, "semantic")
            self._allowed(kind, attrs, at)
            if kind != "download":
                raise self._fault("typed resource is block-only", at, "semantic")
            if scope.label:
                raise self._fault("nested link", at)
            return Node("link", target.data | {"download": True} | attrs, target.slots, span)
        self._allowed("generic", attrs, at)
        if not attrs:
            raise self._fault("metadata wrapper adds no semantics", at, "semantic")
        inner = InlineReader(text, begin, close, scope).read()
        if not inner:
            raise self._fault("empty inline token", at)
        if any(n.type == "metadataSpan" for n in inner):
            raise self._fault("same-kind direct inline nesting", at)
        return Node("metadataSpan", attrs, {"children": inner}, span)

    def _allowed(self, context: str, attrs: dict, at: int) -> None:
        if why := context_fault(context, attrs):
            raise self._fault(why, at, "semantic")

    def _reference(self, at: int, m: re.Match) -> int:
        if self.scope.label:
            raise self._fault("nested footnote reference", at)
        nodes = self.stack[-1].nodes
        if nodes and nodes[-1].type == "text":
            back = at
            while back > self.start and self.text[back - 1] in " \t":
                back -= 1
            value = nodes[-1].data["value"]
            if back < at and len(value) >= at - back:
                nodes[-1].data["value"] = value[:len(value) - (at - back)]
                nodes[-1].span = (nodes[-1].span[0], back)
                if not nodes[-1].data["value"]:
                    nodes.pop()
        self._add(Node("footnoteReference", {"identifier": m[1]}, span=(at, m.end())))
        return m.end()


def read_link(text: str, at: int, end: int, scope: Scope, empty_label: bool = False) -> Node | None:
    """A direct link or image at a place; None where the brackets are text."""
    image = text.startswith("![", at, end)
    begin = at + (2 if image else 1)
    close = label_end(text, begin, end)
    if close < 0 or char(text, close + 1) != "(":
        if not image and at == scope.paragraph_at and scope.note and close > at + 1 and close + 1 < end and char(text, at + 1) != "^" and char(text, close + 1) == ":":
            scope.note("a paragraph that begins like a link definition is text", at, close + 2)
        return None
    if not image and scope.label:
        raise Fault("nested link", at, end)
    found = read_destination(text, close + 2, end)
    if isinstance(found, str):
        raise Fault(f"invalid link destination: {found}", at, end)
    dest, title, past = found
    inner = InlineReader(text, begin, close, Scope(scope.breaks, True, scope.cell, note=scope.note)).read()
    if not image and not inner and not empty_label:
        raise Fault("empty inline token", at, end)
    data = {"dest": dest} | ({} if title is None else {"title": title})
    return Node("inlineImage" if image else "link", data, {"alt" if image else "children": inner}, (at, past))


def read_inline(text: str, start: int, end: int, scope: Scope = Scope()) -> list[Node]:
    return InlineReader(text, start, end, scope).read()
