"""Import of CommonMark-style text: what can be kept is rewritten, what is lost is recorded.

The reader here takes the constructs whose meaning the target language spells differently:
Setext headings, indented code, raw HTML, reference links and their definitions, footnotes
with block content, lists by content column, ragged tables, quotes with lazy lines, and
characters that are text there and marks here.  Lists, quotes and their items are read by
the same rules inside.  The result is canonical text; a text that still can't be read is
kept as literal code, block by block, and as the last resort nothing is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .api import canonical_text
from .blocks import FENCE, HEADING, INTRODUCER, RowScan, is_blank, is_rule, list_marker, starts_table, trim_end
from .chars import is_identifier
from .document import read_document, transport_of

#: The ladder of losses, from none to all.
LADDER = ("normalised", "resolved", "source-structure-loss", "semantic-degradation", "content-dropped", "unrepresentable")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\Z")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_HTML_BLOCK = re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]|\Z)", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>")
_NOTE = re.compile(r" {0,3}\[\^([^\[\]\s]+)\]:[ \t]*(.*)\Z", re.S)
_NOTE_USE = re.compile(r"(?<!\\)\[\^([^\[\]\s]+)\](?!:)")
_QUOTED = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|([0-9]{1,9})[.)])(?:( +)(.*)|)\Z", re.S)
_SELF_LINK = re.compile(r"(?<!!)\[(https?://[^\[\]\s<>]+|[^\[\]\s<>@]+@[^\[\]\s<>@]+)\]\((?:mailto:)?\1\)")
#: Marks of the target language that are plain characters in the source.
_PLAIN = re.compile(r"(?<![\\\[])\^|(?<!\\)(?:==|\+\+|(?<!-)--(?!-)|(?<!~)~(?!~)|\$(?=`)|<(?=m[ >]))")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![\[(:])")


@dataclass(frozen=True)
class Loss:
    """One entry of the record: a rung of the ladder, what happened, and the line it happened on."""

    category: str
    message: str
    line: int


def normal_label(label: str) -> str:
    return " ".join(label.split()).lower()


def import_text(raw: str | None, raw_html: str = "drop") -> tuple[str, list[Loss]]:
    """Canonical text and the record of losses by line; ``raw_html`` is ``drop`` or ``escape``."""
    lines = transport_of(raw or "").text.split("\n")
    reader = _Reader(raw_html, [])
    lines = reader.take_definitions(lines)
    blocks = reader.blocks(lines, 1)
    reader.losses += [Loss("source-structure-loss", f"unused link definition [{name}]", at) for name, (_, _, at) in reader.known.items() if name not in reader.used]
    out: list[str] = []
    for at, text in blocks:
        if not _reads(text, reader.notes):
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))
            reader.losses.append(Loss("semantic-degradation", "a block that can't be read is kept as code", at))
            text = f"{fence}\n{text}\n{fence}"
        out.append(text)
    out += reader.footnotes()
    whole = canonical_text("\n\n".join(out) + "\n")
    if whole is None:
        reader.losses.append(Loss("unrepresentable", "the document has no canonical form", 1))
        whole = canonical_text("")
    return whole, sorted(reader.losses, key=lambda x: x.line)


def _reads(text: str, notes: dict) -> bool:
    """Whether a block can be read on its own, the footnotes that it refers to given."""
    named = dict.fromkeys(m[1] for m in _NOTE_USE.finditer(text) if m[1] in notes)
    return canonical_text(text + "\n" + "".join(f"\n[^{n}]: note\n" for n in named)) is not None


def _opens_block(line: str) -> bool:
    """Whether a line can't go on a paragraph."""
    item = _ITEM.match(line)
    return bool(HEADING.match(line) or FENCE.match(line) or is_rule(line) or _QUOTED.match(line) or _HTML_BLOCK.match(line) or item and item[5] and item[3] in (None, "1"))


def _paragraph_open(lines: list[str]) -> bool:
    """Whether the last of these lines belongs to a paragraph that an unmarked line may go on."""
    fence = None
    for line in lines:
        if m := FENCE.match(line):
            fence = None if fence and m[2][0] == fence else fence or m[2][0]
    last = lines[-1] if lines else ""
    while m := _QUOTED.match(last) or _ITEM.match(last):
        last = last[m.end():] if m.re is _QUOTED else m[5] or ""
    return not (fence or is_blank(last) or HEADING.match(last) or FENCE.match(last) or is_rule(last) or last.startswith("    "))


def _kind(text: str) -> str:
    """The type of the first block of a converted text."""
    tree = read_document(text + "\n").tree
    kids = tree.kids() if tree else []
    return kids[0].type if kids else ""


class _Reader:
    """One import: the definitions found, those used, and the losses."""

    def __init__(self, raw_html: str, losses: list[Loss]):
        self.raw_html, self.losses = raw_html, losses
        self.known: dict[str, tuple[str, str | None, int]] = {}
        self.used: set[str] = set()
        self.notes: dict[str, tuple[int, list[str]]] = {}
        self.cited: dict[str, None] = {}

    def lose(self, category: str, message: str, line: int) -> None:
        self.losses.append(Loss(category, message, line))

    # definitions and footnotes

    def take_definitions(self, lines: list[str]) -> list[str]:
        """Takes link and footnote definitions out of the text; the first of a label counts.

        A footnote goes on over indented lines, blank ones between them, and lazily over a paragraph.
        """
        out, fence, before_blank, k = [], None, True, 0
        while k < len(lines):
            line = lines[k]
            if m := FENCE.match(line):
                fence = None if fence and m[2][0] == fence else fence or m[2][0]
            if not fence and (m := _NOTE.match(line)):
                body, end = [m[2]], k + 1
                while end < len(lines) and (is_blank(lines[end]) or lines[end].startswith("    ") or not is_blank(lines[end - 1]) and not _opens_block(lines[end]) and not _NOTE.match(lines[end])):
                    body.append(lines[end].removeprefix("    "))
                    end += 1
                while end > k + 1 and is_blank(lines[end - 1]):
                    end -= 1
                    body.pop()
                self.notes.setdefault(m[1], (k + 1, body))
                out += [""] * (end - k)
                k, before_blank = end, True
                continue
            m = None if fence or not before_blank or line.lstrip().startswith("[^") else _DEFINITION.match(line)
            if m:
                self.known.setdefault(normal_label(m[1]), (m[2].strip("<>"), m[3] and m[3][1:-1], k + 1))
                out.append("")
            else:
                before_blank = is_blank(line)
                out.append(line)
            k += 1
        return out

    def footnotes(self) -> list[str]:
        """Definitions flattened to one line each: those cited in their order, then the others."""
        out = []
        for name in (*self.cited, *sorted(set(self.notes).difference(self.cited))):
            at, body = self.notes[name]
            if not is_identifier(name):
                self.lose("unrepresentable", f"footnote identifier {name!r} is not valid", at)
                continue
            blocks = [text for _, text in self.blocks(body, at)]
            if len(blocks) != 1 or _kind(blocks[0]) != "paragraph":
                self.lose("source-structure-loss", f"block content in footnote [^{name}] was flattened", at)
            flat = " ".join(" ".join(HEADING.sub("", b, count=1).split()) for b in blocks)
            flat = _NOTE_USE.sub("", flat).strip() or "&#32;"
            text = f"[^{name}]: {flat}"
            if canonical_text(f"x[^{name}]\n\n{text}\n") is None:
                self.lose("semantic-degradation", f"footnote [^{name}] is kept as code", at)
                tick = "`" * (1 + max(map(len, re.findall("`+", flat)), default=0))
                text = f"[^{name}]: {tick} {flat} {tick}"
            out.append(text)
        return out

    # blocks

    def blocks(self, lines: list[str], base: int) -> list[tuple[int, str]]:
        """The blocks of some lines as texts of the target language, each with the line it starts on."""
        out: list[tuple[int, str]] = []
        held: list[str] = []
        begin, i = base, 0

        def flush() -> None:
            if held:
                out.append((begin, "\n".join(held)))
                held.clear()

        while i < len(lines):
            line = lines[i]
            if is_blank(line):
                flush()
                i += 1
                continue
            if not held:
                begin = base + i
            if m := FENCE.match(line):
                flush()
                begin = base + i
                close = next((k for k in range(i + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*\Z", lines[k])), None)
                body = lines[i + 1:len(lines) if close is None else close]
                info = line[m.end():].strip().split(" ")[0]
                if info != line[m.end():].strip():
                    self.lose("source-structure-loss", "only the first word of a fence's info is kept", begin)
                fence = "`" * max(3, 1 + max(map(len, re.findall("`+", "\n".join(body))), default=0))
                held += [fence + info.replace("`", ""), *[x[min(len(m[1]), len(x) - len(x.lstrip(" "))):] for x in body], fence]
                flush()
                i = len(lines) if close is None else close + 1
                continue
            if not held and line.startswith(("    ", "\t")):
                code = []
                while i < len(lines) and (lines[i].startswith(("    ", "\t")) or is_blank(lines[i])):
                    code.append(re.sub(r"^(?:    |\t)", "", lines[i]))
                    i += 1
                self.lose("normalised", "indented code becomes a fence", begin)
                value = "\n".join(code).rstrip("\n")
                fence = "`" * max(3, 1 + max(map(len, re.findall("`+", value)), default=0))
                held += [fence, *value.split("\n"), fence]
                flush()
                continue
            if not held and _HTML_BLOCK.match(line):
                html = []
                while i < len(lines) and not is_blank(lines[i]):
                    html.append(lines[i])
                    i += 1
                if self.raw_html == "drop":
                    self.lose("content-dropped", "raw HTML block", begin)
                else:
                    self.lose("semantic-degradation", "raw HTML block as text", begin)
                    held += [x.replace("<", "\\<") for x in html]
                    flush()
                continue
            under = _UNDERLINE.match(line)
            if held and under and not INTRODUCER.match(held[-1]) and not HEADING.match(held[0]) and all("|" not in h for h in held):
                text = " ".join(h.strip() for h in held)
                held[:] = [("# " if under[1][0] == "=" else "## ") + text]
                self.lose("normalised", "Setext heading", begin)
                flush()
                i += 1
                continue
            if is_rule(line) and (list_marker(line) is None or trim_end(line).strip("-* ") == ""):
                flush()
                begin = base + i
                if trim_end(line) != "---":
                    self.lose("normalised", "thematic break", begin)
                held.append("---")
                flush()
                i += 1
                continue
            if HEADING.match(line):
                flush()
                begin = base + i
                held.append(self.inline(line.strip(), base + i))
                flush()
                i += 1
                continue
            if _QUOTED.match(line):
                flush()
                i = self._quote(lines, i, base, out)
                continue
            item = _ITEM.match(line)
            if item and (not held or item[5] and item[3] in (None, "1")):
                flush()
                i = self._list(lines, i, base, out)
                continue
            if not held and starts_table(line.strip(), lines[i + 1].strip() if i + 1 < len(lines) else None) and (end := self._table(lines, i, base, out)):
                i = end
                continue
            if held and item and item[3]:  # a number that goes on a paragraph
                line = re.sub(r"([.)])", r"\\\1", line, count=1)
            text = self.inline(line, base + i)
            held.append("\\" + text.lstrip() if re.match(r" *(?::|\{#|_{3,}\s*\Z)", text) else text.lstrip() if len(held) or not text.startswith("  ") else text.strip())
            i += 1
        flush()
        return out

    def _quote(self, lines: list[str], i: int, base: int, out: list[tuple[int, str]]) -> int:
        """A quote with its lazy lines; its blocks are read without their marks and get them back."""
        first, inner = i, []
        while i < len(lines):
            if m := _QUOTED.match(lines[i]):
                inner.append(lines[i][m.end():])
            elif not is_blank(lines[i]) and _paragraph_open(inner) and not _opens_block(lines[i]):
                inner.append(lines[i].lstrip())
            else:
                break
            i += 1
        blocks = [text for _, text in self.blocks(inner, base + first)]
        while blocks and blocks[0].startswith(">"):
            self.lose("source-structure-loss", "a quote that begins deeper starts at its first level", base + first)
            blocks[:1] = [re.sub(r"(?m)^> ?", "", blocks[0])]
        body = "\n\n".join(blocks).split("\n") if blocks else []
        if body:
            out.append((base + first, "\n".join("> " + x if x else ">" for x in body)))
        return i

    def _list(self, lines: list[str], i: int, base: int, out: list[tuple[int, str]]) -> int:
        """Items by their content column, with lazy lines.  Lists of one kind that follow each other are one.

        Numbers stay as they are written, so a list that starts again keeps its numbers in the merged one.
        """
        first, made, end = i, [], i
        ordered = _ITEM.match(lines[i])[3] is not None
        while i < len(lines) and (m := _ITEM.match(lines[i])) and (m[3] is not None) == ordered and not is_rule(lines[i]):
            at, space = i, len(m[4] or " ")
            column = len(m[1]) + len(m[2] or m[3] + ".") + (space if space < 5 else 1)
            body = [lines[i][column:]]
            i += 1
            while i < len(lines):
                row = lines[i]
                lead = len(row) - len(row.lstrip(" "))
                if is_blank(row):
                    if len(body) == 1 and is_blank(body[0]):
                        break
                    body.append("")
                elif lead >= column:
                    body.append(row[column:])
                elif body[-1] and _paragraph_open(body) and not _ITEM.match(row) and not _opens_block(row):
                    body.append(row.lstrip())
                else:
                    break
                i += 1
            end = i
            while body and is_blank(body[-1]):
                body.pop()
            made.append(self._item(body, base + at, f"{int(m[3])}. " if ordered else "- "))
            while i < len(lines) and is_blank(lines[i]):
                i += 1
        if out and made and self._same_list(out[-1][1], ordered):
            at, before = out.pop()
            made.insert(0, before)
            first = at - base
        out.append((base + first, "\n".join(made)))
        return end

    @staticmethod
    def _same_list(text: str, ordered: bool) -> bool:
        return re.match(r"[0-9]+\. " if ordered else "- ", text) is not None and _kind(text) == "list"

    def _item(self, body: list[str], at: int, mark: str) -> str:
        """An item: a paragraph first, then what may stand in items, two columns in."""
        blocks = [text for _, text in self.blocks(body, at)]
        if not blocks or _kind(blocks[0]) != "paragraph":
            self.lose("unrepresentable", "a list item without a paragraph at its head", at)
            literal = " ".join(" ".join(body).split()) or mark.strip()
            tick = "`" * (1 + max(map(len, re.findall("`+", literal)), default=0))
            blocks = [f"{tick} {literal} {tick}" if "`" in literal else f"`{literal}`"]
        kept = blocks[:1]
        for text in blocks[1:]:
            if (kind := _kind(text)) in ("heading", "horizontalRule", "container"):
                self.lose("content-dropped", f"{kind} in a list item", at)
            else:
                kept.append(text)
        out = ""
        for k, text in enumerate(kept):
            rows = text.split("\n")
            tight = len(kept) == 2 and re.match(r"(?:-|[0-9]+\.) ", text)
            out += ("" if not k else "\n" if tight else "\n\n") + "\n".join((mark if not k and not n else "  ") + row if row else row for n, row in enumerate(rows))
        return out

    def _table(self, lines: list[str], i: int, base: int, out: list[tuple[int, str]]) -> int | None:
        """A table whose rows are fitted to the header; None if header and separator differ in width."""
        cells = lambda row: [row[a:b] for a, b in RowScan(row).cells]
        head, separator = lines[i].strip(), lines[i + 1].strip()
        width = len(cells(head))
        if len(cells(separator)) != width:
            return None
        rows, k = [cells(head), cells(separator)], i + 2
        while k < len(lines) and not is_blank(lines[k]) and not _opens_block(lines[k]):
            row = cells(lines[k].strip())
            if len(row) != width:
                dropped = any(x for x in row[width:])
                self.lose("content-dropped" if dropped else "normalised", "a table row was fitted to the header", base + k)
            rows.append([*row[:width], *[""] * (width - len(row))])
            k += 1
        made = [[x if n == 1 else self.inline(x, base + i + n) for x in row] for n, row in enumerate(rows)]
        out.append((base + i, "\n".join("| " + " | ".join(row) + " |" for row in made)))
        return k

    def inline(self, line: str, at: int) -> str:
        """Links and footnote references resolved, inline HTML dropped and plain characters escaped, outside of code."""
        def link(m: re.Match) -> str:
            name = normal_label(m[3] or m[2])
            if m[2].startswith("^") or name not in self.known:
                return m[0]
            dest, title, _ = self.known[name]
            self.used.add(name)
            self.lose("resolved", f"reference link [{name}]", at)
            target = f"<{dest}>" if re.search(r"[\s()]", dest) or not dest else dest
            return f"{m[1]}[{m[2]}]({target}{f' {chr(34)}{title}{chr(34)}' if title else ''})"

        def tag(m: re.Match) -> str:
            if m[0].startswith("<m"):
                return "\\" + m[0]
            self.lose("content-dropped" if self.raw_html == "drop" else "semantic-degradation", "inline HTML", at)
            return "" if self.raw_html == "drop" else "\\" + m[0]

        def note(m: re.Match) -> str:
            if m[1] in self.notes and is_identifier(m[1]):
                self.cited.setdefault(m[1])
                return m[0]
            self.lose("semantic-degradation", f"footnote reference [^{m[1]}] as text", at)
            return "\\" + m[0]

        def one(part: str) -> str:
            part = _SELF_LINK.sub(r"<\1>", part)
            pieces = re.split(r"(\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*[^()]*\)|<[A-Za-z][^\s<>]*[:@][^\s<>]*>|https?://[^\s<>]+)", _TAG.sub(tag, part))
            escaped = "".join(p if k % 2 else _PLAIN.sub(lambda m: "".join("\\" + c for c in m[0]), p) for k, p in enumerate(pieces))
            return _NOTE_USE.sub(note, _LINK.sub(link, escaped))

        return "".join(p if k % 2 else one(p) for k, p in enumerate(re.split(r"((?<!`)(`+)(?!`).*?(?<!`)\2(?!`))", line)) if k % 3 != 2)


def is_stable(text: str) -> bool:
    """Whether an imported text is canonical as it stands."""
    return canonical_text(text) == text and read_document(text).status == "ok"
