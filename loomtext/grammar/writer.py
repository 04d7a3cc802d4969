"""The canonical writer: one text for each meaning."""

from __future__ import annotations

import re
import unicodedata

from .attributes import DATA_NAME, ascii_lower, context_fault
from .blocks import COLONS, COMMENT, FENCE, HEADING, INTRODUCER, NOT_TYPE, RowScan, split_id, trim_end
from .chars import CONTROL, PUNCTUATION, REFERENCE, WHITE, char, entity, is_identifier, is_white, kind_of
from .document import footnote_order
from .inline import atom_end, delimiter_at
from .tree import Node, Unwritable

_MARKS = {"deletion": "~~", "obsolete": "--", "insert": "++", "mark": "=="}
#: What a sibling's text begins or ends with, so that text beside it must not run into it.
_EDGES = {"em": "*", "strong": "*", "deletion": "~", "sub": "~", "obsolete": "-", "insert": "+", "mark": "=", "sup": "^", "inlineCode": "$", "inlineMath": "$", "link": "!", "inlineImage": "!"}
_ALIGN = {"default": "---", "left": ":---", "right": "---:", "center": ":---:"}
_TEXT = re.compile(r"[\\`&\[\]<^~*_$!\-+=](?:(?<=[\\`&\[\]<^~*_])|(?<=-)(?=-)|(?<==)(?==)|(?<=\+)(?=\+)|(?<=!)(?=\[)|(?<=\$)(?=`))")
_SCHEME = re.compile("https?://")
_HASHES = re.compile(r"#{1,6}(?:[ \t]|\Z)")
_NUMBER = re.compile(r"[0-9]+(?=[.)])")
_TASK = re.compile(r"\[[ xX]\]")
_LITERAL_SLASH = re.compile(rf"[{PUNCTUATION}]")


def write_document(doc: Node) -> str:
    """The canonical text of a document; Unwritable where it has none."""
    if doc.type != "document":
        raise Unwritable("not a document")
    body = "\n".join(_sequence(doc.kids(), False))
    notes = doc.kids("footnotes")
    if notes:
        used, unused = footnote_order(doc.kids(), notes)
        if [n.data["identifier"] for n in notes] != used + unused:
            raise Unwritable("footnotes are not in canonical form")
        lines = [f"[^{n.data['identifier']}]: {_inline(n.kids())}{_id_line(n)}" for n in notes]
        body = body + "\n\n" + "\n".join(lines)
    return body if body.endswith("\n") else body + "\n"


def _id_line(node: Node) -> str:
    own = node.data.get("block_id")
    if own is None:
        return ""
    if not is_identifier(own):
        raise Unwritable("invalid block id")
    return f"\n{{#{own}}}"


def _sequence(blocks: list[Node], cell: bool) -> list[str]:
    out: list[str] = []
    for i, b in enumerate(blocks):
        if i:
            out.append("")
        out += _block(b, cell)
    return out


def _under(lines: list[str], first: str, rest: str, blank: str = "") -> list[str]:
    """Lines below a marker: the first carries it, blank lines carry no trailing space."""
    return [(first if i == 0 else rest) + line if line else (first if i == 0 and first.strip() == "" else blank) for i, line in enumerate(lines)]


def _block(node: Node, cell: bool = False) -> list[str]:
    kind, data = node.type, node.data
    if kind == "heading":
        text = _guard_heading(_inline(node.kids(), edges=True))
        return [f"{'#' * data['level']} {text}" + (f" {{#{data['block_id']}}}" if "block_id" in data else "")]
    if kind == "paragraph":
        return (_paragraph(node, cell) + _id_line(node)).split("\n")
    if kind == "horizontalRule":
        return ["---" + (f" {{#{data['block_id']}}}" if "block_id" in data else "")]
    if kind in ("codeBlock", "mathBlock"):
        lang = "math" if kind == "mathBlock" else data.get("code_lang", "")
        if kind == "codeBlock" and (lang == "math" or "code_lang" in data and (not lang or re.search(f"[`{WHITE}]", lang))):
            raise Unwritable("code language")
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", data["value"])), default=0))
        value = data["value"] + "\n" if data["value"] else ""
        return f"{fence}{lang}\n{value}{fence}{_id_line(node)}".split("\n")
    if kind == "commentBlock":
        if "-->" in data["value"]:
            raise Unwritable("comment")
        return f"<!--{data['value']}-->".split("\n")
    if kind == "quoteRegion":
        return _quote(node)
    if kind == "list":
        return _list(node)
    if kind == "table":
        return _table(node)
    if kind == "container":
        return _container(node)
    if kind.endswith("Block") and kind != "errorBlock":
        return (_resource(node) + _id_line(node)).split("\n")
    raise Unwritable(kind)


def _paragraph(node: Node, cell: bool) -> str:
    kids = node.kids()
    if len(kids) == 1 and (kids[0].type == "inlineImage" or kids[0].data.get("download")):
        raise Unwritable("a lone resource is not a paragraph")
    if len(kids) == 1 and kids[0].type == "text" and kids[0].data["value"] and not kids[0].data["value"].strip("="):
        value = kids[0].data["value"]
        return "\\==" if cell and value == "==" else value
    rows = _inline(kids, breaks=True, edges=True).split("\n")
    out: list[str] = []
    for i, row in enumerate(rows):
        out.append(_guard_line(row, i == 0, rows[i + 1] if i + 1 < len(rows) else "", out[-1] if out else "", cell))
    return "\n".join(out)


def _live(line: str) -> bool:
    return RowScan(line).live


def _separator(line: str) -> bool:
    scan = RowScan(line)
    return scan.live and scan.alignments(line) is not None


def _guard_line(raw: str, first: bool, following: str, before: str, cell: bool) -> str:
    """A paragraph line escaped where it would start something else."""
    line = trim_end(raw)
    if not line or line[0] == "\\" or line[0].isalpha():
        return line
    head = line[0]
    own = (
        cell and line in ("^", "<", "::", "==", "--")
        or _HASHES.match(line)
        or head in "-*" and line.count(head) >= 3 and not line.strip(head + " \t")
        or head == "-" and not line.startswith("--")
        or head == ":"
        or head in "*+" and line[1:2] in ("", " ", "\t")
        or FENCE.match(line)
        or len(line) >= 3 and not line.strip("_")
        or COMMENT.match(line)
        or not first and not line.strip("=")
        or line.startswith("![") and atom_end(line, 0, len(line), False) == len(line)
        or head == "|" and _separator(following)
        or not first and _live(before) and _separator(line)
        or head == ">"
        or head == "{" and line.endswith("}")
    )
    if own:
        return "\\" + line
    if (m := _NUMBER.match(line)) and not line[m.end() + 1:m.end() + 2].isdigit():
        return f"{m[0]}\\{line[m.end():]}"
    return line


def _guard_heading(text: str) -> str:
    body = trim_end(text)
    if not body:
        raise Unwritable("empty heading")
    cut, own = split_id(body)
    if own is not None:
        return f"{cut} \\{body[len(cut) + 1:]}"
    if body[0] == "{" and body.endswith("}"):
        return "\\" + body
    bare = body.rstrip("#")
    if bare != body and (not bare or bare.endswith(" ")):
        return f"{bare}\\{body[len(bare):]}"
    return body


def _quote(node: Node) -> list[str]:
    out: list[str] = []
    before = 0
    for block in node.kids():
        level = block.data.get("quote_level", 0)
        if level < 1 or level > before + 1 or "block_id" in block.data:
            raise Unwritable("quote levels")
        mark, blank = "> " * level, "> " * (level - 1) + ">"
        if out and level == before:
            out.append(blank)
        out += [mark + line if line else blank for line in _block(block)]
        before = level
    if not out:
        raise Unwritable("empty quote")
    if node.kids("attribution"):
        out.append("-- " + _inline(node.kids("attribution")))
    return out + _id_line(node).split("\n")[1:]


def _list(node: Node) -> list[str]:
    kind, out = node.data["kind"], []
    number = node.data.get("start_no", 1)
    for i, item in enumerate(node.kids("items")):
        kids = item.kids()
        if not kids or kids[0].type != "paragraph" or any("block_id" in k.data for k in kids):
            raise Unwritable("list item")
        if i:
            number = item.data.get("item_value", number + 1)
        mark = {"unordered": "- ", "definition": ": "}.get(kind, f"{number}. ")
        if "task" in item.data:
            mark += "[x] " if item.data["task"] == "done" else "[ ] "
        lines = _block(kids[0])
        if "task" not in item.data and kind != "definition":
            lines[0] = _guard_task(lines[0], kids[0].kids()[0])
        out += _under(lines, mark, "  ")
        for k in kids[1:]:
            if not (len(kids) == 2 and k.type == "list"):
                out.append("")
            out += _under(_block(k), "  ", "  ")
    if not out:
        raise Unwritable("empty list")
    return out + _id_line(node).split("\n")[1:]


def _guard_task(line: str, first: Node) -> str:
    """An item's first line where its text or link would be read as a task's mark."""
    if not _TASK.match(line):
        return line
    return "\\" + line if first.type == "text" else f"[&#{ord(line[1])};{line[2:]}"


def _table(node: Node) -> list[str]:
    width = len(node.data["alignments"])

    def row(r: Node) -> str:
        cells = [_inline(c.kids(), cell=True, edges=True) if c.kids() else "" for c in r.kids("cells")]
        if len(cells) != width:
            raise Unwritable("table width")
        return f"| {' | '.join(cells)} |"

    rows = [row(node.kids("head")[0]), f"| {' | '.join(_ALIGN[a] for a in node.data['alignments'])} |", *map(row, node.kids("body"))]
    return rows + _id_line(node).split("\n")[1:]


def _container(node: Node) -> list[str]:
    name, title = node.data.get("container_type"), node.data.get("container_title")
    if name is None and title is not None or title == "" or name is not None and (not name or NOT_TYPE.search(name) or unicodedata.normalize("NFC", name) != name):
        raise Unwritable("container header")
    header = "" if name is None else name if title is None else f"{name} {title}"
    own = _id_line(node).split("\n")[1:]
    kids = node.kids()
    if not kids:
        raise Unwritable("empty container")
    if node.data["form"] == "fenced":
        body = _grid(kids[0]) if kids[0].type == "grid" else _sequence(kids, False)
        return [":::" + (f" {header}" if header else ""), *body, ":::", *own]
    if header and INTRODUCER.match(header):
        raise Unwritable("container header")
    return [*([header] if header else []), "___", "", *_sequence(kids, False), "___", *own]


def occupancy(rows: list[Node], width: int) -> list[list[int]]:
    """The cell that covers each slot of a region, in anchor order."""
    grid = [[-1] * width for _ in rows]
    n = 0
    for r, row in enumerate(rows):
        for cell in row.kids("cells"):
            c, high, wide = cell.data["grid_col"] - 1, cell.data.get("row_span", 1), cell.data.get("col_span", 1)
            for y in range(r, r + high):
                for x in range(c, c + wide):
                    if y >= len(rows) or x >= width or grid[y][x] >= 0:
                        raise Unwritable("grid geometry")
                    grid[y][x] = n
            n += 1
    if any(own < 0 for line in grid for own in line):
        raise Unwritable("grid geometry")
    return grid


def _grid(grid: Node) -> list[str]:
    width, out = grid.data["grid_columns"], []
    for part in ("header", "rows"):
        rows = grid.kids(part)
        if not rows:
            continue
        if out or part == "rows" and grid.kids("header"):
            out.append("::")
        owner = occupancy(rows, width)
        cells = {(r, c.data["grid_col"] - 1): c for r, row in enumerate(rows) for c in row.kids("cells")}
        for r in range(len(rows)):
            if r:
                out.append("==")
            for c in range(width):
                if c:
                    out.append("--")
                if (r, c) in cells:
                    out += _sequence(cells[r, c].kids(), True)
                else:
                    out.append("^" if r and owner[r - 1][c] == owner[r][c] else "<")
    return out


def _resource(node: Node) -> str:
    data, image = node.data, node.type == "imageBlock"
    attrs = {k: v for k, v in data.items() if k.startswith("attr_") or k == "data_attrs"}
    label = node.kids("alt" if image else "label")
    _no_links(label)
    target = f"{'!' if image else ''}[{_inline(label, label=True, nested=True) if label else ''}]({_target(data, False)})"
    caption = f"\\\n*{_inline(node.kids('caption'), nested=True)}*" if node.kids("caption") else ""
    if image and not attrs:
        return target + caption
    kind = None if image else node.type.removesuffix("Block")
    return f"{_opener(kind, attrs, kind or 'image')}{target}{caption}</m>"


def _opener(kind: str | None, attrs: dict, context: str) -> str:
    if context_fault(context, attrs) or attrs.get("attr_lang", "") != ascii_lower(attrs.get("attr_lang", "")):
        raise Unwritable("attributes")
    parts = [(k, attrs[f"attr_{k}"]) for k in ("group", "lang", "preview") if f"attr_{k}" in attrs]
    for k, v in sorted(attrs.get("data_attrs", {}).items()):
        if not DATA_NAME.fullmatch(k):
            raise Unwritable("data attribute")
        parts.append((f"data-{k}", v))
    if not parts and kind is None:
        raise Unwritable("a wrapper without attributes")
    return f"<m{f' {kind}' if kind else ''}{''.join(f' {k}={_attribute(v)}' for k, v in parts)}>"


def _attribute(value: str) -> str:
    if value and not re.search(f"[\"'\\\\<>{WHITE}]", value):
        return value
    if re.search("[\r\n]", value):
        raise Unwritable("attribute value")
    return '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def _target(data: dict, cell: bool) -> str:
    """Destination and title as they stand between the parentheses."""
    value, title = data["dest"], data.get("title")
    if CONTROL.search(value) or title is not None and CONTROL.search(title):
        raise Unwritable("control character")
    depth = low = 0
    for c in value:
        depth += (c == "(") - (c == ")")
        low = min(low, depth)
    angle = depth != 0 or low < 0 or "<" in value or any(map(is_white, value))
    out = _escaped(value, "\\" + ("<>" if angle else "") + ("|" if cell else ""))
    out = f"<{out}>" if angle or not value else out
    return out if title is None else f'{out} "{_escaped(title, chr(92) + chr(34) + ("|" if cell else ""))}"'


def _escaped(value: str, chars: str) -> str:
    return "".join("\\" + c if c in chars or c == "&" and entity(value, i, len(value)) else c for i, c in enumerate(value))


def _no_links(nodes: list[Node]) -> None:
    if any(n.type in ("link", "autolink") for top in nodes for n in top.walk()):
        raise Unwritable("a link in a label")


def _inline(kids: list[Node], breaks: bool = False, label: bool = False, cell: bool = False, edges: bool = False, nested: bool = False) -> str:
    """Inline nodes as text; ``edges`` forbids white space at the outer ends, ``nested`` says that a closer follows."""
    if not kids:
        raise Unwritable("empty inline")
    if edges:
        for node, at in ((kids[0], 0), (kids[-1], -1)):
            if node.type == "text" and node.data["value"] and is_white(node.data["value"][at]):
                raise Unwritable("white space at an edge")
    out = ""
    for i, node in enumerate(kids):
        before, after = kids[i - 1] if i else None, kids[i + 1] if i + 1 < len(kids) else None
        out += _one(node, before, after, out, kids, i, breaks, label, cell, nested)
    return out


def _one(node: Node, before: Node | None, after: Node | None, done: str, kids: list[Node], i: int, breaks: bool, label: bool, cell: bool, nested: bool) -> str:
    kind, data = node.type, node.data

    def pipes(value: str) -> str:
        return value.replace("|", "\\|") if cell else value

    def within(allow: bool = breaks) -> str:
        if any(k.type == kind for k in node.kids()):
            raise Unwritable("same-kind nesting")
        return _inline(node.kids(), allow, label, cell, nested=True)

    if kind == "text":
        value = data["value"]
        if not value or before is not None and before.type == "text" or re.search("[\r\n]", value):
            raise Unwritable("text")
        text = escape_text(value, _slash_is_literal(kids, i, value, nested), label, _EDGES.get(before.type, "") if before else "", _EDGES.get(after.type, "") if after else "")
        return re.sub(r"(\\.)|\|", lambda m: m[1] or "\\|", text, flags=re.S) if cell else text
    if kind in ("softBreak", "hardBreak"):
        if not breaks or before is None or after is None or "Break" in before.type or "Break" in after.type:
            raise Unwritable("break")
        if before.type == "text" and is_white(before.data["value"][-1:]) or after.type == "text" and is_white(after.data["value"][:1]):
            raise Unwritable("white space at a break")
        if kind == "softBreak":
            return "\n"
        line = done.rpartition("\n")[2]
        return "\\\n" if line.strip("\\") else " \\\n"  # a line of backslashes alone ends in no break, however many there are
    if kind == "inlineCode":
        value = data["value"]
        if not value or re.search("[\r\n]", value):
            raise Unwritable("code")
        tick = "`" * (1 + max(map(len, re.findall("`+", value)), default=0))
        return f"{tick}{' ' if value.lstrip(' ').startswith('`') else ''}{pipes(value)}{' ' if value.rstrip(' ').endswith('`') else ''}{tick}"
    if kind == "inlineMath":
        if not data["value"] or re.search("[\r\n]|`\\$", data["value"]):
            raise Unwritable("math")
        return f"$`{pipes(data['value'])}`$"
    if kind in ("em", "strong"):
        inner = within()
        only = node.kids()[0] if len(node.kids()) == 1 else None
        if kind == "em" and only is not None and only.type == "strong":
            if any(k.type == "em" for k in only.kids()):
                return f"<i>{inner}</i>"
            return f"*__{_inline(only.kids(), breaks, label, cell, nested=True)}__*"
        fused = only is not None and only.type == "text" and not only.data["value"].strip("*_")
        if fused or not _stars_flank(inner, done, after):
            return f"<i>{inner}</i>" if kind == "em" else f"<b>{inner}</b>"
        return f"*{inner}*" if kind == "em" else f"**{inner}**"
    if kind in _MARKS:
        inner = within(kind == "deletion" and breaks)
        prior = "" if before is None else before.data["value"][-1:] if before.type == "text" else "-" if before.type == "obsolete" else ""
        next_ = after.data["value"][:1] if after is not None and after.type == "text" else ""
        if prior and (kind_of(prior) == "W" or kind == "obsolete" and prior == "-") or next_ and kind_of(next_) == "W":
            raise Unwritable("a delimiter beside a word")
        return f"{_MARKS[kind]}{inner}{_MARKS[kind]}"
    if kind in ("sup", "sub"):
        mark = "^" if kind == "sup" else "~"
        if not data["value"] or mark in data["value"] or any(map(is_white, data["value"])) or cell and "\\|" in data["value"]:
            raise Unwritable(kind)
        return f"{mark}{pipes(data['value'])}{mark}"
    if kind == "link":
        attrs = {k: v for k, v in data.items() if k.startswith("attr_") or k == "data_attrs"}
        _no_links(node.kids())
        if not data.get("download") and attrs:
            raise Unwritable("attributes on a link")
        inner = _inline(node.kids(), breaks, True, cell, nested=True) if node.kids() or not data.get("download") else ""
        text = f"[{inner}]({_target(data, cell)})"
        return f"{_opener('download', attrs, 'download')}{text}</m>" if data.get("download") else text
    if kind == "inlineImage":
        attrs = {k: v for k, v in data.items() if k.startswith("attr_") or k == "data_attrs"}
        _no_links(node.kids("alt"))
        text = f"![{_inline(node.kids('alt'), breaks, True, cell, nested=True) if node.kids('alt') else ''}]({_target(data, cell)})"
        return f"{_opener(None, attrs, 'image')}{text}</m>" if attrs else text
    if kind == "autolink":
        return f"<{pipes(data['value'])}>"
    if kind == "footnoteReference":
        if not is_identifier(data["identifier"]) or before is not None and before.type == "text" and before.data["value"][-1:] in (" ", "\t"):
            raise Unwritable("footnote reference")
        return f"[^{data['identifier']}]"
    if kind == "metadataSpan":
        return f"{_opener(None, data, 'generic')}{within()}</m>"
    raise Unwritable(kind)


def _stars_flank(inner: str, done: str, after: Node | None) -> bool:
    if is_white(inner[:1]) or is_white(inner[-1:]) or kind_of(done[-1:]) == "W" or after is not None and after.type in ("em", "strong"):
        return False
    if (after is None or after.type == "softBreak") and done.endswith("\\\n"):
        line = done[:-2].rpartition("\n")[2]
        if line.startswith(("![", "<m")) and atom_end(line, 0, len(line), False) == len(line):
            return False
    return kind_of("" if after is None else after.data["value"][:1] if after.type == "text" else "<") != "W"


def _slash_is_literal(kids: list[Node], i: int, value: str, nested: bool) -> bool:
    """Whether a backslash at the end of a text needs no escape there: nothing follows it, or it is all that its line has."""
    if nested or not value.endswith("\\"):
        return False
    if len(value) > 1 and i + 1 == len(kids):
        return True
    return value == "\\" and i + 1 < len(kids) and "Break" in kids[i + 1].type and (i == 0 or "Break" in kids[i - 1].type)


def _literal(d: str) -> str:
    return "".join("\\" + c for c in d) if d in ("**", "~~") else "\\" + d


def escape_text(value: str, slash_literal: bool, label: bool, lead: str = "", tail: str = "") -> str:
    """Text with a backslash at the leftmost place where it would be read as something else."""
    out, i, last, url = [], 0, len(value) - 1, value.find("http")
    while i <= last:
        if 0 < i < last:
            if 0 <= url < i:
                url = value.find("http", i)
            m = _TEXT.search(value, i)
            stop = min(m.start(), last) if m else last
            if 0 <= url < stop:
                stop = url
            if stop > i:
                out.append(value[i:stop])
                i = stop
                continue
        c, following = value[i], value[i + 1:i + 2]
        step, put = 1, c
        if i == 0 and c in lead or i == last and c in tail or label and c in "[]" or c == "`":
            put = "\\" + c
        elif c == "\\":
            escapes = _LITERAL_SLASH.match(following) if following else not slash_literal
            put = "\\\\" if escapes else "\\"
        elif c == "&" and entity(value, i, len(value)) or c == "$" and following == "`":
            put = "\\" + c
        elif c == "!" and following == "[" and _link_like(value, i + 1):
            put, step = "!\\[", 2
        elif c == "[" and (_link_like(value, i) or REFERENCE.match(value, i)) or c == "<" and _angle_like(value, i):
            put = "\\" + c
        elif c == "h" and (m := _SCHEME.match(value, i)) and kind_of(value[i - 1:i] if i else "") != "W":
            put, step = m[0][:-3] + "\\://", m.end() - i
        elif c in "^~" and _atom_like(value, i, c):
            put = "\\" + c
        elif d := delimiter_at(value, i, len(value)):
            before, after = kind_of(value[i - 1:i] if i else ""), kind_of(value[i + len(d):i + len(d) + 1])
            if after != "S" and before != "W":
                put, step = ("\\" + c, 1) if d in ("==", "++") and _pairs_on(value, i) else (_literal(d), len(d))
            elif len(d) > 1:
                edge = i == 0 and c in lead or i + len(d) - 1 == last and c in tail
                put, step = ("\\" + c) * len(d) if edge else d, len(d)
        out.append(put)
        i += step
    return "".join(out)


def _pairs_on(value: str, at: int) -> bool:
    """Whether the second of two equal marks would pair with a third that itself gets no escape."""
    c, past = value[at], at + 2
    if value[past:past + 1] != c:
        return False
    return value[past + 1:past + 2] != c or kind_of(value[past + 2:past + 3]) == "S"


def _link_like(value: str, at: int) -> bool:
    """``[…](…)`` with balanced parentheses somewhere after a bracket."""
    label, depth = value.find("](", at + 1), 0
    if label < 0:
        return False
    for m in re.compile(r"\\.|[()]", re.S).finditer(value, label + 2):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            if not depth:
                return True
            depth -= 1
    return False


def _angle_like(value: str, at: int) -> bool:
    if re.match(r"<(?:[ibm]>|m )", value[at:at + 3]):
        return True
    close = value.find(">", at + 1)
    inner = value[at + 1:close] if close >= 0 else ""
    sign = inner.find("@")
    return inner.startswith(("http://", "https://")) or sign > 0 and inner.find(".", sign + 2) > sign + 1


def _atom_like(value: str, at: int, mark: str) -> bool:
    close = value.find(mark, at + 1)
    return close > at + 1 and not any(map(is_white, value[at + 1:close]))


__all__ = ["write_document", "occupancy", "COLONS", "HEADING", "char"]
