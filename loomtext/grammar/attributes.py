"""The ``<m …>`` opener, attribute rules and destinations."""

from __future__ import annotations

import re
import unicodedata

from .chars import CONTROL, WHITE, char, decode_link, is_white, language_tag_ok
from .tree import Fault

KINDS = ("video", "audio", "embed", "download")
_NAME = re.compile(r"[^= >]*")
_QUOTED = re.compile(r'"((?:[^"\\\n\r]|\\["\\])*)"')
_BARE = re.compile(rf"[^\"'\\<>{WHITE}]+")
DATA_NAME = re.compile(r"[a-z][a-z0-9_-]*")
#: What may not stand on each kind of target.
FORBIDDEN = {"generic": ("attr_group", "attr_preview"), "image": ("attr_preview",), "download": ("attr_group", "attr_preview")}


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def read_opener(text: str, at: int, end: int) -> tuple[str | None, dict, int] | None:
    """Kind, attributes and end of the ``<m`` opener at a place; None if there is none."""
    if not text.startswith("<m", at, end) or at + 2 >= end:
        return None
    mark = text[at + 2]
    if mark == ">":
        return None, {}, at + 3
    if mark != " ":
        return None

    def bad(why: str) -> Fault:
        return Fault(why, at, end)

    kind, found, here, first = None, {}, at + 3, True
    while here < end:
        if text[here] == ">":
            return kind, _stored(found), here + 1
        m = _NAME.match(text, here, end)
        name, here = m[0], m.end()
        if not name:
            raise bad("invalid resource opener spacing")
        if first and char(text, here) != "=":
            if name not in KINDS:
                raise bad("resource kind must be lowercase" if name.lower() in KINDS else "unknown resource attribute")
            kind = name
            if char(text, here) == ">":
                return kind, {}, here + 1
        else:
            if name not in ("group", "lang", "preview") and not (name.startswith("data-") and DATA_NAME.fullmatch(name[5:])):
                raise bad("unknown resource attribute")
            if name in found:
                raise bad("duplicate resource attribute")
            if char(text, here) != "=":
                raise bad("resource attribute requires a value")
            value = _QUOTED.match(text, here + 1, end) if char(text, here + 1) == '"' else _BARE.match(text, here + 1, end)
            if value is None:
                raise bad("invalid resource attribute value")
            found[name] = re.sub(r"\\(.)", r"\1", value[1]) if value.re is _QUOTED else value[0]
            here = value.end()
        first = False
        if char(text, here) == ">" and kind != name:
            continue
        if char(text, here) != " ":
            raise bad("invalid resource attribute separator")
        here += 1
        if char(text, here) == ">":
            raise bad("trailing space in resource opener")
    raise bad("unclosed resource opener")


def _stored(found: dict[str, str]) -> dict:
    out: dict = {}
    data = {k[5:]: v for k, v in found.items() if k.startswith("data-")}
    if "group" in found:
        out["attr_group"] = unicodedata.normalize("NFC", found["group"])
    if "lang" in found:
        out["attr_lang"] = ascii_lower(found["lang"])
    if "preview" in found:
        out["attr_preview"] = found["preview"]
    if data:
        out["data_attrs"] = data
    return out


def context_fault(context: str, attrs: dict) -> str | None:
    """Why attributes may not stand where they do."""
    if attrs.get("attr_group") == "":
        return "resource group must be non-empty"
    if "attr_lang" in attrs and not language_tag_ok(attrs["attr_lang"]):
        return "invalid BCP 47 language tag"
    if "attr_preview" in attrs and CONTROL.search(attrs["attr_preview"]):
        return "invalid resource preview destination"
    if any(k in attrs for k in FORBIDDEN.get(context, ())):
        return f"attribute is not allowed on {context}"
    return None


def read_destination(text: str, at: int, end: int) -> tuple[str, str | None, int] | str:
    """Destination, title and end after ``](``, or what is wrong with them."""
    here, angle = at, char(text, at) == "<"
    if angle:
        here += 1
        begin = here
        while here < end and text[here] != ">":
            if text[here] == "\\" and here + 1 < end:
                here += 2
                continue
            if CONTROL.match(text[here]):
                return "a control character in the destination"
            here += 1
        if here >= end:
            return "the destination opened with < has no >"
        value, here = decode_link(text[begin:here]), here + 1
    else:
        depth = 0
        while here < end:
            c = text[here]
            if c == "\\" and here + 1 < end:
                here += 2
                continue
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            elif is_white(c) or CONTROL.match(c):
                break
            here += 1
        if here < end and CONTROL.match(text[here]):
            return "a control character in the destination"
        if depth:
            return "an unbalanced parenthesis in the destination"
        value = decode_link(text[at:here])
    before = here
    here = _past_blanks(text, here, end)
    title = None
    if (opener := char(text, here)) and opener in "\"'(":
        closer = ")" if opener == "(" else opener
        here += 1
        begin = here
        while here < end and text[here] != closer:
            here += 2 if text[here] == "\\" and here + 1 < end else 1
        if here >= end:
            return "the link title is not closed"
        title = decode_link(text[begin:here])
        if CONTROL.search(title):
            return "a control character in the link title"
        here = _past_blanks(text, here + 1, end)
    if not value and not angle and here > before and title is None:
        return "a space in the destination"
    if CONTROL.search(value):
        return "a control character in the destination"
    if char(text, here) != ")":
        return "the destination is not closed with )"
    return value, title, here + 1


def _past_blanks(text: str, at: int, end: int) -> int:
    while at < end and text[at] in " \t":
        at += 1
    return at
