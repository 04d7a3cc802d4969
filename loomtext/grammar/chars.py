"""Character classes, entities and small scanners shared by reader and writer."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import html5

#: The code points with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = frozenset(WHITE)
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
CONTROL = re.compile("[\x00-\x08\x0a-\x1f\x7f-\x9f]")
PUNCTUATION = r"!-/:-@\[-`{-~"
ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([0-9A-Za-z]+));")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]+")
REFERENCE = re.compile(r"\[\^([A-Za-z0-9_-]+)\]")
URL = re.compile(f"https?://[^<>{WHITE}]+")
_UNBROKEN = re.compile(f"[^<>{WHITE}]*")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z0-9-]{2,}")


@lru_cache(maxsize=1 << 16)
def kind_of(ch: str) -> str:
    """W for letters, decimal digits and the underscore, S for white space and the edge of a slice, P otherwise."""
    if ch == "" or ch in _WHITE:
        return "S"
    if ch == "_":
        return "W"
    category = unicodedata.category(ch)
    return "W" if category[0] == "L" or category == "Nd" else "P"


def is_white(ch: str) -> bool:
    return ch != "" and ch in _WHITE


def char(text: str, at: int, low: int = 0, high: int | None = None) -> str:
    """The character at a place, or nothing outside of the slice."""
    return text[at] if low <= at < (len(text) if high is None else high) else ""


def is_identifier(text: str) -> bool:
    return IDENTIFIER.fullmatch(text) is not None


def _allowed(text: str) -> bool:
    return all(c == "\t" or not (c < " " or "\x7f" <= c <= "\x9f" or "\ud800" <= c <= "\udfff") for c in text)


def entity(text: str, at: int, end: int) -> tuple[str, int] | None:
    """The decoded entity at a place and where it ends."""
    m = ENTITY.match(text, at, end)
    if m is None:
        return None
    if m[3] is not None:
        value = NAMED.get(m[3])
    else:
        code = int(m[1]) if m[1] is not None else int(m[2], 16)
        value = chr(code) if 0 < code <= 0x10FFFF else None
    return (value, m.end()) if value is not None and _allowed(value) else None


_LINK_PART = re.compile(rf"\\([{PUNCTUATION}])|&[#0-9A-Za-z]+;")


def decode_link(text: str) -> str:
    """A destination or title with escapes and entities resolved."""
    def one(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        found = entity(m[0], 0, len(m[0]))
        return found[0] if found else m[0]

    return _LINK_PART.sub(one, text)


def is_email(text: str) -> bool:
    return text.count("@") == 1 and EMAIL.fullmatch(text) is not None and not re.search(r"@\.", text)


def is_url(text: str) -> bool:
    return URL.fullmatch(text) is not None


def bare_url_end(text: str, at: int, end: int) -> int:
    """Where the bare URL at a place ends once trailing marks are left out; ``at`` if nothing is left."""
    stop = _UNBROKEN.match(text, at, end).end()
    while stop > at and text[stop - 1] in "?!.,:*_~":
        stop -= 1
    while stop > at and text[stop - 1] == ")" and text.count(")", at, stop) > text.count("(", at, stop):
        stop -= 1
    if tail := re.search(r"&[0-9A-Za-z]+;\Z", text[at:stop]):
        stop = at + tail.start()
    return stop if is_url(text[at:stop]) else at


def language_tag_ok(tag: str) -> bool:
    """Well-formed language tags: language, extended, script, region, variants, extensions, private use."""
    parts = tag.split("-")
    if not all(re.fullmatch(r"[A-Za-z0-9]{1,8}", p) for p in parts):
        return False
    if parts[0] in ("x", "i"):
        return len(parts) > 1
    shape = re.fullmatch(
        r"(?:[A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}|[A-Za-z]{4,8})(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|[0-9]{3}))?"
        r"(?:-(?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*((?:-[0-9A-WYZa-wyz](?:-[A-Za-z0-9]{2,8})+)*)(?:-x(?:-[A-Za-z0-9]{1,8})+)?", tag)
    if shape is None:
        return False
    single = re.findall(r"-([A-Za-z0-9])(?=-)", shape[1])
    return len(single) == len(set(single))
