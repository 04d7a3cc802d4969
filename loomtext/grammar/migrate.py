"""Texts of the older dialect, as far as they differ by spelling: what changes is recorded.

Attribute spans ``[text]{key: value}`` become metadata wrappers, container fences of the old
form get their space, and heading slugs become ids.  A result that can't be read is named
with its smallest failing block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .api import canonical_text
from .attributes import DATA_NAME
from .document import read_document

#: The outcomes of a migration, from best to worst.
BUCKETS = ("clean", "mapped", "review", "dropped", "unrepresentable")
_SPAN = re.compile(r"(?<![\\!\]])\[((?:[^\[\]\\]|\\.)+)\]\{([a-z][a-z0-9_-]*: *[^{}:]+(?:, *[a-z][a-z0-9_-]*: *[^{}:]+)*)\}")
_FENCE = re.compile(r"^(:{3,})(?=[^\s:])", re.M)


@dataclass(frozen=True)
class Step:
    """One change: mapped, dropped, unrepresentable or review."""

    category: str
    message: str


def migrate_text(raw: str | None) -> tuple[str | None, str, list[Step]]:
    """The canonical text (None if there is none), the bucket and the steps."""
    steps: list[Step] = []

    def span(m: re.Match) -> str:
        parts = []
        for pair in re.split(r", *(?=[a-z][a-z0-9_-]*:)", m[2]):
            key, _, value = pair.partition(":")
            if key == "lang":
                parts.append(f"lang={value.strip()}")
            elif DATA_NAME.fullmatch(key):
                quoted = value.strip().replace("\\", "\\\\").replace('"', '\\"')
                parts.append(f'data-{key}="{quoted}"')
            else:
                steps.append(Step("dropped", f"attribute {key}"))
        steps.append(Step("mapped", "attribute span"))
        return f"<m {' '.join(parts)}>{m[1]}</m>" if parts else m[1]

    text = _SPAN.sub(span, raw or "")
    text, n = _FENCE.subn(r"\1 ", text)
    steps += [Step("mapped", "container fence")] * n
    canonical = canonical_text(text)
    if canonical is None:
        steps.append(Step("unrepresentable", smallest_failure(text)))
    found = {s.category for s in steps}
    bucket = next((b for b in ("unrepresentable", "dropped", "review", "mapped") if b in found), "clean")
    return canonical, bucket, steps


def smallest_failure(text: str) -> str:
    """The first finding of the smallest blank-separated block that can't be read alone, or of the whole."""
    blocks = [b for b in re.split(r"\n[ \t]*\n", text) if canonical_text(b) is None]
    worst = min(blocks, key=len, default=text)
    errors = [f.message for f in read_document(worst).findings if f.severity == "error"]
    return errors[0] if errors else "no canonical form"


def slugs(headings: list[str]) -> list[str]:
    """Slugs of headings, unique by ``-2``, ``-3`` … in document order."""
    used: set[str] = set()
    out = []
    for h in headings:
        base = re.sub(r"[^\w]+", "-", h.lower()).strip("-") or "section"
        own, n = base, 1
        while own in used:
            n += 1
            own = f"{base}-{n}"
        used.add(own)
        out.append(own)
    return out
