"""License scans by conditional compression.

Short notices: candidate blocks are cut around each word that a notice can't do without,
such as ``mozilla``: all runs of words, also across line breaks, that start and end with a
word of the template and reach around it; whole lines are candidates too, for notices
stretched by more words than a run may add.  Whole license texts: a text is looked at where
it holds as many different words of the template as a confirmed block must; blocks are cut
where runs of four words agree with the template, at the places that its length implies.

A block is compressed alone and with the template as zstandard raw-content dictionary;
blocks are ranked by how much smaller they become.  They are tried in that order and each
whose wording is confirmed is reported unless it overlaps one before it: the words of the
template are aligned with the block, and what is missing or different is listed.  Numbers,
and the words that tell licenses apart, must all be there.  Nothing is left out by these
cuts that the wording would confirm: they ask only for words that it asks for.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .license_texts import TEXTS

#: Short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
#: Words that tell licenses apart; a confirmed block has those of its template.
TELLING = set("apache mit gnu lesser affero general public mozilla bsd 3-clause 2-clause cc cc0 by by-sa by-nc by-nd".split())
#: Telling words that name a license on their own.
PIVOTS = "apache mozilla bsd gnu cc0 cc mit".split()
#: Identifiers that an SPDX line may name, and the words between them.
IDENTIFIERS = """Apache-2.0 MIT GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC0-1.0 ISC""".split()
SPDX = [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS]
JOINED = {"or", "and", "with"} | {name.lower() for name in IDENTIFIERS}
#: Words that a run may hold beyond twice the template's.
BEYOND = 4
#: Share of the template's words that may be missing, and the least size reduction.
MISSING, LEAST = 0.25, 0.15
LEVEL = 3
#: Words of a run that must agree for a whole license text to be looked for there.
AGREEING = 4
_CLEAN = str.maketrans({c: " " for c in "\"'`,;:()[]{}<>*#/!?&|=+~"})
_WORD = re.compile(r"[0-9A-Za-z][0-9A-Za-z.\-]*[0-9A-Za-z]|[0-9A-Za-z]")

#: White space with the comment marks of new lines in it, a space to the compressor.
_BREAK = re.compile(r"\s+(?:[*#/;%-]+\s+)*")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def strict(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


class Template:
    """A notice with its compressor and the words that a block can't do without."""

    def __init__(self, name: str, text: str, level: int):
        import zstandard as zstd

        content = zstd.ZstdCompressionDict(text.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        self.name, self.wanted, self.spdx = name, wording(text), text.startswith("SPDX")
        self.compress = zstd.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False).compress
        self.words, self.strict = set(self.wanted), {w for w in self.wanted if strict(w)}
        self.least, self.reach = (1 - MISSING) * len(self.wanted), 2 * len(self.wanted) + BEYOND
        #: A word that every confirmed block holds, as uncommon as there is one.
        self.pivot = self.wanted[0] if self.spdx else next(w for w in (*PIVOTS, *self.wanted) if w in self.strict)

    def confirm(self, words: list[str], whole: bool = False) -> tuple[list[str], list[str]] | None:
        """Missing and added words, if the wording is confirmed; of ``whole`` blocks the first and last word must be the template's."""
        missing, added, first, last = differences(self.wanted, words)
        if whole and (first, last) != (0, len(words)):
            return None
        foreign = any(w not in JOINED and "exception" not in w for w in added) if self.spdx else any(w in TELLING for w in added)
        return None if foreign or len(missing) > MISSING * len(self.wanted) or any(map(strict, missing)) else (missing, added)


class Passage:
    """A whole license text with its compressor, the words that it has, and the places of its runs."""

    def __init__(self, name: str, text: str, level: int):
        import zstandard as zstd

        content = zstd.ZstdCompressionDict(_BREAK.sub(" ", text.lower()).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        self.name, self.wanted = name, wording(text)
        self.compress = zstd.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False).compress
        self.words, self.strict = set(self.wanted), {w for w in self.wanted if w in TELLING}
        # a confirmed block lacks a share of the words at most, so of the different ones no more; words with marks inside are left to the wording
        self.plain = {w for w in self.words if w.isalpha()}
        self.least = len(self.plain) - int(MISSING * len(self.wanted))
        self.places: dict[tuple[str, ...], list[int]] = {}
        for i in range(len(self.wanted) - AGREEING + 1):
            self.places.setdefault(tuple(self.wanted[i:i + AGREEING]), []).append(i)

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """Half-open runs of words where the passage may lie: starts that runs of agreeing words imply, near ones together."""
        n, slack = len(self.wanted), int(MISSING * len(self.wanted)) + BEYOND
        starts = sorted({i - p for i in range(len(words) - AGREEING + 1) for p in self.places.get(tuple(words[i:i + AGREEING]), ())})
        out, k = [], 0
        while k < len(starts):
            last = k
            while last + 1 < len(starts) and starts[last + 1] - starts[k] <= slack:
                last += 1
            out.append((max(0, starts[k] - BEYOND), min(len(words), starts[last] + n + slack)))
            k = last + 1
        return out


class Scanner:
    """Compressors for all templates, made once per worker."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = LEVEL, texts: dict[str, str] = TEXTS):
        import zstandard as zstd

        self.plain = zstd.ZstdCompressor(level=level, write_content_size=False).compress
        self.templates = [Template(name, text, level) for name, text in [*sorted(templates.items()), *SPDX]]
        self.passages = [Passage(name, text, level) for name, text in sorted(texts.items())]
        self.by_pivot: dict[str, list[Template]] = {}
        for t in self.templates:
            self.by_pivot.setdefault(t.pivot, []).append(t)
        self.pivots = re.compile(rf"(?<![0-9A-Za-z])(?:{'|'.join(map(re.escape, self.by_pivot))})(?![0-9A-Za-z])", re.I)
        self.all_words = set().union(*(p.plain for p in self.passages))

    def passage_blocks(self, text: str) -> list[tuple[int, int, str, float, list[str], list[str]]]:
        """Confirmed blocks of whole license texts; of overlapping ones the one that shrinks most."""
        present = set(text.lower().translate(_CLEAN).replace(".", " ").split()) & self.all_words
        able = [p for p in self.passages if len(present & p.plain) >= p.least]
        if not able:
            return []
        found = list(_WORD.finditer(text))
        words, made = [m.group().lower() for m in found], []
        for p in able:
            for a, b in p.spans(words):
                missing, added, first, last = differences(p.wanted, words[a:b])
                if first == last or len(missing) > MISSING * len(p.wanted) or any(w in p.strict for w in missing):
                    continue
                start, end = found[a + first].start(), found[a + last - 1].end()
                raw = _BREAK.sub(" ", text[start:end].lower()).encode("utf-8", "replace")
                made.append((1 - len(p.compress(raw)) / len(self.plain(raw)), p.name, start, end, missing, added))
        nearest: list[tuple] = []  # of overlapping blocks of one text the one that differs least
        for m in sorted((m for m in made if m[0] >= LEAST), key=lambda m: (len(m[4]) + len(m[5]), -m[0], m[1:4])):
            if not any(m[1] == o[1] and m[2] < o[3] and o[2] < m[3] for o in nearest):
                nearest.append(m)
        out: list[tuple[int, int, str, float, list[str], list[str]]] = []
        for reduction, name, start, end, missing, added in sorted(nearest, key=lambda m: (-m[0], m[1:4])):
            if not any(start < y and x < end for x, y, *_ in out):
                out.append((start, end, name, reduction, missing, added))
        return out

    def best(self, block: str) -> tuple[str, float, list[str], list[str]] | None:
        """Name, size reduction, missing and added words of the first template in rank whose wording is confirmed."""
        raw = block.encode("utf-8", "replace")
        alone, words = len(self.plain(raw)), wording(block)
        able = [t for t in self.templates if t.strict.issubset(words)]
        for reduction, template in sorted(((1 - len(t.compress(raw)) / alone, t) for t in able), key=lambda r: (-r[0], r[1].name)):
            if reduction < LEAST:
                return None
            if found := template.confirm(words):
                return template.name, reduction, *found
        return None

    def blocks(self, text: str) -> list[tuple[int, int, str, float, list[str], list[str]]]:
        """Start, end, name, size reduction, missing and added words of every confirmed block, by start."""
        whole = self.passage_blocks(text)
        marks = [m.start() for m in self.pivots.finditer(text)]
        if not marks:
            return sorted(whole)
        found = list(_WORD.finditer(text))
        words, starts = [m.group().lower() for m in found], [m.start() for m in found]
        runs: dict[tuple[int, int], list[Template]] = {}
        for i in sorted({bisect_right(starts, c) - 1 for c in marks} - {-1}):
            for t in self.by_pivot.get(words[i], ()):
                near = set(words[max(0, i - t.reach):i + t.reach + 1])
                if t.strict <= near and len(t.words & near) >= t.least - len(t.wanted) + len(t.words):
                    own = [k for k in range(max(0, i - t.reach), min(len(words), i + t.reach + 1)) if words[k] in t.words]
                    for x, first in enumerate(own):
                        for y in range(x + math.ceil(t.least) - 1, len(own)):
                            if first <= i <= own[y] and own[y] - first < t.reach and t not in (held := runs.setdefault((first, own[y]), [])):
                                held.append(t)
        confirmed = []
        for (a, b), able in runs.items():
            able = [(t, c) for t in able if t.strict.issubset(words[a:b + 1]) and (c := t.confirm(words[a:b + 1], whole=True))]
            if able:
                end = found[b].end()
                end += text[end:end + 1] == "."
                raw = _BREAK.sub(" ", text[starts[a]:end]).encode("utf-8", "replace")
                alone = len(self.plain(raw))
                confirmed += [(1 - len(t.compress(raw)) / alone, t.name, a, b, end, *c, t) for t, c in able]
        out, taken = [], []
        for reduction, name, a, b, *_, template in sorted((c for c in confirmed if c[0] >= LEAST), key=lambda c: (-c[0], c[1:4])):
            if any(a <= y and x <= b and not (template.spdx and t.spdx and t is not template) for x, y, t in taken):
                continue
            same = [c for c in confirmed if c[0] >= LEAST and c[-1] is template and c[2] <= b and a <= c[3] and not any(c[2] <= y and x <= c[3] and not (template.spdx and t.spdx and t is not template) for x, y, t in taken)]
            reduction, name, a, b, end, missing, added, _ = min(same, key=lambda c: (len(c[5]) + len(c[6]), -c[0], c[2]))
            taken.append((a, b, template))
            out.append((starts[a], end, name, reduction, missing, added))
        start = 0
        for line in text.split("\n"):
            end = start + len(line)
            if any(start <= c < end for c in marks) and not any(x < end and start < y for x, y, *_ in out) and (hit := self.best(line)):
                out.append((start, end, *hit))
            start = end + 1
        return sorted([*whole, *(o for o in out if not any(x < o[1] and o[0] < y for x, y, *_ in whole))])


def differences(wanted: list[str], words: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the block lacks, the block's words between the template's first and last, and where these lie."""
    matcher = SequenceMatcher(None, wanted, words, autojunk=False)
    blocks = [m for m in matcher.get_matching_blocks() if m.size]
    if not blocks:
        return wanted, [], 0, 0
    first, last = blocks[0].b, blocks[-1].b + blocks[-1].size
    missing, added = [], []
    for tag, a, b, c, d in matcher.get_opcodes():
        if tag != "equal":
            missing += wanted[a:b]
            added += [words[i] for i in range(c, d) if first <= i < last]
    return missing, added, first, last


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each confirmed block: key, ``line_no`` of its start (from 1), ``license``, ``reduction``, ``missing``, ``added``, ``exact``, ``block``.

    Null and empty texts have no blocks; a block that repeats is reported each time; of
    blocks that shrink alike the name and place that sort first goes ahead.  Very long texts
    and lines are scanned whole.  An empty table gives no rows, and other columns are not
    read.  Rows don't move.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, line_no bigint, license string, reduction double, missing array<string>, added array<string>, exact boolean, block string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held("licenses", Scanner)
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                for start, end, name, reduction, missing, added in scanner.blocks(t):
                    rows.append(i)
                    found.append((t.count("\n", 0, start) + 1, name, reduction, missing, added, not missing and not added, t[start:end]))
            if found:
                types = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=[key, "line_no", "license", "reduction", "missing", "added", "exact", "block"])

    return df.select(key, F.col(text)).mapInArrow(run, schema)
