"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Words are runs of ASCII letters, digits and any non-ASCII characters, lower-cased in A-Z.
Every window of ``window`` consecutive words of an item (the whole item if it is shorter)
is a pattern; each document is scanned once, and hits map back to offsets in the original.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_of, fields_of, held

WINDOW = 13
#: Bytes of test items that one automaton holds; more items make more automata, each with a map of its own.
AUTOMATON_BYTES = 8 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class ItemAutomaton:
    """Aho-Corasick over the windows of some items; a pattern knows its words and its items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        owners: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = [w.decode("utf-8", "replace") for w in normal_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i:i + window]
                owners.setdefault(f" {' '.join(part)} ", (len(part), set()))[1].add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, owner in owners.items():
            self.machine.add_word(pattern, owner)
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def hits(self, normal: str, starts: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """First word, number of words and items of each window found in a normalised text."""
        if not self.empty:
            for end, (size, items) in self.machine.iter(normal):
                yield int(np.searchsorted(starts, end)) - size, size, items


def scan(text: str | None, automata: list[ItemAutomaton]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges (merged, half open) and items with a window in the text."""
    words = normal_words(text)
    if not words:
        return 0, [], set()
    normal = " " + b" ".join(words).decode("utf-8", "replace") + " "
    starts, found, items = None, [], set()
    for machine in automata:
        if machine.empty:
            continue
        if starts is None and next(machine.machine.iter(normal), None) is not None:
            starts = np.cumsum([1, *(len(w.decode("utf-8", "replace")) + 1 for w in words)])
        if starts is not None:
            for first, size, of in machine.hits(normal, starts):
                found.append((first, first + size))
                items |= of
    return len(words), merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = AUTOMATON_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of ``most`` bytes, or one item; the driver holds one block at a time."""
    block: list[tuple[str, str | None]] = []
    used = 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if block and used > most:
            yield block
            block, used = [], 0
        block.append((row["i"] or "", row["t"]))
        used += len(row["t"] or "")
    yield block


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", most: int = AUTOMATON_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``hit_spans``, code-point offsets in the text.

    A word is hit if it lies in any occurrence of a window.  Null and wordless texts have
    no words and no hits; null and wordless items have no windows; an empty item table
    hits nothing.  Repeated rows are judged one by one, repeated items count once.  Very
    long texts are scanned whole.  Columns named like an added one are replaced.  Rows don't move.

    Items of any size are held in automata of ``most`` bytes of text each.  A map uses one
    of them; where there are more, maps follow each other and add to what was hit before.
    """
    added = ("n_words", "n_hit", "items", "hit_spans")
    kept = [c for c in df.columns if c not in added]
    sc = df.sparkSession.sparkContext
    private = next(p for p in map("_hit{}".format, range(len(kept) + 1)) if not {p, p + "_of"} & set(kept))
    spans_type, names_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    spans_ddl = "array<struct<start:bigint,end:bigint>>"

    def pass_of(block: list[tuple[str, str | None]], first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = sc.broadcast(block)  # ``most`` bytes, or one item
        name = "items " + digest_of(str(window).encode(), *(x for i, t in block for x in (i.encode(), (t or "").encode("utf-8", "replace"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held(name, lambda: ItemAutomaton(shared.value, window))
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                n_words, hit, of = zip(*(scan(t, [automaton]) for t in texts), strict=True) if texts else ((), (), ())
                if not first:  # what the maps before have found
                    hit = [merged([*a, *((x["start"], x["end"]) for x in b)]) for a, b in zip(hit, batch.column(len(kept)).to_pylist(), strict=True)]
                    of = [a.union(b) for a, b in zip(of, batch.column(len(kept) + 1).to_pylist(), strict=True)]
                items = pa.array([sorted(x) for x in of], names_type)
                if last:
                    spans = []
                    for t, ranges in zip(texts, hit, strict=True):
                        at = [m.span() for m in _WORD.finditer(t)] if ranges else []
                        spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
                    columns = [pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in r) for r in hit], pa.int64()), items, pa.array(spans, spans_type)]
                    yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *columns], names=[*kept, *added])
                else:
                    ranges = pa.array([[{"start": a, "end": b} for a, b in r] for r in hit], spans_type)
                    yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, ranges, items], names=[*kept, private, private + "_of"])

        return run

    out, own, blocks = df.select(*[F.col(f"`{c}`") for c in kept]), fields_of(df, kept), blocks_of(items, item_id, item_text, most)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        last = following is None
        schema = f"{own}, n_words bigint, n_hit bigint, items array<string>, hit_spans {spans_ddl}" if last else f"{own}, `{private}` {spans_ddl}, `{private}_of` array<string>"
        out, block, first = out.mapInArrow(pass_of(block, first, last), schema), following, False
    return out


def contaminated() -> Column:
    """The verdict: at least one word in twenty of the text is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
