"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled into a deterministic automaton
over *tokens* whose language is exactly the set of token sequences that BPE produces.
It starts as one state with an arc for every byte.  The merge ``u v -> w`` then applies
its gadget: every state with an arc ``u`` gets an arc ``w`` (leading to a copy of the
state behind ``v``), and the state behind ``u`` loses its arc ``v``.  All arcs of one
label always lead to one state, so a state is named by the token that leads to it, and
a state's arc row is a bit vector over the vocabulary.  Rows obey two recurrences, which
are the gadget read along a row and along a column; they are compiled row by row when a
text first reaches the state, so memory follows the states in use.

Encoding a pre-split word follows arcs from the start state.  Only one state can stand at
a place of the word, so a place from which the word can't be finished is given up for
good and the path goes on with a shorter arc.  Decoding joins the arc labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest_of, held

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of printable ASCII, line breaks, tabs and Latin-1 letters only,
#: where the standard library's classes agree with the Unicode properties above.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_OUTSIDE_LATIN = re.compile(f"[^\t\n\r -~¡-©«-±´-¸º»¿-ÿ]")
_SPLIT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t\n\r0-9{_LATIN}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_SPLIT = regex.compile(SPLIT)

#: Bounds of what one worker keeps: bytes of pre-split words with their ids, the longest word kept, and compiled states.
KEPT_BYTES, LONGEST_KEPT, STATES_KEPT = 16 << 20, 256, 6_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The compiled automaton of one vocabulary; ``never`` marks arcs that no merge removes."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = [*alphabet, *(a + b for a, b in pairs)]
        at = {n: k for k, n in enumerate(names)}
        if len(at) != len(names):
            raise ValueError("two merges make the same token")
        self.size = len(names)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.merges_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_left: dict[int, list[tuple[int, int]]] = {}
        depth = np.zeros(self.size, np.int64)
        for k, (a, b) in enumerate(pairs, start=256):
            u, v = at[a], at[b]
            self.left[k], self.right[k], depth[k] = u, v, depth[u] + 1
            by_left.setdefault(u, []).append((v, k))
        for u, found in by_left.items():
            self.merges_of[u] = tuple(np.array(x, np.int64) for x in zip(*found, strict=True))
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.labels = [bytes(alphabet[c] for c in n) for n in names]
        self.ids = [vocab[n] for n in names]
        self.sizes = [len(x) for x in self.labels]
        self.label_of_id = {i: self.labels[k] for k, i in enumerate(self.ids)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label_of_id.update({i: s.encode() for s, i in self.special.items()})
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.prefixes: dict[bytes, int] = {}
        for k, label in enumerate(self.labels):
            for n in range(1, len(label)):
                self.prefixes.setdefault(label[:n], -1)
            self.prefixes[label] = k
        self.never = np.int64(self.size)
        self.rows: dict[int, bytes] = {}
        self.lost: dict[int, np.ndarray] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0

    def _cleared(self, x: int) -> np.ndarray:
        """The merge that removes each arc of state ``x``, ``never`` where none does."""
        at = np.full(self.size, self.never)
        if x in self.merges_of:
            seconds, made = self.merges_of[x]
            at[seconds] = made
        return at

    def _born(self, x: int) -> np.ndarray:
        """Whether the gadgets ever gave state ``x`` each arc (packed): its row, with the arcs that merges removed."""
        if (row := self.rows.get(x)) is not None:
            packed = np.frombuffer(row, np.uint8).copy()
            np.bitwise_or.at(packed, self.lost[x] >> 3, (1 << (self.lost[x] & 7)).astype(np.uint8))
            return packed
        alive, cleared = np.zeros(self.size, bool), self._cleared(x)
        if x < 256:
            alive[:256] = True
        else:  # a copy of the state behind the merge's second token, as it was then
            v, u = int(self.right[x]), int(self.left[x])
            then = np.unpackbits(self._born(v), count=self.size, bitorder="little").astype(bool) & (self._cleared(v) >= x)
            alive[:x], alive[x] = then[:x], then[u]
        for level in self.levels:  # later merges add an arc where the arc of their first token still was
            y = level[np.searchsorted(level, x, side="right"):]
            first = self.left[y]
            alive[y] = alive[first] & (cleared[first] > y)
        return np.packbits(alive, bitorder="little")

    def arcs(self, x: int) -> bytes:
        """The arc row of state ``x`` once all merges are in."""
        if (row := self.rows.get(x)) is None:
            if len(self.rows) >= STATES_KEPT:
                self.rows.clear()
                self.lost.clear()
            packed, gone = self._born(x), np.zeros(0, np.int64)
            if x in self.merges_of:
                gone = self.merges_of[x][0]
                gone = gone[(packed[gone >> 3] >> (gone & 7)) & 1 > 0]
                np.bitwise_and.at(packed, gone >> 3, (255 - (1 << (gone & 7))).astype(np.uint8))
            row, self.lost[x] = packed.tobytes(), gone.astype(np.int32)
            self.rows[x] = row
        return row

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the longest arc first, back where the word can't be finished."""
        sizes, n = self.sizes, len(word)
        at, path, dead, row = 0, [], set(), None
        open_arcs = [self._starting(word, 0)]
        while at < n:
            found = open_arcs[-1]
            while found:
                k = found.pop()
                if (row is None or row[k >> 3] >> (k & 7) & 1) and at + sizes[k] not in dead:
                    path.append(k)
                    at += sizes[k]
                    if at < n:
                        row = self.rows.get(k) or self.arcs(k)
                        open_arcs.append(self._starting(word, at))
                    break
            else:
                dead.add(at)
                open_arcs.pop()
                at -= sizes[path.pop()]
                row = self.arcs(path[-1]) if path else None
        return [self.ids[k] for k in path]

    def _starting(self, word: bytes, at: int) -> list[int]:
        """The tokens that start at a place of the word, shortest first."""
        known, found = self.prefixes, []
        for end in range(at + 1, len(word) + 1):
            k = known.get(word[at:end])
            if k is None:
                break
            if k >= 0:
                found.append(k)
        return found

    def _encode_plain(self, text: str) -> list[bytes]:
        """The packed ids of each pre-split word of a text without special tokens."""
        words = (_SPLIT if _OUTSIDE_LATIN.search(text) else _SPLIT_LATIN).findall(text)
        try:
            return [*map(self.words.__getitem__, words)]
        except KeyError:
            if self.kept_bytes >= KEPT_BYTES:
                self.older, self.words, self.kept_bytes = self.words, {}, 0
            kept, long = self.words, {}
            for w in set(words).difference(kept):
                packed = self.older.pop(w, None) or np.array(self.encode_word(w.encode()), np.uint32).tobytes()
                if len(w) > LONGEST_KEPT:
                    long[w] = packed
                else:
                    kept[w] = packed
                    self.kept_bytes += 200 + len(w) + len(packed)  # the objects' own sizes with it
            return [long[w] if w in long else kept[w] for w in words] if long else [*map(kept.__getitem__, words)]

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; special tokens in the text are taken as such."""
        if self.split_special is None or not self.split_special.search(text):
            return np.frombuffer(b"".join(self._encode_plain(text)), np.uint32)
        out: list[bytes] = []
        at = 0
        for m in self.split_special.finditer(text):
            out += self._encode_plain(text[at:m.start()])
            out.append(np.uint32(self.special[m[0]]).tobytes())
            at = m.end()
        out += self._encode_plain(text[at:])
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids) -> str:
        """The text of token ids: the arc labels, joined."""
        return b"".join(map(self.label_of_id.__getitem__, ids)).decode("utf-8", "replace")


def _shipped(df: DataFrame, path: str) -> Callable[[], TokenAutomaton]:
    """The automaton of a vocabulary file, compiled once per worker; the driver reads the file and sends it along."""
    with open(path, "rb") as f:
        raw = f.read()
    shared, name = df.sparkSession.sparkContext.broadcast(raw), "bpe " + digest_of(raw)  # one vocabulary file
    return lambda: held(name, lambda: TokenAutomaton(shared.value))


def _added(df: DataFrame, fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in fields), *(T.StructField(n, t) for n, t in fields.items())])


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>), the BPE tokens of ``text``, and with ``decoded`` the text that they decode to.

    Null texts count as empty and get no tokens.  Columns of the same names are replaced,
    all others pass through.  Rows never move: there is no shuffle.
    """
    fields: dict[str, T.DataType] = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    schema, automaton = _added(df, fields), _shipped(df, path)
    kept = [f.name for f in df.schema.fields if f.name not in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton()
        for batch in batches:
            texts, rest = batch.column(batch.schema.get_field_index(text)), batch.select(kept)
            for start in range(0, len(texts), 256):
                offsets, flat, back = [0], [], []
                for t in texts.slice(start, 256).to_pylist():
                    got = tokens.encode(t or "")
                    flat.append(got.astype(np.int32))
                    offsets.append(offsets[-1] + len(got))
                    if decoded:
                        back.append(tokens.decode(got.tolist()))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()))
                part = rest.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, column, *([pa.array(back, pa.string())] if decoded else [])], names=[*kept, *fields])
        tokens.older = {}

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``, what the token ids decode to; null ids give the empty text."""
    schema, automaton = _added(df, {text: T.StringType()}), _shipped(df, path)
    kept = [f.name for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton()
        for batch in batches:
            back = pa.array([tokens.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, back], names=[*kept, text])

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens and SHA-256 of the ids and of the decoded text."""
    coded = bpe_encode(df, path, decoded="decoded")
    return coded.select(
        *[c for c in df.columns if c not in ("text", "ids", "decoded")],
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
