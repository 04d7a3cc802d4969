"""LM scoring with Brown class-based bigrams.

P(word | previous) = P(class | previous class) * P(word | class).  Every training word has
a class.  Exchange clustering moves the ``CLUSTERED`` most frequent words, the start set,
between classes until no move raises the likelihood of the class bigrams.  Every other
word then joins the class that the same criterion prefers, given the classes of all its
left and right neighbours in the start set; a task adds up the neighbours of its words,
and the parts of one word meet sorted, so they are summed one after the other.  The same
sums, by class, are the transitions between the start set and all other words, so only
transitions between two words beyond the start set are left to count.  The end of a text
has its own class, and so have words that training never saw.

A bounded list of the most frequent words goes to every worker; tokens beyond it meet
their counts and classes in joins, in training and in scoring, so nothing that grows with
the corpus is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields_of, materialise, release, tasks_for

#: Bounds: words listed on every worker, words in the exchange, classes, words a task counts before it passes them on.
LISTED, CLUSTERED, CLASSES, HELD = 200_000, 1024, 32, 200_000
#: Added to every class transition.
ADDED = 0.5
_CELL = np.dtype([("code", "u1"), ("n", "<u4")])


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; the end is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold 2 MB or ``rows``, as one of few rows costs about as much as one of many."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
        if sum(b.num_rows for b in parts) >= rows or sum(b.nbytes for b in parts) >= 2 << 20:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
            parts = []
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of all texts in a row, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)  # white space at an edge leaves an empty word there
    return words.filter(some), np.bincount(text.filter(some).to_numpy(), minlength=len(texts))


def listing_of(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def numbered(words: pa.Array, listed: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each word is listed; words beyond the list are numbered after it, in the order of the second result."""
    place = pc.index_in(words, listed)
    beyond = place.is_null()
    further = words.filter(beyond).dictionary_encode()
    out = place.fill_null(-1).to_numpy().astype(np.int64)
    out[beyond.to_numpy(zero_copy_only=False)] = len(listed) + further.indices.to_numpy()
    return out, further.dictionary


def lined(numbers: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The numbers of texts of these sizes in a row, with ``end`` before, between and after them."""
    line = np.full(len(numbers) + len(sizes) + 1, end, np.int64)
    line[np.arange(1, len(numbers) + 1) + np.repeat(np.arange(len(sizes)), sizes)] = numbers
    return line


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all rows; the end of a text is the empty word.  Tasks count before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        def passed() -> Iterator[pa.RecordBatch]:
            yield from parts[0].to_batches(20_000)
            parts.clear()

        for batch in blocks(batches):
            found = split_texts(batch.column(0))[0].value_counts()
            parts.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            parts.append(pa.table({"word": [""], "n": [batch.num_rows]}))
            if sum(map(len, parts)) > 4 * HELD:
                parts[:] = [merged()]
                if len(parts[0]) > 2 * HELD:
                    yield from passed()
        if parts:
            parts[:] = [merged()]
            yield from passed()
        release()

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Listing:
    """The most frequent words by falling count, and whether a row ``(word, n)`` is on the list."""

    words: list[bytes]
    counts: np.ndarray
    holds: Column


def listed_words(counts: DataFrame, most: int = LISTED) -> Listing:
    """The words of the highest counts, about ``most`` at most.

    The cut lies between quarter powers of two of the count, found from a histogram of at
    most a few hundred rows.  Of the words at the cut those with the lowest hashes fill
    nine tenths of what is left, so the list is never much shorter than it may be.
    """
    step, place = F.floor(4 * F.log2("n")).cast("int"), F.xxhash64("word")
    sizes = sorted(((r["k"], r["count"]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True)
    holds, total = F.lit(False), 0
    for k, size in sizes:
        if total + size > most:
            holds = holds | (step == k) & (place <= ((9 * (most - total) // 10) << 64) // size - (1 << 63))
            break
        holds, total = step >= k, total + size
    found = counts.where(holds).select("word", "n").toArrow()
    words, n = [w.encode() for w in found.column("word").to_pylist()], found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return Listing([words[i] for i in order], n[order], holds)


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(between: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, from the bigrams of classes."""
    return float(_f(between).sum() - _f(between.sum(0)).sum() - _f(between.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, list[float]]:
    """Exchange clustering of words from their matrix of bigram counts, until no word moves.

    The last row and column are those of the end, which stays in a class of its own.  A
    move has to raise the likelihood by more than rounding does; ties keep the lower class.
    Returns the class of every word and the likelihood after each sweep.
    """
    m = len(pairs) - 1
    n = pairs.astype(np.float64)
    of = np.append(np.arange(m) % classes, classes)
    one = np.zeros((m + 1, classes + 1))
    one[np.arange(m + 1), of] = 1
    c, right, left = one.T @ n @ one, n @ one, n.T @ one
    least, reached = 1e-12 * max(1.0, float(_f(n.sum()))), [likelihood(c)]
    moved = True
    while moved:
        moved = False
        for w in range(m):
            a, own = of[w], n[w, w]
            r, q = right[w].copy(), left[w].copy()
            r[a] -= own
            q[a] -= own
            if not (r.any() or q.any() or own):
                continue
            c[a, :] -= r
            c[:, a] -= q
            c[a, a] -= own
            rows, cols, diagonal = c.sum(1) + q, c.sum(0) + r, np.diag(c)
            gain = (_f(c + r) - _f(c)).sum(1) + (_f(c + q[:, None]) - _f(c)).sum(0)
            gain += _f(diagonal + r + q + own) + _f(diagonal) - _f(diagonal + r) - _f(diagonal + q)
            gain -= _f(rows + r.sum() + own) - _f(rows) + _f(cols + q.sum() + own) - _f(cols)
            b = int(np.argmax(gain[:classes]))
            b = b if gain[b] > gain[a] + least else int(a)
            c[b, :] += r
            c[:, b] += q
            c[b, b] += own
            if b != a:
                moved = True
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w, :]
                left[:, b] += n[w, :]
        reached.append(likelihood(c))
    return of[:m], reached


def _summed_codes(docs: DataFrame, text: str, words, size: int, code: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each integer code below ``size`` occurs over all texts: added up in each task, then by code.

    The codes come from the places in ``words`` of the words of many texts in a row; -1 is a
    word beyond them, their number the end before, between and after the texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        listed = listing_of(words.value)
        sums = np.zeros(size, np.int64)
        for batch in blocks(batches):
            own, sizes = split_texts(batch.column(0))
            place = pc.index_in(own, listed).fill_null(-1).to_numpy()
            sums += np.bincount(code(lined(place, sizes, len(listed))), minlength=size)
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[codes])], names=["code", "n"])
        release()

    found = docs.select(text).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # ``size`` rows at most
    out = np.zeros(size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def best_classes(between: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each word the class that the exchange criterion prefers, all else staying; ties keep the lower class.

    ``between`` counts the bigrams of the start set's classes and, last, the end; ``left``
    and ``right`` a word's neighbours by class.  Only neighbours that a word has cost time.
    """
    classes = len(between) - 1
    base = between.astype(np.float64)
    known = _f(base)
    gain = np.zeros((len(left), classes))
    for cells, table, of in ((right, base[:classes], known[:classes]), (left, base[:, :classes].T, known[:, :classes].T)):
        word, kind = np.nonzero(cells)
        for start in range(0, len(word), 1 << 15):
            w, j = word[start:start + (1 << 15)], kind[start:start + (1 << 15)]
            if len(w):
                one = _f(table[:, j].T + cells[w, j][:, None]) - of[:, j].T
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                gain[w[first]] += np.add.reduceat(one, first)
    q, r, d = left[:, :classes], right[:, :classes], np.diag(base)[:classes]
    both = np.nonzero((q > 0) & (r > 0))
    x, y, z = d[both[1]], r[both], q[both]
    gain[both] += _f(x + y + z) + _f(x) - _f(x + y) - _f(x + z)
    rows, cols = base.sum(1)[:classes] + q, base.sum(0)[:classes] + r
    gain -= _f(rows + right.sum(1, keepdims=True)) - _f(rows) + _f(cols + left.sum(1, keepdims=True)) - _f(cols)
    return gain.argmax(1)


def neighbour_cells(docs: DataFrame, text: str, words, of: np.ndarray, classes: int) -> DataFrame:
    """``(word, cells)``: for words beyond the start set how often each class stands left and right of them.

    ``of`` are the classes of the start set, the first of the listed ``words``.  A task adds
    up the other listed words in one table, which it passes on at its end.  Words beyond the
    list are numbered as they are met, and passed on when the task holds twice ``HELD`` of
    them or four times as many pairs of number and code.  A code is the class on the left, or
    the class on the right plus ``classes + 2``; the end is a class, and a left neighbour
    beyond the start set has a code too, so a word's left cells add up to its count.
    """
    kinds, m = classes + 2, len(of)
    width = 2 * kinds

    def rows(codes: np.ndarray, n: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        """Rising codes, which tell places in ``names`` too, and how often each occurs."""
        word, cells = codes // width, np.empty(len(codes), _CELL)
        cells["code"], cells["n"] = codes % width, n
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        offsets = (np.append(first, len(codes)) * _CELL.itemsize).astype(np.int32)
        data = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])
        return pa.RecordBatch.from_arrays([names.take(pa.array(word[first])), data], names=["word", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, end = listing_of([*words.value, b""]), len(words.value)
        near = np.full(end + 2, classes + 1)  # class of the start set, of the end; all others are alike
        near[:m], near[end] = of, classes
        listed = np.zeros((end - m) * width, np.int32)
        codes, n, names, size, met = [], [], [], 0, 0

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal size, met
            own, joined = np.concatenate(codes), pa.concat_arrays(names).dictionary_encode()
            own, at = np.unique(joined.indices.to_numpy()[own // width] * np.int64(width) + own % width, return_inverse=True)
            sums = np.bincount(at, np.concatenate(n), len(own)).astype(np.int64)
            cuts = np.searchsorted(own, np.arange(0, len(joined.dictionary) + 20_000, 20_000) * width)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    yield rows(own[a:b], sums[a:b], joined.dictionary)
            for x in (codes, n, names):
                x.clear()
            size = met = 0

        for batch in blocks(batches):
            own, sizes = split_texts(batch.column(0))
            own, further = numbered(own, known)
            line = lined(own, sizes, end)
            kind = near[np.minimum(line, end + 1)]
            beyond = kind > classes
            last = beyond[:-1] & ~beyond[1:]
            x = np.concatenate((line[1:][beyond[1:]] * width + kind[:-1][beyond[1:]], line[:-1][last] * width + kinds + kind[1:][last]))
            far = x >= end * width
            np.add.at(listed, x[~far] - m * width, np.int32(1))
            own, k = np.unique(x[far] - (end + 1 - met) * width, return_counts=True)
            codes.append(own)
            n.append(k)
            names.append(further)
            size, met = size + len(own), met + len(further)
            if size > 4 * HELD or met > 2 * HELD:
                yield from passed()
        if size:
            yield from passed()
        for a in range(m, end, 20_000):
            part = listed[(a - m) * width:(a - m + 20_000) * width]
            own = np.flatnonzero(part)
            if len(own):
                yield rows(own, part[own], pa.array([w.decode("utf-8", "replace") for w in words.value[a:a + 20_000]], pa.string()))
        release()

    return docs.select(text).mapInArrow(run, "word string, cells binary")


def assigned(cells: DataFrame, between: np.ndarray) -> DataFrame:
    """``(word, n, class, code)`` of the words in ``neighbour_cells``; the parts of a word come one after the other.

    Rows with a code, and no word, say how often the words of the class that a task met have
    the neighbour of this code; the others are the words, each once.
    """
    kinds = len(between) + 1
    width = 2 * kinds
    left = [*range(kinds - 1)]
    mixed = np.random.default_rng(0).integers(1, 1 << 62, width) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: dict[bytes, int] = {}  # HELD / 8 vectors at most
        met = np.zeros((kinds - 2, width), np.int64)

        def settled(words: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            # most words are rare and have their neighbours' classes in common with others
            whole = np.ascontiguousarray(sums.astype(np.int64))
            _, at, same = np.unique(whole @ mixed, return_index=True, return_inverse=True)
            if not np.array_equal(whole[at[same]], whole):  # two vectors of one key
                at = same = np.arange(len(whole))
            keys = [x.tobytes() for x in whole[at]]
            if len(decided) > HELD // 8:
                decided.clear()
            new = [k for k, key in enumerate(keys) if key not in decided]
            found = best_classes(between, sums[at[new]][:, left], sums[at[new], kinds:width - 1])
            decided.update(zip((keys[k] for k in new), found.tolist(), strict=True))
            own = np.array([decided[key] for key in keys], np.int64)[same]
            np.add.at(met, own, whole)
            return pa.RecordBatch.from_arrays([words, pa.array(whole[:, :kinds].sum(1)), pa.array(own.astype(np.int32)), pa.nulls(len(words), pa.int32())], names=["word", "n", "class", "code"])

        last, open_sums = None, np.zeros(width)
        for part in blocks(batches, 16_384):
            words, raw = part.column(0), part.column(1)
            first = np.r_[True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]
            run_of, offsets = np.cumsum(first) - 1, np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
            found = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(_CELL)
            at = np.repeat(run_of, np.diff(offsets) // _CELL.itemsize)
            sums = np.bincount(at * width + found["code"], found["n"], (run_of[-1] + 1) * width).reshape(-1, width)
            names = words.filter(pa.array(first))
            if last is not None and last[0] == names[0]:
                sums[0] += open_sums
            elif last is not None:
                yield settled(last, open_sums[None])
            if len(names) > 1:
                yield settled(names[:-1], sums[:-1])
            last, open_sums = names[-1:], sums[-1].copy()
        if last is not None:
            yield settled(last, open_sums[None])
        own, code = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), pa.array(met[own, code]), pa.array(own.astype(np.int32)), pa.array(code.astype(np.int32))], names=["word", "n", "class", "code"])

    met = cells.repartition(tasks_for(cells.sparkSession, cells.count()), "word").sortWithinPartitions("word")
    return met.mapInArrow(run, "word string, n bigint, class int, code int")


def far_moves(docs: DataFrame, text: str, words, of, start: int, classes: int) -> DataFrame:
    """``(a, ka, b, kb, n)``: how often two tokens beyond the ``start`` first words follow each other.

    ``a`` and ``b`` are words beyond the list; where null, the kind beside it tells the class
    of a listed word.  Tasks count, and pass on what they hold as ``neighbour_cells`` does;
    between listed words only classes matter, so those are counted to the end.
    """
    kinds = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, size = listing_of([*words.value, b""]), len(words.value)
        kind_of = np.append(of.value[:size], [-1, 0])  # -1: the start set and the end
        kind_of[:start] = -1
        listed = np.zeros(kinds ** 2, np.int64)
        codes, n, names, held, met = [], [], [], 0, 0

        def rows(a: pa.Array, ka: np.ndarray, b: pa.Array, kb: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([a, pa.array(ka.astype(np.int32)), b, pa.array(kb.astype(np.int32)), pa.array(k)], names=["a", "ka", "b", "kb", "n"])

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal held, met
            joined, own = pa.concat_arrays(names).dictionary_encode(), np.concatenate(codes)
            number = np.append(np.arange(kinds), joined.indices.to_numpy() + kinds)
            own, at = np.unique(number[own >> 32] << 32 | number[own & 0xFFFFFFFF], return_inverse=True)
            sums = np.bincount(at, np.concatenate(n), len(own)).astype(np.int64)
            for k in range(0, len(own), 20_000):
                a, b = own[k:k + 20_000] >> 32, own[k:k + 20_000] & 0xFFFFFFFF
                named = (joined.dictionary.take(pa.array(np.maximum(x - kinds, 0), mask=x < kinds)) for x in (a, b))
                yield rows(next(named), np.minimum(a, kinds - 1), next(named), np.minimum(b, kinds - 1), sums[k:k + 20_000])
            for x in (codes, n, names):
                x.clear()
            held = met = 0

        for batch in blocks(batches):
            own, sizes = split_texts(batch.column(0))
            own, further = numbered(own, known)
            line = lined(own, sizes, size)
            line = np.where(line > size, line - (size + 1 - kinds - met), kind_of[np.minimum(line, size + 1)])
            ok = (line[:-1] >= 0) & (line[1:] >= 0)
            a, b = line[:-1][ok], line[1:][ok]
            far = np.maximum(a, b) >= kinds
            listed += np.bincount(a[~far] * kinds + b[~far], minlength=kinds ** 2)
            own, k = np.unique(a[far] << 32 | b[far], return_counts=True)
            codes.append(own)
            n.append(k)
            names.append(further)
            held, met = held + len(own), met + len(further)
            if held > 4 * HELD or met > 2 * HELD:
                yield from passed()
        if held:
            yield from passed()
        own = np.flatnonzero(listed)
        yield rows(pa.nulls(len(own), pa.string()), own // kinds, pa.nulls(len(own), pa.string()), own % kinds, listed[own])
        release()

    return docs.select(text).mapInArrow(run, "a string, ka int, b string, kb int, n bigint")


def moves_beyond(far: DataFrame, beyond: DataFrame, kinds: int) -> np.ndarray:
    """The transitions of ``far_moves`` by kind, where each word meets its class."""
    out = np.zeros((kinds, kinds))
    known = beyond.select("word", "class")
    left, right = F.col("a").isNull(), F.col("b").isNull()
    for r in far.where(left & right).groupBy("ka", "kb").agg(F.sum("n").alias("n")).collect():  # kinds ** 2 rows at most
        out[r["ka"], r["kb"]] += r["n"]
    sided = far.where(left != right).select(F.coalesce("a", "b").alias("word"), left.alias("left"), F.when(left, F.col("ka")).otherwise(F.col("kb")).alias("kind"), "n")
    for r in sided.join(known, "word").groupBy("left", "kind", "class").agg(F.sum("n").alias("n")).collect():  # 2 * kinds ** 2 rows at most
        out[(r["kind"], r["class"]) if r["left"] else (r["class"], r["kind"])] += r["n"]
    both = far.where(~left & ~right).join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b")
    for r in both.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
        out[r["ca"], r["cb"]] += r["n"]
    return out


@dataclass
class Model:
    """What a worker needs: listed words with counts and classes, and the two distributions in log10."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    transitions: np.ndarray
    room: np.ndarray
    end_count: int
    total: int
    distinct: int
    #: Likelihood of the start set's classes, before the first sweep and after each.
    reached: list[float]
    #: ``(word, n, class)`` of all training words beyond the list; no worker gets it whole.
    beyond: DataFrame | None = None

    @property
    def end(self) -> int:
        return len(self.room) - 2

    @property
    def rare(self) -> int:
        return len(self.room) - 1


def train(docs: DataFrame, counts: DataFrame, text: str = "text", listed: int = LISTED, clustered: int = CLUSTERED, classes: int = CLASSES, whole: bool = False) -> Model:
    """Classes and distributions from the training texts and their materialised word counts.

    Kinds are the classes, the end and, last, words that training never saw.  With
    ``whole``, transitions are counted between all training words: those with the start set
    come with the classes, those of words beyond the list meet their classes in joins, so
    the list's length decides where work is done and no score.  Else they are counted between listed words, and words beyond the list
    stand for words that training never saw.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    total, distinct, end_count = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    listing = listed_words(counts.where(F.col("word") != ""), listed)
    words, m, kinds = listing.words, min(clustered, len(listing.words)), classes + 2
    start, shared = sc.broadcast(words[:m]), sc.broadcast(words)  # CLUSTERED words at most, LISTED words at most

    def near(line: np.ndarray) -> np.ndarray:
        a, b = line[:-1], line[1:]
        ok = (a >= 0) & (b >= 0)
        return a[ok] * (m + 1) + b[ok]

    pairs = _summed_codes(docs, text, start, (m + 1) ** 2, near).reshape(m + 1, m + 1)
    first, reached = exchange(pairs, classes)
    one = np.zeros((m + 1, classes + 1))
    one[np.arange(m + 1), np.append(first, classes)] = 1
    between = one.T @ pairs @ one
    cells = materialise(neighbour_cells(docs, text, shared, first, classes), "lm-cells")
    found = materialise(assigned(cells, between), "lm-classes")
    others = found.where("code is null").drop("code")
    got = others.where(listing.holds).select("word", "class").toArrow()  # LISTED words at most
    place = {w: i for i, w in enumerate(words)}
    of = np.append(first, np.zeros(len(words) - m, np.int64))
    of[[place[w.encode()] for w in got.column("word").to_pylist()]] = got.column("class").to_numpy()
    all_of = sc.broadcast(np.append(of, [classes, classes + 1]))  # LISTED words at most

    def moves_of(line: np.ndarray) -> np.ndarray:
        line = all_of.value[line]  # -1, a word beyond the list, is the last
        return line[:-1] * kinds + line[1:]

    beyond = others.where(~listing.holds)
    if whole:
        moves = np.full((kinds, kinds), ADDED)
        moves[:-1, :-1] += between
        for r in found.where("code is not null").groupBy("class", "code").agg(F.sum("n").alias("n")).collect():  # 2 * kinds ** 2 rows at most
            side, kind = divmod(r["code"], kinds)
            if kind <= classes:
                moves[(r["class"], kind) if side else (kind, r["class"])] += r["n"]
        if distinct - (end_count > 0) > m:
            moves += moves_beyond(materialise(far_moves(docs, text, shared, all_of, m, classes), "lm-far"), beyond, kinds)
    else:
        moves = _summed_codes(docs, text, shared, kinds ** 2, moves_of).reshape(kinds, kinds) + ADDED
    sizes = np.zeros((2, kinds))
    np.add.at(sizes[0], first, listing.counts[:m])
    np.add.at(sizes[1], first, 1)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        sizes[:, r["class"]] += r["n"], r["k"]
    sizes[:, classes] = end_count, min(end_count, 1)
    if not whole:
        sizes[:, classes + 1] = beyond.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return Model(words, listing.counts, of, np.log10(moves / moves.sum(1, keepdims=True)), np.log10(sizes.sum(0) + 1), int(end_count), int(total), int(distinct), reached, beyond)


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    ``score`` is the log10 probability of the text with its end under the class model,
    ``base_score`` under add-one unigrams.  A null or blank text is its end alone.  Very
    long texts are scored whole.  Each row is scored on its own; repeated rows stay, and
    columns named like an added one are replaced.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    kept = [c for c in docs.columns if c not in (*added, text)]
    held = docs.sparkSession.sparkContext.broadcast(replace(model, beyond=None))  # LISTED words at most
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields), "_row bigint, _n bigint, _known bigint, _logs double, _rest double, _rare array<string>, _far array<int>, _pairs array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        row, model = TaskContext.get().partitionId() << 40, held.value
        known_words, listed = listing_of(model.words), len(model.words)
        logs, of, kinds = np.log10(model.counts + 1.0), model.classes, len(model.room)
        end_log = np.log10(model.end_count + 1.0)

        def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)

        for batch in blocks(batches):
            own, sizes = split_texts(batch.column(batch.schema.get_field_index(text)))
            ids, further = numbered(own, known_words)
            count, far = len(sizes), ids >= listed
            doc = np.repeat(np.arange(count), sizes)
            near_doc, far_doc = doc[~far], doc[far]
            # words beyond the list are numbered from ``kinds`` on, anew in each text
            most = max(1, len(further))
            own, local = np.unique(far_doc * most + ids[far] - listed, return_inverse=True)
            rare = np.bincount(own // most, minlength=count)
            local -= (np.cumsum(rare) - rare)[far_doc]
            line = ids.copy()
            line[~far], line[far] = of[ids[~far]], kinds + local
            line = lined(line, sizes, model.end)
            a, b, of_pair = line[:-1], line[1:], np.repeat(np.arange(count), sizes + 1)
            known = b < kinds
            ok = (a < kinds) & known
            inner = np.bincount(of_pair[ok], model.transitions[a[ok], b[ok]], count) - np.bincount(of_pair[known], model.room[b[known]], count)
            out = [
                pa.array(np.arange(row, row + count)), pa.array(sizes + 1), pa.array(np.bincount(near_doc, minlength=count) + (model.end_count > 0)),
                pa.array(np.bincount(near_doc, logs[ids[~far]], count) + end_log), pa.array(inner),
                lists(further.take(pa.array(own % most)), rare), lists(pa.array(local.astype(np.int32)), np.bincount(far_doc, minlength=count)),
                lists(pa.array(np.stack((a[~ok], b[~ok]), 1).ravel().astype(np.int32)), 2 * np.bincount(of_pair[~ok], minlength=count)),
            ]
            row += count
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *out], names=[*kept, "_row", "_n", "_known", "_logs", "_rest", "_rare", "_far", "_pairs"])

    first = materialise(docs.select(*kept, text).mapInArrow(run, schema), "lm-first")
    met = first.select("_row", F.posexplode("_rare").alias("k", "word")).join(model.beyond, "word")
    known = met.groupBy("_row").agg(F.collect_list(F.struct("k", "n", "class")).alias("_met"))
    rows = first.withColumn("_size", F.size("_rare")).drop("_rare").join(known, "_row", "left").withColumn("_met", F.coalesce("_met", F.expr("array()")))
    final = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields), "_n bigint, _known bigint, _logs double, _score double"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = held.value
        kinds = len(model.room)
        for batch in batches:
            out = []
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("_n", "_known", "_logs", "_rest", "_far", "_pairs", "_size", "_met")}
            n, known, logs, rest, size = (column[c].to_pylist() for c in ("_n", "_known", "_logs", "_rest", "_size"))
            for i in range(batch.num_rows):
                if not size[i]:
                    out.append((n[i], known[i], logs[i], logs[i] + rest[i]))
                    continue
                far, pairs, cells = column["_far"][i].values.to_numpy(), column["_pairs"][i].values.to_numpy(), column["_met"][i].values
                k = cells.field(0).to_numpy()
                count, of = np.zeros(size[i]), np.concatenate((np.arange(kinds), np.full(size[i], model.rare)))
                count[k], of[kinds + k] = cells.field(1).to_numpy(), cells.field(2).to_numpy()
                base = logs[i] + np.log10(count[far] + 1).sum()
                pairs = of[pairs].reshape(-1, 2)
                inner = rest[i] + model.transitions[pairs[:, 0], pairs[:, 1]].sum() - model.room[of[kinds + far]].sum()
                out.append((n[i], known[i] + int((count[far] > 0).sum()), base, base + inner))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=[*kept, "_n", "_known", "_logs", "_score"])

    rows = rows.select(*kept, "_n", "_known", "_logs", "_rest", "_far", "_pairs", "_size", F.col("_met").cast("array<struct<k:int,n:bigint,class:int>>").alias("_met")).mapInArrow(finish, final)
    return rows.select(
        *kept, F.col("_n").alias("n_tokens"), F.col("_known").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("_logs") - F.col("_n") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"), F.col("_score").alias("score"), F.pow(F.lit(10.0), -F.col("_score") / F.col("_n")).alias("perplexity"),
    )


def score_corpus(docs: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """Learns from the training rows and scores all documents."""
    counts = materialise(count_words(training, text), "lm-counts")
    return score_texts(docs, train(training, counts, text, whole=True), text)
