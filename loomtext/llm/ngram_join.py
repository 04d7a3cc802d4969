"""N-gram Jaccard self-join with prefix trees, down to connected components.

A document is the set of its word n-grams; two link when ``100 * overlap >= 85 * union``.
Equal sets form a class at once.  The join then runs in two parts:

1. *Seeds.*  Keys of pairs of min-hashes bring likely partners together.  Every group
   becomes stars around one member, and runs of a star are joined in a prefix tree.  The
   links found give the first components, so large groups of near copies are settled
   with about one check for each member.
2. *Rest.*  Prefix filtering is complete: under one global order of the n-grams two
   linked sets share an n-gram among the first ``n - ceil(0.85 n) + 1`` of each.  The
   order puts n-grams that are common in the corpus (by a count sketch of fixed size)
   last and is random otherwise.  Only n-grams in prefixes of different components are
   still of interest.  The rows of such an n-gram are compared inside a task (long lists
   in pairs of parts, over several tasks), and only pairs that pass a bound by parity bit
   maps come out: bits that differ are n-grams that differ.  A group of texts that share
   much and link seldom so costs comparisons of 64 bytes and not rows.  What is left is
   checked with prefix trees too.

So each link between different components is found and none inside one is needed.  The
prefix tree stores sets as rank sequences, most common ranks first; a probe walks it
depth first, shares the overlap of common prefixes, and leaves a subtree once the ranks
missed exceed what the lengths allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, tasks_for
from .components import components

WORDS, SHARE = 4, 85
#: Seed keys for each document and min-hashes in each.
KEYS, HASHES = 6, 2
#: Counters of the sketch and bits of the filter of shared n-grams, as powers of two: both of fixed size.
SKETCH_BITS, LIVE_BITS = 24, 28
BLOCK = 1 << 16
#: Sets and n-grams in one prefix tree at most, and n-grams that a task sorts at a time.
TREE_SETS, TREE_GRAMS, SORTED = 256, 2_000_000, 1 << 19
#: Rows of one n-gram that one task compares with each other; longer lists are split into parts of this size.
LIST_ROWS = 4096
#: Rows that a task holds for comparison (about 100 bytes each) unless one list is longer, and pairs compared at a time.
HELD_ROWS, SLICE = 1 << 17, 1 << 16
#: Ids that may be broadcast (16 MB); beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SEEDS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x2F8F1D2B7A3C5E61, 0x7A5662E3A1C94B2D, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, none without words.

    Words are lower-cased in A-Z and lie between ASCII white space.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    mixed = h[:n] * _MIX[0]
    for i in range(1, words):
        mixed = mixed + h[i:n + i] * _MIX[i % len(_MIX)] * np.uint64(2 * (i // len(_MIX)) + 1)
    return np.unique(_stir(mixed))


def _signature(grams: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(grams.tobytes())


def _keys(grams: np.ndarray) -> list[int]:
    lows = [int((grams * s).min()) for s in _SEEDS[:KEYS * HASHES]]  # n-gram hashes are mixed well, the factors are odd
    return [hash((i, *lows[i * HASHES:(i + 1) * HASHES])) for i in range(KEYS)]


def _parity(grams: np.ndarray) -> bytes:
    """A bit for each remainder of the n-grams, set where an odd number has it; twice as many bits as n-grams, at least."""
    size = max(512, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parity: bytes) -> bytes:
    """A parity map folded to 512 bits, which never adds differing bits."""
    x = np.frombuffer(parity, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, 8), axis=0).tobytes()


def _differing(p: bytes, q: bytes) -> int:
    """Bits that differ between two parity maps, the longer one folded; no more than n-grams differ."""
    x, y = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def least_overlap(a: int, b: int, share: int = SHARE) -> int:
    """The overlap that two sets of these sizes need."""
    return -(-share * (a + b) // (100 + share))


def prefix_size(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1


class PrefixTree:
    """Sets in a trie, kept as sorted rank sequences with the length of the prefix shared with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        self.grams, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(self.grams), np.int64)
        rank[np.lexsort((self.grams, -counts))] = np.arange(len(self.grams))
        ends = np.cumsum([len(s) for s in sets])
        paths = [np.sort(rank[part]) for part in np.split(inverse, ends[:-1])]
        self.paths, self.longest = paths, max(map(len, paths))
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.shared = [0] * len(paths)
        for k in range(1, len(paths)):
            a, b = paths[self.order[k - 1]], paths[self.order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared[k] = int(differ[0]) if len(differ) else n

    def probe(self, at: int, share: int = SHARE, wanted=None) -> Iterator[int]:
        """The other sets that link with set ``at``; ``wanted`` may turn some away first."""
        own = self.paths[at]
        n = len(own)
        missing = np.ones(len(self.grams), np.int32)
        missing[own] = 0
        allowed = (100 * min(self.longest, 100 * n // share) - share * n) // (100 + share)
        dead, walked, sums = -1, 0, np.zeros(self.longest + 1, np.int32)  # sums[d]: ranks missed in the first d of the path
        for k, i in enumerate(self.order):
            walked = min(walked, self.shared[k])
            if 0 <= dead < self.shared[k]:
                continue  # the subtree was left above this path
            dead = -1
            if i == at or (wanted and not wanted(i)):
                continue
            path = self.paths[i]
            m = len(path)
            sums[walked + 1:m + 1] = sums[walked] + np.cumsum(missing[path[walked:]])
            walked = m
            if sums[m] > allowed:
                dead = int(np.searchsorted(sums[:m + 1], allowed, side="right")) - 1
                walked = dead + 1
            elif 100 * (both := m - int(sums[m])) >= share * (n + m - both):
                yield i


def links_in(sets: list[np.ndarray], share: int = SHARE, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets; ``joined`` names components known before."""
    top = list(range(len(sets)))
    seen: dict[int, int] = {}
    for i, c in enumerate(joined or []):
        top[i] = seen.setdefault(c, i)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    tree, out, groups = PrefixTree(sets), [], len({find(i) for i in range(len(sets))})
    for at in range(len(sets)):
        if groups == 1:
            break
        for i in tree.probe(at, share, lambda i: find(i) != find(at)):
            out.append((at, i))
            top[find(i)] = find(at)
            groups -= 1
    return out


def _prepare(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """A row for each document (row id, size, signature, seed keys) and blocks of each task's count sketch."""
    schema = "rid bigint, doc bigint, n bigint, sig string, keys array<bigint>, parity binary, digest bigint, block int, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rid, since, sketch = task << 33, 0, np.zeros(1 << SKETCH_BITS, np.uint16)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        names = ["rid", "doc", "n", "sig", "keys", "parity", "digest", "block", "sketch"]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(start, 512).to_pylist()
                out = []
                for doc, t, digest in zip(ids, *(batch.column(i).slice(start, 512).to_pylist() for i in (1, 2)), strict=True):
                    grams = gram_set(t, words)
                    if len(grams):
                        sketch[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)] += 1  # two n-grams of a text in one bucket count once
                        out.append((rid, doc, len(grams), _signature(grams), _keys(grams), _parity(grams), digest, None, None))
                    else:
                        out.append((rid, doc, 0, None, None, None, digest, None, None))
                    rid += 1
                since += len(ids)
                if since > 10_000:  # counts stay below what 16 bits hold; what is this common is common
                    np.minimum(sketch, 30_000, out=sketch)
                    since = 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for start in range(0, 1 << SKETCH_BITS, 64 * BLOCK):
            rows = []
            for block in range(start // BLOCK, min(start // BLOCK + 64, (1 << SKETCH_BITS) // BLOCK)):
                part = sketch[block * BLOCK:(block + 1) * BLOCK]
                if len(at := np.flatnonzero(part)):
                    rows.append((None, None, None, None, None, None, None, block, zlib.compress(at.astype(np.uint16).tobytes() + part[at].tobytes(), 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(key).cast("bigint"), text, F.xxhash64(text)).mapInArrow(run, schema)


def _common_buckets(prepared: DataFrame) -> bytes:
    """Bit map of the sketch buckets of common n-grams: counts well above what chance puts into a bucket.

    The tasks' blocks of one range meet in one task, which adds them up one by one.
    """
    total = prepared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    mean = total / (1 << SKETCH_BITS)
    most = mean + 4 * mean ** 0.5 + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def settle(block: int, counts: np.ndarray) -> pa.RecordBatch:
            bits = np.packbits(counts > most, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

        own, counts = None, np.zeros(BLOCK, np.uint64)
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != own and own is not None:
                    yield settle(own, counts)
                    counts[:] = 0
                own = block
                both = np.frombuffer(zlib.decompress(raw), np.uint16)
                counts[both[:len(both) // 2]] += both[len(both) // 2:]
        if own is not None:
            yield settle(own, counts)

    rows = prepared.where("block is not null").select("block", "sketch").repartition(tasks_for(prepared.sparkSession), F.col("block")).sortWithinPartitions("block")
    bits = bytearray(1 << (SKETCH_BITS - 3))
    for r in rows.mapInArrow(run, "block int, bits binary").toLocalIterator():  # 1 << SKETCH_BITS bits in all
        bits[r["block"] * BLOCK // 8:(r["block"] + 1) * BLOCK // 8] = r["bits"]
    return bytes(bits)


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _prefixes(docs: DataFrame, common: bytes, key: str, text: str, words: int, share: int) -> DataFrame:
    """Each document's signature and the first n-grams of its set in the global order."""
    held = docs.sparkSession.sparkContext.broadcast(common)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, sigs, sizes, maps, firsts = [], [], [], [], []
                for doc, t in zip(batch.column(0).slice(start, 512).to_pylist(), batch.column(1).slice(start, 512).to_pylist(), strict=True):
                    grams = gram_set(t, words)
                    if not len(grams):
                        continue
                    late = _bit(bits, (grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64))
                    first = np.concatenate((grams[~late], grams[late]))[:prefix_size(len(grams), share)]
                    ids.append(doc)
                    sigs.append(_signature(grams))
                    sizes.append(len(grams))
                    maps.append(_folded(_parity(grams)))
                    firsts.append(first.view(np.int64))
                if ids:
                    offsets = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts)))], names=["doc", "sig", "n", "map", "grams"])

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, "doc bigint, sig string, n bigint, map binary, grams array<bigint>")


def _check(edges: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, share: int) -> DataFrame:
    """The candidate pairs ``(a, b)`` that link, and links that the runs of one ``b`` have among themselves.

    Texts are read again for the classes in question only.  Rows meet sorted by ``b``; a
    run of one ``b`` shares a prefix tree of bounded size, and very long runs are split.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    needed = materialise(nodes.join(classes.select("node", "sig", "doc"), "node"), "join-needed")
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    small = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = materialise(texts.join(small, texts["doc"].eqNullSafe(small["doc"])).select("node", "sig", "text"), "join-texts")
    one = edges.join(texts.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("text").alias("text_a")), "a")
    rows = one.join(texts.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("text").alias("text_b")), "b").select("a", "sig_a", "text_a", "b", "sig_b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def settle(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = [(names[i], names[j]) for i, j in links_in(sets, share)] if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        names: list[int] = []
        sets: list[np.ndarray] = []
        top, weight = None, 0
        for batch in batches:
            a, sig_a, text_a, b, sig_b, text_b = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                own = b[i].as_py()
                if own != top or len(names) > TREE_SETS or weight > TREE_GRAMS:
                    if names:
                        yield settle(names, sets)
                    grams = gram_set(text_b[i].as_py(), words) if own != top or not names else sets[0]
                    top, names, sets, weight = own, [], [], 0
                    if _signature(grams) == sig_b[i].as_py():
                        names, sets, weight = [own], [grams], len(grams)
                if not names:
                    top = None  # a text of a repeated id that isn't the class's
                    continue
                grams = gram_set(text_a[i].as_py(), words)
                if _signature(grams) == sig_a[i].as_py():
                    names.append(a[i].as_py())
                    sets.append(grams)
                    weight += len(grams)
        if names:
            yield settle(names, sets)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _sizes_fit(a, b, share: int):
    return (100 * F.least(a, b) >= share * F.greatest(a, b))


def _seed_edges(classes: DataFrame, share: int) -> DataFrame:
    """Stars: in each group of a seed key, every class points to the class that a hash picks for that key."""
    keyed = classes.select("node", "n", F.explode("keys").alias("k"))
    picked = keyed.groupBy("k").agg(F.min(F.struct(F.xxhash64("node", "k").alias("h"), F.col("node").alias("top"), F.col("n").alias("top_n"))).alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = keyed.join(picked.select("k", "s.top", "s.top_n"), "k").where((F.col("node") != F.col("top")) & _sizes_fit(F.col("n"), F.col("top_n"), share))
    first = F.col("node") > F.col("top")
    sizes = F.when(first, F.col("n")).otherwise(F.col("top_n")).alias("n_a"), F.when(first, F.col("top_n")).otherwise(F.col("n")).alias("n_b")
    return stars.select(F.greatest("node", "top").alias("a"), F.least("node", "top").alias("b"), *sizes).distinct()


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, their own node where no link is known."""
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a batch of prefixes, the row of each and its place in the row."""
    lists = batch.column(batch.schema.get_field_index("grams"))
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shared_places(prefixes: DataFrame) -> bytes:
    """Bit map of the n-gram remainders that lie in prefixes of two components or more.

    Tasks sort their n-grams by remainder and pass on each (remainder, component) once, in
    blocks of fixed width; a block's parts meet in one task, which keeps remainders with
    different components.
    """
    mask = (1 << LIVE_BITS) - 1

    def parts(place: np.ndarray, comp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((comp, place))
        place, comp = place[order], comp[order]
        first = np.ones(len(place), bool)
        first[1:] = (place[1:] != place[:-1]) | (comp[1:] != comp[:-1])
        place, comp = place[first], comp[first]
        block = place // BLOCK
        begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[begins[1:], len(place)]
        low = (place % BLOCK).astype(np.uint16)
        rows = [(int(block[i]), low[i:j].tobytes(), comp[i:j].tobytes()) for i, j in zip(begins, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "comps"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            flat, row, _ = _flat(batch)
            held.append((flat & mask, batch.column(0).to_numpy()[row]))
            if sum(len(p) for p, _ in held) > SORTED:
                yield parts(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held and any(len(p) for p, _ in held):
            yield parts(*map(np.concatenate, zip(*held, strict=True)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def settle(block: int, places: list[bytes], comps: list[bytes]) -> pa.RecordBatch:
            place, comp = np.frombuffer(b"".join(places), np.uint16), np.frombuffer(b"".join(comps), np.int64)
            order = np.lexsort((comp, place))
            place, comp = place[order], comp[order]
            mixed = (place[1:] == place[:-1]) & (comp[1:] != comp[:-1])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.unique(place[1:][mixed]).tobytes()], pa.binary())], names=["block", "places"])

        own, places, comps = None, [], []
        for batch in batches:
            for block, p, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != own and places:
                    yield settle(own, places, comps)
                    places, comps = [], []
                own = block
                places.append(p)
                comps.append(c)
        if places:
            yield settle(own, places, comps)

    dealt = prefixes.select("comp", "grams").mapInArrow(deal, "block int, places binary, comps binary")
    found = dealt.repartition(tasks_for(prefixes.sparkSession), F.col("block")).sortWithinPartitions("block").mapInArrow(keep, "block int, places binary").where(F.octet_length("places") > 0)
    bits = np.zeros(1 << (LIVE_BITS - 3), np.uint8)
    for r in found.toLocalIterator():  # 1 << LIVE_BITS places in all
        at = r["block"] * BLOCK + np.frombuffer(bytes(r["places"]), np.uint16).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def _postings(prefixes: DataFrame) -> DataFrame:
    """``(gram, node, comp, n, pos, map)`` of the n-grams that may lie in the prefixes of two components."""
    held = prefixes.sparkSession.sparkContext.broadcast(_shared_places(prefixes))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            flat, row, pos = _flat(batch)
            kept = _bit(bits, flat & ((1 << LIVE_BITS) - 1))
            row = row[kept]
            columns = [pa.array(flat[kept]), *(pa.array(batch.column(i).to_numpy()[row]) for i in range(3)), pa.array(pos[kept]), batch.column(3).take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "node", "comp", "n", "pos", "map"])

    return prefixes.select("node", "comp", "n", "map", "grams").mapInArrow(run, "gram bigint, node bigint, comp bigint, n bigint, pos bigint, map binary")


def _pairs(postings: DataFrame, share: int, best: bool) -> DataFrame:
    """Candidate pairs ``(a, b, n_a, n_b)`` from different components that share an n-gram early enough in both prefixes.

    With ``best`` a task passes on only the closest pair of any two components, as one link joins them.

    The rows of one n-gram meet in one task; lists beyond ``LIST_ROWS`` are cut into parts
    by node, and each pair of parts meets in a task of its own.
    """
    long = materialise(postings.groupBy("gram").count().where(F.col("count") > LIST_ROWS).select("gram", F.ceil(F.col("count") / LIST_ROWS).cast("int").alias("parts")), "join-long")
    rows = postings.withColumn("part", F.lit(0))
    if not long.isEmpty():
        small = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = postings.join(small, "gram", "left").withColumn("own", own).withColumn("k", other)
        rows = rows.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.least("own", "k") * F.col("parts") + F.greatest("own", "k"))).drop("parts", "own", "k")

    def closest(pairs: np.ndarray) -> np.ndarray:
        """Distinct pairs ``(a, b, n_a, n_b, lower, upper, differ)``, with ``best`` only the closest of two components."""
        if best:
            pairs = pairs[:, np.lexsort((pairs[1], pairs[0], pairs[6], pairs[5], pairs[4]))]
            return pairs[:, np.r_[True, (pairs[4:6, 1:] != pairs[4:6, :-1]).any(0)]]
        return np.unique(pairs, axis=1)

    def compare(group, node, comp, n, pos, maps) -> Iterator[np.ndarray]:
        """Pairs of rows at a growing distance in their group, in slices of bounded size."""
        found, size, step = [], 0, 1
        at = np.arange(len(group))
        while len(at := at[at + step < len(group)]) and len(at := at[group[at] == group[at + step]]):
            for start in range(0, len(at), SLICE):
                i = at[start:start + SLICE]
                j = i + step
                both = n[i] + n[j]
                early = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
                ok = (comp[i] != comp[j]) & (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])) & ((100 + share) * early >= share * both)
                i, j, both = i[ok], j[ok], both[ok]
                differ = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64)
                near = (100 + share) * (both - differ) >= 2 * share * both
                i, j = i[near], j[near]
                if len(i):
                    first = node[i] > node[j]
                    a, b = np.where(first, i, j), np.where(first, j, i)
                    found.append(np.stack((node[a], node[b], n[a], n[b], np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), differ[near])))
                    size += len(i)
                if size > SLICE:
                    found = [closest(np.concatenate(found, axis=1))]
                    if (size := found[0].shape[1]) > SLICE // 2:
                        yield found[0]
                        found, size = [], 0
            step += 1
        if found:
            yield closest(np.concatenate(found, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows: list[np.ndarray] | None = None
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(6)]
            own.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, 8))
            rows = own if rows is None else [np.concatenate(x) for x in zip(rows, own, strict=True)]
            if len(rows[0]) > HELD_ROWS:
                last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
                if last:
                    yield from settle([x[:last] for x in rows])
                    rows = [x[last:] for x in rows]
        if rows is not None and len(rows[0]):
            yield from settle(rows)

    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, part, *rest = rows
        group = np.cumsum(np.r_[False, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
        for pairs in compare(group, *rest):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs[:4]], names=["a", "b", "n_a", "n_b"])

    dealt = rows.select("gram", "part", "node", "comp", "n", "pos", "map").repartition(tasks_for(postings.sparkSession, postings.count()), F.col("gram"), F.col("part")).sortWithinPartitions("gram", "part")
    return dealt.mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint").distinct()


def _near(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """The pairs whose parity maps differ in no more bits than linked sets of these sizes differ in n-grams."""
    maps = classes.select("node", "parity")
    both = pairs.join(maps.select(F.col("node").alias("a"), F.col("parity").alias("p")), "a").join(maps.select(F.col("node").alias("b"), F.col("parity").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n = np.array(batch.column(2)) + np.array(batch.column(3))
            differ = np.array([_differing(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + share) * (n - differ) >= 2 * share * n))

    return both.select("a", "b", "n_a", "n_b", "p", "q").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row: the size of its set and the smallest key linked with it.

    Keys are integers or texts of integers.  Null and blank texts have the empty set and
    are alone; so is a null key without links, with a null component.  Repeated rows are
    links of each other like any equal texts, and an empty table gives no rows.  Other
    columns are not read, whatever their names.
    """
    return joined_rows(docs, key, text, words, share).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def joined_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``(doc, digest, n_shingles, component_id, first)`` for each row.

    ``digest`` is ``xxhash64`` of the text, so that a row can be told from others of its
    key; ``first`` holds for one row of each component: of the rows with the smallest key
    the one with the smallest digest (rows without words are each the first of their own).
    """
    prepared = materialise(_prepare(docs, key, text, words), "join-rows")
    rows = prepared.where("block is null").select("rid", "doc", "n", "sig", "keys", "parity", "digest")
    first_row = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest", "rid")).alias("first")
    grouped = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct("rid", "doc")).alias("top"), first_row, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity"))
    classes = materialise(grouped.select("sig", F.col("top.rid").alias("node"), F.col("top.doc").alias("doc"), "first", "n", "keys", "parity"), "join-classes")
    check = lambda pairs: _check(pairs, classes, docs, key, text, words, share)

    links = materialise(check(materialise(_near(_seed_edges(classes, share), classes, share), "join-seeds")), "join-links")
    comps = components(links)

    first = _prefixes(docs, _common_buckets(prepared), key, text, words, share)
    own = classes.select(F.col("sig").alias("of"), "node", F.col("doc").alias("top"))
    first = first.join(own, (F.col("sig") == F.col("of")) & F.col("doc").eqNullSafe(F.col("top"))).select("node", "n", "map", "grams")
    postings = materialise(_postings(materialise(_labelled(first, comps), "join-prefixes")), "join-postings")
    for best in (True, False):  # first what may join two components with one check, then every pair that is left
        found = materialise(check(materialise(_near(_pairs(postings, share, best), classes, share), "join-pairs")), "join-links")
        if not found.isEmpty():
            links = links.union(found)
            comps = components(links)
            postings = materialise(_labelled(postings.drop("comp"), comps), "join-postings") if best else postings
    named = _labelled(classes.select("sig", "node", "first"), comps)
    smallest = named.groupBy("comp").agg(F.min("first").alias("least"))
    final = named.join(smallest, "comp").select("sig", F.col("least.doc").alias("component_id"), F.col("least.rid").alias("_rid"))
    lone = F.col("sig").isNull()
    return rows.select("rid", "doc", F.col("n").alias("n_shingles"), "sig", "digest").join(final, "sig", "left").select(
        "doc", "digest", "n_shingles", F.when(lone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), (lone | F.col("_rid").eqNullSafe(F.col("rid"))).alias("first")
    )
