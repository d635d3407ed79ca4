"""Similarity self-join on word shingles by vertical partitioning of a global shingle order.

1. Shingles are ordered globally by frequency class (from counts over all documents, sixteen classes to a doubling), then
   by hash. A shingle's key holds both, so that sorting keys is sorting by the global order.
2. Rows with equal shingle sets form one node. Two nodes can only reach the threshold if their prefixes (the rarest
   shingles, about a fifth of a set) share a key.
3. The order is cut at fixed pivots. A set's keys between two pivots are its segment of that fragment, a row of its own.
   Each fragment counts the overlaps of its candidate pairs apart, one row per pair and fragment, and these partial
   counts are summed per pair.
   Prefix keys meet once, packed: each task sends its sorted keys as differences to owners of ranges of the hash space, which
   return the keys of several sets. Sets of a key that their sizes and places keep apart from all others end there.
4. Nodes that share a prefix key are first paired along chains. Only nodes that are then still in different components
   are paired in full, so a group of g near copies costs about g pairs, and every link between components is tested.
   A key of two nodes has one pair only, which the first chain makes.
5. A key that many nodes share is cut up: chains run within blocks of its nodes (other blocks in another turn), and the
   pairs across components are made by blocks of both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .workspace import Workspace, fits, give_back, row_key, small_batches, unused, without_rows

WORDS, PERCENT = 5, 80
#: Cells of the frequency sketch: 2**CELL_BITS counters, whatever the corpus.
CELL_BITS = 22
#: Nodes of one key in one block of a chain, and pairs of nodes of one key that one block tests.
CHAIN_NODES, BLOCK_PAIRS = 5_000, 4_000_000
#: Prefix keys that a task packs at once, and about how many an owner holds of one range of the hash space.
CHUNK_KEYS, RANGE_KEYS = 500_000, 200_000
#: The top bits of a key hold the frequency class.
_CLASS_BITS = 8
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _rest() -> None:
    _words.clear()
    give_back()


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's word n-grams, in order of occurrence, repeats included."""
    if len(_words) > 150_000:
        _words.clear()
    # bytes.lower() and bytes.split() touch A-Z and [\x20\x09-\x0D] only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ ids[i : n - k + 1 + i]) * _P
            h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Distinct keys in the global order."""
    return np.unique((classes[_cells(h)].astype(np.uint64) << np.uint64(64 - _CLASS_BITS)) | (h >> np.uint64(_CLASS_BITS)))


def prefix_size(n: int) -> int:
    """A pair above the threshold shares a key among this many of either set's first."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def frequency_classes(texts: DataFrame, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequency class of every cell of the hash space, and the pivots that cut the order into fragments of about
    equal mass.

    All shingles of all documents are counted. Tasks send one compressed sketch each; they are added level by level, and the
    last task, which gets eight sketches of fixed size, sends the driver the classes, a byte for each cell. A class is a
    sixteenth of a doubling above or below the usual cell: shingles that even a few dozen documents share come after those
    of one document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, _cells(shingles(t)), 1)
        yield _blob(total)
        _rest()

    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += _unblob(x)
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _blob(added(batches))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, mass = _classes(added(batches))
        cuts = np.minimum(np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments) + 1, 255)
        yield pa.RecordBatch.from_arrays([pa.array([classes.tobytes()], pa.binary()), pa.array([cuts.tolist()], pa.list_(pa.int64()))], names=["classes", "cuts"])
        give_back()

    sketches = texts.mapInArrow(count, "sketch binary")
    many = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    for tasks in (many, 8) if many > 8 else (8,):
        sketches = sketches.repartition(tasks).mapInArrow(add, "sketch binary")
    found = sketches.repartition(1).mapInArrow(rank, "classes binary, cuts array<long>").first()
    return np.frombuffer(found["classes"], np.uint8), np.array(found["cuts"], np.uint64) << np.uint64(64 - _CLASS_BITS)


def _classes(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells' classes from their counts, and the mass of all classes up to each one."""
    base = float(np.median(total)) + 1
    classes = np.clip(np.round(64 + 16 * np.log2((total + 1) / base)), 0, 255).astype(np.uint8)
    return classes, np.cumsum(np.bincount(classes, total, minlength=256))


def _blob(total: np.ndarray) -> pa.RecordBatch:
    small = total.astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")
    return pa.RecordBatch.from_arrays([pa.array([bytes([small.itemsize]) + zstandard.compress(small.tobytes(), 1)], pa.binary())], names=["sketch"])


def _unblob(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def _signature(keys: np.ndarray) -> str | None:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).hexdigest() if len(keys) else None


def _parity(keys: np.ndarray) -> np.ndarray:
    """For each of 512 parts of the hash space, whether an odd number of a set's keys fall into it, as eight words."""
    odd = np.bincount((keys & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(classes) -> object:
    schema = pa.schema([("n", pa.int64()), ("sig", pa.string()), ("prefix", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # copies that this task has met before need no prefix again
        for batch in batches:
            n, sig, prefix, parity = [], [], [], []
            if len(seen) > 100_000:
                seen.clear()
            for t in batch.column(1).to_pylist():
                keys = ordered(shingles(t), classes.value)
                s = _signature(keys)
                n.append(len(keys))
                sig.append(s)
                prefix.append(None if s is None or s in seen else keys[: prefix_size(len(keys))].astype(np.int64))
                parity.append(None if s is None else _parity(keys))
                seen.add(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip((n, sig, prefix, parity), schema, strict=True)]], names=["row", *schema.names])
        _rest()

    return run


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers byte by byte, so that the bytes that are alike stand together."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), 1)


def _unpack(blob: bytes, size: int, *types: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.decompress(blob), np.uint8), [], 0
    for t in map(np.dtype, types):
        out.append(np.ascontiguousarray(raw[at : at + size * t.itemsize].reshape(t.itemsize, size).T).view(t).ravel())
        at += size * t.itemsize
    return out


_PACKED = ("<u8", "<i8", "<u4", "<u4")  # differences of the keys, the sets' marks and sizes, the keys' places


def _packs(bits: int) -> object:
    """(mark, n, prefix) rows to packed keys, one row per chunk and range of the hash space. A key goes without its class,
    which follows from its hash."""

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, mark, n, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key)
        key, mark, n, pos = key[order], mark[order], n[order], pos[order]
        place = (key >> np.uint64(64 - _CLASS_BITS - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        sizes = np.diff(cuts)
        blobs = [_pack(np.diff(key[a:b], prepend=np.uint64(0)), mark[a:b], n[a:b], pos[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        for a in range(0, len(blobs), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]][a : a + 1000].astype(np.int32)), pa.array(sizes[a : a + 1000]), pa.array(blobs[a : a + 1000], pa.binary())], names=["range", "size", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            key = batch.column(2).flatten().to_numpy().view(np.uint64) & np.uint64((1 << (64 - _CLASS_BITS)) - 1)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            parts.append((key, np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes).astype("<u4"), pos.astype("<u4")))
            held += len(key)
            if held >= CHUNK_KEYS:
                yield from packed(parts)
                parts, held = [], 0
        if held:
            yield from packed(parts)
        give_back()

    return run


#: Keys of at most so many sets are rid of those sets that no other set of the key can reach.
_FEW_SETS = 16


def _reaching(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``_may_reach`` for rows of sets with a common key: whether a set reaches another of its row."""
    a, b, i, j = n[:, :, None], n[:, None, :], pos[:, :, None], pos[:, None, :]
    reach = (np.minimum(a, b) * 100 >= np.maximum(a, b) * PERCENT) & (np.minimum(a - i, b - j) * (100 + PERCENT) >= (a + b) * PERCENT)
    return (reach & ~np.eye(n.shape[1], dtype=bool)).any(axis=2)


def _several(key: np.ndarray, mark: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Keys of several sets, one row per key and set, with the key's number of sets."""
    order = np.lexsort((mark, key))
    key, mark, n, pos = key[order], mark[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])  # copies that unlike tasks sent
    key, mark, n, pos = key[new], mark[new], n[new], pos[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sets = np.diff(begin, append=len(key))
    keep = np.repeat(sets > 1, sets)
    for g in range(2, _FEW_SETS + 1):
        at = begin[sets == g][:, None] + np.arange(g)
        keep[at] = _reaching(n[at], pos[at])
    sets = np.repeat(np.add.reduceat(keep, begin, dtype=np.int64), sets)
    return [c[keep] for c in (key.astype(np.int64), mark, n, pos, sets)]


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed keys in the order of their ranges to the keys of several sets."""

    def found(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = _several(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        for a in range(0, len(cols[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in cols], names=["key", "mark", "n", "pos", "rows"])

    parts, now = [], None
    for batch in batches:
        for place, size, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if place != now and parts:
                yield from found(parts)
                parts = []
            now = place
            steps, *others = _unpack(blob, size, *_PACKED)
            parts.append([np.cumsum(steps), *others])
    if parts:
        yield from found(parts)
    give_back()


def _segments(classes, pivots: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, segments = [], []
            for text, want, sig in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if want in seen:  # a repeated row
                    continue
                keys = ordered(shingles(text), classes.value)
                if _signature(keys) != sig:  # another text under the same id
                    continue
                seen.add(want)
                node.append(want)
                segments.append([p.astype(np.int64) for p in np.split(keys, np.searchsorted(keys, pivots))])
            many = len(pivots) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(node, np.int64), many)), pa.array(np.tile(np.arange(many, dtype=np.int32), len(node))), pa.array([p for x in segments for p in x], pa.list_(pa.int64()))],
                names=["node", "fragment", "keys"],
            )
        _rest()

    return run


def _may_reach(na: Column, nb: Column, i: Column, j: Column) -> Column:
    """Length and position filter: with the shared key the first that both sets have, can they still reach the threshold?"""
    enough = F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT
    return enough & ((F.least(na - i, nb - j)) * (100 + PERCENT) >= (na + nb) * PERCENT)


def _differ_little(na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """Parity filter: each part whose parity differs holds a key that only one set has. A linked pair has at most
    (na + nb) / 9 such keys, so this tells members of a large group of near copies apart without reading them."""
    apart = sum((F.bit_count(pa_[i].bitwiseXOR(pb[i])) for i in range(1, 8)), F.bit_count(pa_[0].bitwiseXOR(pb[0])))
    return apart * (100 + PERCENT) <= (na + nb) * (100 - PERCENT)


class Join:
    """One run of the join over (id, text) rows."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, fragments: int, broadcast_rows: int):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.work = Workspace(self.spark, "ngram-join")
        self.fragments, self.broadcast_rows = fragments, broadcast_rows
        text = F.col(text_col).cast("string")
        k1, k2 = row_key(F.col(id_col), text)
        self.texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2")).alias("row"), text.alias("text"))
        self.kind = self.texts.schema["id"].dataType.simpleString()
        classes, self.pivots = frequency_classes(self.texts.select("text"), fragments)
        self.classes = self.spark.sparkContext.broadcast(classes)
        self.prefixes = self.work.cut(keyed.mapInArrow(_prefixes(self.classes), f"row struct<id:{self.kind},k1:long,k2:int>, n long, sig string, prefix array<long>, parity array<long>").select("row.*", "n", "sig", "prefix", "parity"), "prefixes")
        self.rows = self.work.cut(self.prefixes.select("id", "k1", "k2", "n", "sig"), "rows")
        nodes = self.prefixes.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("parity").alias("parity"))
        self.nodes = self.work.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.tested: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.links: list[DataFrame] = []

    def shared(self) -> DataFrame:
        """Prefix keys that several nodes have, one row per node and key, with the key's number of nodes."""
        # Sets go by 64-bit marks here. Two sets under one mark give candidates too many, except that they count as one set of
        # their keys: a chance of 2^-64 for a key that it matters to.
        mark = F.xxhash64("sig").alias("mark")
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = (self.prefixes.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT) // 100
        ranges = max(4 * many, keys // RANGE_KEYS, 1)
        sent = self.prefixes.filter(F.col("prefix").isNotNull()).select(mark, "n", "prefix").mapInArrow(_packs((ranges - 1).bit_length()), "range int, size long, blob binary")
        owned = sent.repartition("range").sortWithinPartitions("range").mapInArrow(_owner, "key long, mark long, n long, pos long, rows long")
        owned = self.work.cut(owned, "owned")
        marked = self.nodes.select(mark, "node", "n")
        shared = self.work.cut(owned.join(marked, ["mark", "n"]).select("key", "node", "n", "pos", "rows"), "shared")
        self.work.drop("prefixes", "owned")
        return shared

    def with_comps(self, shared: DataFrame) -> DataFrame:
        if self.comps is None:
            return shared.withColumn("comp", F.col("node"))
        return shared.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def chain(self, shared: DataFrame, turn: int) -> DataFrame:
        """Neighbours in an order of each key's nodes, if they are in different components.

        The order is by a hash, one of four by key, another four in another turn: chance neighbours, yet few distinct pairs.
        A key with many nodes has several chains, of CHAIN_NODES each or so, and other ones in another turn.
        """
        place = F.xxhash64("node", F.pmod("key", F.lit(4)), F.lit(turn))
        block = F.pmod(F.shiftright(place, 20), F.ceil(F.col("rows") / CHAIN_NODES))
        w = Window.partitionBy("key", block).orderBy(place, "node")
        prev = F.lag(F.struct("node", "n", "pos", "comp")).over(w)
        near = self.with_comps(shared).withColumn("p", prev).filter(F.col("p").isNotNull() & (F.col("p.comp") != F.col("comp")))
        return near.filter(_may_reach(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"))).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))

    def across(self, shared: DataFrame) -> DataFrame:
        """All pairs of nodes with a common prefix key that are in different components.

        Per key, nodes outside its largest component are paired with all others: none of that component's own pairs is made.
        A key's pairs are made by blocks of about BLOCK_PAIRS, each a part of both sides.
        """
        rows = self.with_comps(shared)
        mixed = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.max("c").alias("c"), F.sum("c").alias("all"), F.count("*").alias("comps")).filter("comps > 1")
        blocks = F.ceil(F.sqrt((F.col("all") - F.col("c")) * F.col("all").cast("double") / BLOCK_PAIRS)).cast("int").alias("blocks")
        rows = self.work.cut(rows.drop("rows").join(mixed.select("key", "major", blocks), "key").join(self.nodes.select("node", "parity"), "node"), "mixed")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        o = rows.filter("comp <> major").select("*", mine.alias("one")).select("*", every.alias("other")).alias("o")
        x = rows.select("*", mine.alias("other")).select("*", every.alias("one")).alias("x")
        met = (F.col("o.key") == F.col("x.key")) & (F.col("o.one") == F.col("x.one")) & (F.col("o.other") == F.col("x.other"))
        differ = (F.col("o.comp") != F.col("x.comp")) & ((F.col("x.comp") == F.col("x.major")) | (F.col("o.node") < F.col("x.node")))
        reach = _may_reach(F.col("o.n"), F.col("x.n"), F.col("o.pos"), F.col("x.pos"))
        parts = _differ_little(F.col("o.n"), F.col("x.n"), F.col("o.parity"), F.col("x.parity"))
        return o.join(x, met & differ & reach & parts).select(F.least("o.node", "x.node").alias("a"), F.greatest("o.node", "x.node").alias("b"))

    def test(self, pairs: DataFrame, name: str) -> DataFrame:
        """Counts the pairs' overlaps by fragments and returns the links (u, v, shared)."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"h{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").filter(_differ_little(F.col("na"), F.col("nb"), F.col("ha"), F.col("hb")))
        pairs = self.work.cut(near.select("a", "b"), f"pairs-{name}")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = self.work.cut(both.join(self.nodes.select("node", "first_id", "sig", "n"), "node"), f"wanted-{name}")
        # Their texts once more: broadcast the wanted ids where they are few, else let both sides be shuffled.
        side = wanted.select("node", "first_id", "sig")
        side = F.broadcast(side) if fits(wanted, self.broadcast_rows) else side
        texts = self.texts.join(side, F.col("id").eqNullSafe(F.col("first_id"))).select("text", "node", "sig")
        segments = self.work.cut(texts.mapInArrow(_segments(self.classes, self.pivots), "node long, fragment int, keys array<long>"), f"segments-{name}")
        sizes = wanted.select("node", "n")
        pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")

        def side(of: str) -> DataFrame:
            return segments.select(F.col("node").alias(of), "fragment", F.col("keys").alias(f"s{of}"))

        # One row per pair and fragment. The first fragment for all pairs: most candidates that share a passage only are out of
        # reach after it.
        part = F.size(F.array_intersect("sa", "sb")).cast("long").alias("part")
        rest = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb")).alias("rest")
        first = pairs.join(side("a").filter("fragment = 0"), "a").join(side("b").filter("fragment = 0").drop("fragment"), "b").select("a", "b", "na", "nb", part, rest)
        first = self.work.cut(first.filter((F.col("part") + F.col("rest")) * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT).drop("rest").distinct(), f"first-{name}")  # a node's rows of unlike tasks were cut up twice
        # The other fragments for those that are left; a pair's overlap is the sum over its fragments.
        met = first.drop("part").join(side("a").filter("fragment > 0"), "a").join(side("b"), ["b", "fragment"])
        parts = met.select("a", "b", "na", "nb", "fragment", part).distinct().drop("fragment").unionByName(first)
        summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("shared"))
        linked = summed.filter(F.col("shared") * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT)
        links = self.work.cut(linked.select(F.col("a").alias("u"), F.col("b").alias("v"), "shared"), f"links-{name}")
        self.work.drop(f"segments-{name}", f"wanted-{name}", f"first-{name}")
        return links

    def merge(self, links: DataFrame, name: str) -> None:
        """Adds links to the components: those between old components are solved on their own, then composed."""
        self.links.append(links)
        if self.comps is None:
            self.comps = self.work.cut(components(links, self.work, f"cc-{name}"), f"comps-{name}")
            return
        old = self.comps
        u, v = old.select(F.col("node").alias("u"), F.col("comp").alias("cu")), old.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        lifted = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        new = self.work.cut(components(lifted, self.work, f"cc-{name}"), f"lift-{name}").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = old.join(new, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        fresh = new.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(old, "node", "left_anti")
        self.comps = self.work.cut(moved.unionByName(fresh), f"comps-{name}")

    def run(self, turns: int = 2) -> None:
        shared = self.shared()
        for turn in range(turns):
            links = self.test(self.chain(shared, turn), f"chain{turn}")
            self.merge(links, f"chain{turn}")
            shared = shared.filter("rows > 2")  # the only pair of two has been made
        self.merge(self.test(self.across(shared), "across"), "across")
        self.work.drop("shared", "mixed")
        self.classes.destroy()  # all that needed it is written

    def components(self) -> DataFrame:
        """(sig, comp) of every set, and of its row with the smallest id (nulls last): first_id, k1, k2."""
        named = self.nodes.join(self.comps, "node", "left")
        return named.select("sig", "first_id", F.coalesce("comp", "node").alias("comp"))

    def _many(self) -> DataFrame:
        """Sets with over a thousand rows: at most a thousandth of the rows."""
        many = self.rows.filter("sig is not null").groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > 1000).select("sig", F.lit(True).alias("many"))
        return F.broadcast(many) if fits(many, self.broadcast_rows // 10) else many

    def others(self) -> DataFrame:
        """Keys (k1, k2) of all rows but one of each component, the one with the smallest id (nulls last), then key."""
        place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
        best = self.rows.filter("sig is not null").groupBy("sig").agg(F.min(place).alias("best"))
        best = best.join(self.components().select("sig", "comp"), "sig").groupBy("comp").agg(F.min("best").alias("best")).select("best.k1", "best.k2")
        return self.rows.filter("sig is not null").select("k1", "k2").join(best, ["k1", "k2"], "left_anti")

    def result(self) -> DataFrame:
        named = self.components()
        least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        by_sig = self.work.cut(named.join(least, "comp").select("sig", "component_id"), "named")
        # A hot signature's rows would meet in one task: rows are salted, and the few signatures with many rows are repeated.
        salts = 16
        rows = self.rows.select("id", "n", "sig", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
        many = self._many()
        side = by_sig.join(many, "sig", "left").select("sig", "component_id", F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))).alias("slot"))
        tagged = rows.join(many, "sig", "left").withColumn("slot", F.when(F.col("many"), F.col("salt").cast("int")).otherwise(-1))
        out = tagged.join(side, ["sig", "slot"], "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragments: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct 5-word shingles. Rows link when
    100 * intersection >= 80 * union. Defined cases: fewer words than five are one shingle; a null or blank text has no
    shingle, links with nothing and is its own component; equal sets (repeated rows among them) are linked; a null id gets its
    component's smallest id, null if there is none; texts are whole, however long; an empty table gives an empty result. Other
    columns are left behind, whatever their names.

    ``broadcast_rows`` bounds the ids broadcast to fetch candidates' texts again; beyond it the join is shuffled.
    """
    join = Join(docs, id_col, text_col, fragments, broadcast_rows)
    join.run()
    return join.result().withColumnRenamed("id", id_col)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragments: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The input's rows, all columns, with one row of each component of ``near_duplicates``: the one with the smallest id.

    Rows are known by their id and text. Defined cases: a null or blank text stays, as often as it is there; a null id comes
    after all others; of rows with one id in one component one stays, and of rows that agree in id and text one, whichever
    their other columns; columns may have any names; an empty table stays empty.
    """
    join = Join(docs, id_col, text_col, fragments, broadcast_rows)
    join.run()
    kept = without_rows(docs, join.work.cut(join.others(), "others"), id_col, text_col)
    repeated = join.rows.filter("sig is not null").groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1")
    if repeated.isEmpty():
        return kept
    # Rows that agree in id and text are told apart only if there are any: it shuffles the texts. Blank ones all stay.
    a, b, c = unused(docs, "_k1", "_k2", "_nth")
    one, two = row_key(docs[id_col], docs[text_col].cast("string"))
    blank = F.rlike(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(r"^[ \t-\r]*$"))
    return kept.withColumns({a: one, b: two, c: F.when(blank, F.monotonically_increasing_id()).otherwise(-1)}).dropDuplicates([a, b, c]).drop(a, b, c)
