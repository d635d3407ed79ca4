"""Exact deduplication by an extendible-hash index on shared files.

1. A pass over the documents writes the entry log: per row a digest of its normalised text, and per partition and
   distinct text one entry with the (compressed) text, the row that would stay, and the number of rows.
2. The driver builds the directory from the entries' sizes by hash prefix: it starts with one bucket, doubles when a
   bucket at full depth is overfull, and splits overfull buckets until all fit or hold one hash prefix.
3. The directory is a file too: one row per slot with its bucket and the bucket's owner. Buckets are numbered in the order
   of their keys and an owner has a range of them of about equal bytes.
4. Owner tasks take their ranges in the order of the hashes, chain entries of equal hash, compare their bytes and decide each
   group. They hold one chain of unlike texts at a time, and name an entry's group as soon as they have read it.
5. Rows get their group's decision through their partition's entry, so a text that makes up a third of all rows
   is spread over as many keys as partitions saw it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, give_back, row_key, small_batches, unused, without_rows

#: The contract's white space, [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


class Directory:
    """An extendible-hash directory over the top bits of 64-bit hashes.

    ``slots[prefix]`` names the bucket of a hash whose top ``depth`` bits are ``prefix``; a bucket of local depth l
    stands in 2**(depth - l) neighbouring slots.
    """

    def __init__(self, capacity: int):
        self.capacity, self.depth = capacity, 0
        self.slots = np.zeros(1, np.int64)
        self.local = [0]

    def load(self, weights: np.ndarray) -> Directory:
        """Splits for the given sums of entry bytes by hash prefix (a power of two of them, the deepest level)."""
        most = len(weights).bit_length() - 1
        while True:
            cells = self.slots[np.arange(len(weights)) >> (most - self.depth)]
            loads = np.bincount(cells, weights, minlength=len(self.local))
            over = [b for b in np.flatnonzero(loads > self.capacity) if self.local[b] < most]
            if not over:
                return self
            if any(self.local[b] == self.depth for b in over):  # the directory doubles
                self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
            for b in over:
                if self.local[b] < self.depth:
                    self._split(int(b))

    def _split(self, bucket: int) -> None:
        mine = np.flatnonzero(self.slots == bucket)
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        self.slots[mine[len(mine) // 2 :]] = len(self.local) - 1

    def owners(self, weights: np.ndarray, tasks: int) -> list[tuple[int, int, int]]:
        """Per slot its number, its bucket in key order and the bucket's owner: ranges of keys with about equal weight."""
        fresh = np.concatenate(([0], np.cumsum(np.diff(self.slots) != 0)))
        loads = np.bincount(fresh, weights.reshape(len(self.slots), -1).sum(axis=1))
        middle = np.cumsum(loads) - loads / 2
        owner = np.minimum(middle * tasks // max(1.0, loads.sum()), tasks - 1).astype(int)
        return [(i, int(b), int(owner[b])) for i, b in enumerate(fresh)]


_LOG = "doc_id string, row_id string, entry_id string, sha string, hash long, body binary, best_len long, best_id string, best_row string, rows long"
_unpack = zstandard.decompress


def _entry_log(cache_bytes: int):
    text, whole = pa.string(), pa.int64()
    schema = pa.schema([("doc_id", text), ("row_id", text), ("entry_id", text), ("sha", text), ("hash", whole), ("body", pa.binary()), ("best_len", whole), ("best_id", text), ("best_row", text), ("rows", whole), ("k1", whole), ("k2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        held: OrderedDict[bytes, list] = OrderedDict()
        size, serial, row = 0, 0, 0

        def entries(found: list[list]) -> list[tuple]:
            return [(None, None, e[0], None, e[2], e[1], e[3], e[4], e[6], e[5], None, None) for e in found]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for part in batches:
            rows, gone = [], []
            for doc_id, text, task, k1, k2 in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)
                digest = hashlib.sha256(raw).digest()
                length, row_id = len(text or ""), f"{task}.{row}"
                row += 1
                e = held.get(digest)
                if e is None or _unpack(e[1]) != raw:
                    # e: entry id, packed text, hash, longest original, its id, rows, its row
                    body = pack(raw)
                    e = [f"{task}.{serial}", body, xxhash.xxh3_64_intdigest(raw) - (1 << 63), length, doc_id, 1, row_id]
                    serial += 1
                    if digest not in held:
                        held[digest] = e
                        size += len(body)
                    else:
                        gone.append(e)
                    while size > cache_bytes and len(held) > 1:
                        old = held.popitem(last=False)[1]
                        size -= len(old[1])
                        gone.append(old)
                else:
                    held.move_to_end(digest)
                    e[5] += 1
                    if (-length, _key(doc_id)) < (-e[3], _key(e[4])):
                        e[3], e[4], e[6] = length, doc_id, row_id
                rows.append((doc_id, row_id, e[0], digest.hex(), None, None, None, None, None, None, k1, k2))
            yield batch(rows)
            if gone:
                yield batch(entries(gone))
        while held:
            yield batch(entries([held.popitem(last=False)[1] for _ in range(min(256, len(held)))]))
        give_back()

    return run


def _key(doc_id: str | None) -> tuple:
    """Ids travel as text; whole numbers compare as numbers, a null comes last."""
    if doc_id is None:
        return (2, 0, "")
    return (0, int(doc_id), "") if doc_id.lstrip("-").isdigit() else (1, 0, doc_id)


_DECIDED = "entry_id string, of string, keep_id string, keep_row string, group_size long"


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (hash, entry_id, body, best_len, best_id, best_row, rows) come sorted by hash. One row per entry, with the name
    of its group, and one per group, with its decision. Equal packed bytes are equal bytes; unlike ones are unpacked."""
    schema = pa.schema([("entry_id", pa.string()), ("of", pa.string()), ("keep_id", pa.string()), ("keep_row", pa.string()), ("group_size", pa.int64())])
    chain: list[list] = []  # of unlike texts with one hash: packed text, longest, its id, its row, rows
    at = None
    out: list[tuple] = []

    def close() -> None:
        out.extend((None, f"{at}.{i}", best, row, n) for i, (_, _, best, row, n) in enumerate(chain))

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return found

    for part in batches:
        for h, entry, body, length, best, row, n in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
            if h != at:
                close()
                chain, at = [], h
            for i, c in enumerate(chain):
                if c[0] == body or _unpack(c[0]) == _unpack(body):
                    if (-length, _key(best), row) < (-c[1], _key(c[2]), c[3]):
                        c[1:4] = length, best, row
                    c[4] += n
                    break
            else:
                i = len(chain)
                chain.append([body, length, best, row, n])
            out.append((entry, f"{h}.{i}", None, None, None))
        if len(out) > 20_000:
            yield batch()
    close()
    if out:
        yield batch()


def _groups(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, cache_bytes: int, max_depth: int) -> DataFrame:
    """Per row: doc_id as text, sha (of the normalised text), keep_id, group_size, kept, and k1 and k2, the key of the row's id and
    text."""
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    small_batches(spark)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text"), F.spark_partition_id().alias("task"), *(c.alias(f"k{i}") for i, c in enumerate(row_key(F.col(id_col), text), 1)))
    log = work.cut(slim.mapInArrow(_entry_log(cache_bytes), f"{_LOG}, k1 long, k2 int"), "entries")
    entries, rows = log.filter(F.col("body").isNotNull()), log.filter(F.col("sha").isNotNull())

    # Depth for about eight histogram cells a bucket; at most 2**max_depth rows come back, whatever the input.
    total = entries.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0))).first()[0]
    bits = int(min(max_depth, max(4, (8 * total // bucket_bytes).bit_length())))
    # Hashes are signed here, so that their order is that of the keys: the top bits count from the least one.
    prefix = F.shiftright("hash", 64 - bits) + (1 << (bits - 1))
    weights = np.zeros(1 << bits)
    for r in entries.groupBy(prefix.alias("p")).agg(F.sum(F.octet_length("body") + 64).alias("w")).collect():
        weights[r["p"]] = r["w"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = Directory(bucket_bytes).load(weights)
    slots = work.cut(spark.createDataFrame(directory.owners(weights, tasks), "slot long, bucket long, owner int").coalesce(1), "directory")
    # At most 2**max_depth slots of three numbers: 6 MB at 18.
    placed = entries.withColumn("slot", F.shiftright(prefix, bits - directory.depth)).join(F.broadcast(slots), "slot")
    owned = (
        placed.select("owner", "hash", "entry_id", "body", "best_len", "best_id", "best_row", "rows")
        .repartitionById(tasks, F.col("owner"))
        .sortWithinPartitions("hash").drop("owner")
    )
    told = work.cut(owned.mapInArrow(_owner, _DECIDED), "decided")
    decided = told.filter("entry_id is null").drop("entry_id")
    out = rows.select("doc_id", "row_id", "entry_id", "sha", "k1", "k2").join(told.filter("entry_id is not null").select("entry_id", "of"), "entry_id").join(decided, "of")
    return out.select("doc_id", "sha", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "k1", "k2")


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, cache_bytes: int = 24 << 20, max_depth: int = 18) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row with the most code points in its
    original text stays, then the smallest id. Defined cases: a null text counts as empty; a null id comes after all
    others; repeated rows (equal id and text) belong to one group, of which one row is kept; texts are whole, however long; an
    empty table gives an empty result. Other columns are left behind, whatever their names.

    ``bucket_bytes``: entries' bytes beyond which a bucket splits. ``cache_bytes``: texts a task holds to merge its own
    rows; beyond it the oldest leave and may come again as entries of their own, which the owner merges.
    ``max_depth`` bounds the directory (2**max_depth slots, 2 MB at 18) and what the driver reads to build it; a bucket
    that is still overfull at this depth is a longer stream for its owner, never more memory.
    """
    kind = docs.schema[id_col].dataType
    return _groups(docs, id_col, text_col, bucket_bytes, cache_bytes, max_depth).select(
        F.col("doc_id").cast(kind).alias(id_col), F.col("keep_id").cast(kind).alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, cache_bytes: int = 24 << 20, max_depth: int = 18) -> DataFrame:
    """The input's rows, all columns, without those that ``dedup_groups`` doesn't keep.

    Rows are known by their id and original text, so of several rows with one id exactly the longest stays. Defined cases: a
    null text is like an empty one, and where both stand under one id either stays; of rows that agree in id and text one
    stays, whichever their other columns; a null id is like any other; texts are whole, however long; columns may have any names;
    an empty table stays empty.
    """
    groups = Workspace(docs.sparkSession, "without-copies").cut(_groups(docs, id_col, text_col, bucket_bytes, cache_bytes, max_depth).select("kept", "k1", "k2"), "groups")
    keys = groups.groupBy("k1", "k2").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    kept = without_rows(docs, keys.filter("not stays"), id_col, text_col)
    # Rows that agree in id and text are told apart only if there are any: it shuffles the texts.
    if keys.filter("stays and n > 1").isEmpty():
        return kept
    a, b = unused(docs, "_k1", "_k2")
    one, two = row_key(docs[id_col], docs[text_col].cast("string"))
    return kept.withColumns({a: one, b: two}).dropDuplicates([a, b]).drop(a, b)
