from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest_texts import TEXTS
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, sharding


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), (i is None, i or 0), i))
    return {k: (min(v, key=lambda x: x[:2])[2], len(v)) for k, v in groups.items()}


def test_groups_match_brute_force(odd):
    got = exact_dedup.dedup_groups(odd).collect()
    want = expected_groups(TEXTS)
    assert len(got) == len(TEXTS)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
    assert sum(r["kept"] for r in got) == len(want)  # one row of each group, repeated rows or not


def test_small_cache_and_buckets_change_nothing(odd):
    key = lambda df: sorted(map(str, df.collect()))
    many = odd.unionByName(odd).repartition(5)
    a = exact_dedup.dedup_groups(many).drop("kept")
    b = exact_dedup.dedup_groups(many, bucket_bytes=200, cache_bytes=1).drop("kept")
    assert key(a) == key(b)


def test_rows_stay_whole(odd):
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(expected_groups(TEXTS))


def test_the_longest_row_of_an_id_stays(spark):
    rows = [(4, "a b", 1), (4, "a   b", 2), (4, "a   b", 3), (9, "a    b", 4), (9, "ab", 5), (None, "c", 6), (None, "c ", 7), (8, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha int")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert got == [("8", ""), ("9", "a    b"), ("None", "c ")]
    assert [r["text"] for r in exact_dedup.without_copies(docs.filter("doc_id = 4")).collect()] == ["a   b"]


def test_colliding_hashes_are_chained():
    import pyarrow as pa
    import zstandard

    names = ["hash", "entry_id", "body", "best_len", "best_id", "best_row", "rows"]
    pack = lambda x, level=1: zstandard.ZstdCompressor(level=level).compress(x)
    long = bytes(range(256)) * 20 + b"abcabcabd" * 300
    assert pack(long, 1) != pack(long, 19)  # packed otherwise, yet the same text
    rows = [(7, "a", pack(long, 1), 3, "5", "r1", 1), (7, "b", pack(b"y"), 3, "6", "r2", 2), (7, "c", pack(long, 19), 4, "9", "r3", 1), (8, "d", pack(b"x"), 1, "1", "r4", 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    out = [r for b in exact_dedup._owner(iter([batch])) for r in b.to_pylist()]
    groups = {r["of"]: (r["keep_id"], r["group_size"]) for r in out if r["entry_id"] is None}
    assert {r["entry_id"]: groups[r["of"]] for r in out if r["entry_id"]} == {"a": ("9", 2), "c": ("9", 2), "b": ("6", 2), "d": ("1", 1)}


def test_owners_have_ranges_of_keys():
    weights = np.random.default_rng(1).integers(0, 50, 256).astype(float)
    d = exact_dedup.Directory(200).load(weights)
    slots = d.owners(weights, 5)
    assert [s[0] for s in slots] == list(range(len(d.slots)))
    buckets, owners = [s[1] for s in slots], [s[2] for s in slots]
    assert buckets == sorted(buckets) and owners == sorted(owners) and set(owners) == set(range(5))
    assert all(len({o for b, o in zip(buckets, owners, strict=True) if b == x}) == 1 for x in set(buckets))
    assert exact_dedup.Directory(200).load(np.zeros(16)).owners(np.zeros(16), 5) == [(0, 0, 0)]


def test_directory_doubles_and_splits():
    weights = np.zeros(256)
    weights[3], weights[200], weights[201] = 50, 8, 8
    d = exact_dedup.Directory(10).load(weights)
    loads = {}
    for p, w in enumerate(weights):
        b = int(d.slots[p >> (8 - d.depth)])
        loads[b] = loads.get(b, 0) + w
    assert len(d.slots) == 1 << d.depth
    assert all(v <= 10 or v == 50 for v in loads.values())  # one hash prefix can't be split further
    assert d.depth == 8


def test_empty_tables(none):
    assert exact_dedup.dedup_groups(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert exact_dedup.without_copies(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.permute(np.arange(n), n, key=5)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(np.arange(n), n, key=5) == p).all()
    if n > 100:
        assert (p != np.arange(n)).mean() > 0.9


def test_shards(odd):
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(odd)
    rows = sharding.shard(many, shards=4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    texts = {i: (t or "").encode() for i, t in TEXTS if i is not None}
    for r in rows:
        if r["doc_id"] in texts:
            assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))


def test_shard_and_slot_follow_from_number_and_key(spark, odd):
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    rows = sharding.shard(many, shards=3, key=11).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    n, half = len(rows), 1
    while 4**half < n:
        half += 1
    mask, wide = 2**half - 1, 2**64 - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & wide
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & wide
        return x ^ x >> 32

    def place(number):
        while True:
            left, right = number >> half, number & mask
            for i in range(6):
                left, right = right, left ^ (mix(right, 11 * 0x10001 + i * 0x9E3779B9) & mask)
            number = left << half | right
            if number < n:
                return number

    want = sorted((str(r["doc_id"]), r["text_crc32"], place(i) % 3, place(i) // 3) for i, r in enumerate(order))
    assert sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rows) == want


def test_shards_do_not_depend_on_the_layout(odd):
    place = lambda df: sorted(map(str, sharding.shard(df).collect()))
    assert place(odd) == place(odd.repartition(7, "text"))
