"""What the n-gram join and the tokenizer must not do at size: send keys twice, sort in every step."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import bpe, ngram_join


def _shuffled(spark) -> int:
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, jvm._gateway.new_array(jvm._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_prefix_keys_are_sent_once(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passages = [[word() for _ in range(5)] for _ in range(150)]  # each in two texts that are else unlike: keys of two sets
    rows = [(i, " ".join([*(word() for _ in range(2000)), *passages[i // 2]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    join = ngram_join.Join(docs, "doc_id", "text", 4, 0)  # beyond every broadcast
    keys = sum(len(r["prefix"]) for r in join.prefixes.select("prefix").collect())
    before = _shuffled(spark)
    join.shared()
    assert keys > 100_000
    assert _shuffled(spark) - before < 20 * keys


def _want(rows):
    by = defaultdict(set)
    for k, m, n, p in rows:
        by[k].add((m, n, p))
    out = set()
    for k, sets in by.items():
        def reach(x, y):
            return min(x[1], y[1]) * 100 >= max(x[1], y[1]) * 80 and min(x[1] - x[2], y[1] - y[2]) * 180 >= (x[1] + y[1]) * 80
        left = sets if len(sets) > 16 else {x for x in sets if any(reach(x, y) for y in sets if y != x)}
        if len(sets) > 1:
            out |= {(k, *x, len(left)) for x in left}
    return out


def test_owners_find_the_keys_of_several_sets():
    rng = random.Random(1)
    sizes = {m: rng.randrange(1, 40) for m in range(60)}
    place = lambda m, k: (m * 31 + k * 7) % (sizes[m] // 5 + 1)
    rows = [(k, m, sizes[m], place(m, k)) for k in range(200) for m in rng.sample(range(60), rng.choice([1, 1, 2, 2, 3, 5, 16, 17, 30]))]
    rows += rng.sample(rows, 300)  # copies that unlike tasks sent
    rng.shuffle(rows)
    cols = [np.array(c) for c in zip(*rows, strict=True)]
    got = ngram_join._several(cols[0].astype(np.uint64), cols[1], cols[2].astype("<u4"), cols[3].astype("<u4"))
    assert len(got[0]) == len(set(zip(*(c.tolist() for c in got), strict=True)))
    assert set(zip(*(c.tolist() for c in got), strict=True)) == _want(rows)


def test_packed_columns_read_back():
    a, b = np.arange(7, dtype="<u8") * np.uint64(2**50 + 3), np.arange(7, dtype="<u4")
    c, d = ngram_join._unpack(ngram_join._pack(a, b), 7, "<u8", "<u4")
    assert c.tolist() == a.tolist() and d.tolist() == b.tolist()


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_ordinary_words_are_contracted_without_sorts_in_the_steps(coder, monkeypatch):
    ran = []
    db = coder._open()
    class Spy:  # noqa: E306
        def __getattr__(self, name):
            return getattr(db, name)
        def sql(self, query, params):  # noqa: E301
            ran.append(db.sql("explain " + query, params=params).fetchall()[0][1])
            return db.sql(query, params=params)
    monkeypatch.setattr(coder, "db", Spy())
    coder._contract([b"unbelievabilities", b"zxcvbnmasd"])
    assert ran and all("streaming window" in x.lower().replace("_", " ") for x in ran)


def test_rows_out_of_order_are_sorted(coder, monkeypatch):
    words = [f" zq{i}xk{i * i}unlikely".encode() for i in range(300)]
    want = coder._contract(words)
    wrong = bpe._CONTRACT_IN_ORDER.replace("from state where todo > 0)", "from (select * from state where todo > 0 order by place desc))")
    assert wrong != bpe._CONTRACT_IN_ORDER
    monkeypatch.setattr(bpe, "_CONTRACT_IN_ORDER", wrong)
    assert coder._contract(words) == want
