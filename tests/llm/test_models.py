from __future__ import annotations

import math
from collections import Counter

import numpy as np
import zlib

from sparkloom.llm import lm_score, ngram_join, quality
from sparkloom.llm.components import components
from sparkloom.llm.workspace import Workspace


def sets(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    index = {}
    for i, x in enumerate(s):
        for k in x:
            index.setdefault(k, []).append(i)
    for i, x in enumerate(s):
        for j, n in Counter(j for k in x for j in index[k] if j > i).items():
            if 100 * n >= 80 * (len(x) + len(s[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(s[i]), doc if not s[i] else least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def got_components(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()), key=str)


def test_join_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = "this is one fairly long sentence that many people copied over and over with small changes at the end of it all today".split()
    rng = np.random.default_rng(3)
    for i in range(60):  # a group of near copies around the threshold
        w = list(base) * 3
        for p in rng.integers(0, len(w), 1 + i % 3):
            w[p] = f"w{rng.integers(1000)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "A\tb"), (None, "A b"), (-5, "a b c d e"), (-5, "a b c d e")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, sig string")
    assert got_components(df) == brute_components(rows)


def test_join_in_small_blocks(spark, monkeypatch):
    """Hot keys are cut up: chains of two nodes and blocks of a few pairs change no component."""
    base = [f"w{i}" for i in range(60)]
    rng, rows = np.random.default_rng(5), []
    for i in range(80):
        w = list(base)
        for p in rng.integers(0, 60, 1 + i % 3):
            w[p] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, "one two three four five " + " ".join(f"y{i}z{j}" for j in range(i % 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    monkeypatch.setattr(ngram_join, "CHAIN_NODES", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS", 3)
    assert got_components(df) == want


def test_one_row_of_each_component_stays(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(3, near, 1), (5, near + " extra", 2), (5, "quite another text that is like no other one here", 3), (7, near, 4), (7, near, 5), (None, near, 6), (8, None, 7), (8, " ", 8), (8, " ", 9), (None, "lost one without any number but words", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _K1 int")
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_K1"] for r in kept.collect()) == [1, 3, 7, 8, 9, 10]
    alone = ngram_join.without_near_copies(docs.filter("doc_id = 7 or doc_id is null")).collect()
    assert [r["doc_id"] for r in alone if r["text"] == near] == [7]


def test_join_of_nothing(spark, none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert got_components(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r["node"]: r["comp"] for r in components(links, Workspace(spark, "test"), "c").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    pos = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 1]
    neg = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 0]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.95
    assert quality.accepted(docs, labels).count() == sum(r["predicted"] for r in rows)


def test_quality_fit_matches_one_process(spark):
    """The same ridge system and calibration from all labelled rows at once, without Spark."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {str(r["doc_id"]): float(r["quality"]) for r in labels.collect()}
    stats = {str(r["doc_id"]): quality.statistics(r["text"] or "") for r in docs.collect()}
    learnt = sorted(i for i in stats if i in truth and zlib.crc32(i.encode()) % 5)
    x, y = np.array([stats[i] for i in learnt]), np.array([truth[i] for i in learnt])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, 1 / 6, (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)
    features = lambda a: np.hstack([np.sqrt(2 / 256) * np.cos(np.clip((a - mean) / scale, -6, 6) @ w + b), np.ones((len(a), 1))])
    fits = np.array([zlib.crc32(f"{i}/calibrate".encode()) % 4 != 0 for i in learnt])
    z = features(x[fits])
    beta = np.linalg.solve(z.T @ z + 1e-3 * fits.sum() * np.eye(257), z.T @ y[fits])
    raw, good = np.round(features(x[~fits]) @ beta, 3), y[~fits]
    points = sorted({r: (r, good[raw == r].mean(), (raw == r).sum()) for r in raw}.values())
    # Isotonic regression by its min-max formula; then the same smoothing of each block.
    n = len(points)
    mass = lambda i, j: sum(p[2] for p in points[i : j + 1])
    share = lambda i, j: sum(p[1] * p[2] for p in points[i : j + 1]) / mass(i, j)
    level = [round(max(min(share(i, j) for j in range(k, n)) for i in range(k + 1)), 12) for k in range(n)]
    blocks = [[k for k in range(n) if level[k] == v] for v in sorted(set(level))]
    knots = [sum(points[k][0] * points[k][2] for k in c) / sum(points[k][2] for k in c) for c in blocks]
    values = np.maximum.accumulate([(sum(points[k][1] * points[k][2] for k in c) + good.mean()) / (sum(points[k][2] for k in c) + 1) for c in blocks])
    ids = list(stats)
    want = dict(zip(ids, np.clip(np.interp(features(np.array([stats[i] for i in ids])) @ beta, knots, values), 0, 1), strict=True))
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ids)
    assert max(abs(r["score"] - want[str(r["doc_id"])]) for r in rows) < 1e-6


def test_quality_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, labels).columns == odd.columns


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, ("good words here. " if i % 2 else "BAD!! ") * (1 + i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    score = lambda lab: {r["doc_id"]: round(r["score"], 6) for r in quality.classify(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_isotonic_is_monotone():
    x, y = quality.isotonic(np.array([0.0, 0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_lm_counts_real_ngrams(spark, odd):
    odd = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, f"w{i} v{i} w{i} u{i % 7}") for i in range(500)], "doc_id long, text string"))
    wanted = {4, 5, 7, *range(100, 200)}
    target = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in odd.collect()]
    words, pairs = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for i, w in texts:
        for s in [True, False] if i in wanted else [False]:
            words[s].update(w)
            pairs[s].update(zip(w, w[1:], strict=False))
    n = {s: sum(c.values()) for s, c in words.items()}

    def loss(w, s):
        f, total = (1 if s else n[True] / n[False]), 0.0
        for j in range(len(w)):
            p = (words[s][w[j]] * f + 1) / (n[True] + len(words[False]))
            if j:
                p = (pairs[s][w[j - 1], w[j]] * f + 8 * p) / (words[s][w[j - 1]] * f + 8)
            total -= math.log(p)
        return total / len(w) if w else 0.0

    def want(found):
        return sorted((str(i), len(w), round(loss(w, True), 9), round(loss(w, False), 9)) for i, w in found)

    got = lm_score.score(odd, target).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 9), round(r["background_loss"], 9)) for r in got) == want(texts)
    assert all(r["difference"] == r["target_loss"] - r["background_loss"] for r in got)
    assert lm_score.score(odd.limit(0), target).count() == 0
    assert {r["target_loss"] for r in lm_score.score(odd.filter("doc_id in (2, 3)"), target).collect()} == {0.0}
