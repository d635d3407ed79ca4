"""Queries without SQL, held against plain Python and numpy versions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from sparkloom.plans import registry
from sparkloom.plans.catalogue import Catalogue

Q = registry.queries()


@pytest.fixture(scope="module")
def points(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


@pytest.fixture(scope="module")
def tokens(spark, sf):
    held = defaultdict(set)
    for r in Catalogue(spark, sf).tok.collect():
        held[r["item"]].add(r["token"])
    return held


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return {r["token"]: np.array(r["vec"]) for r in Q["sim14_truncated_svd"](spark, sf).collect()}


def test_truncated_svd_keeps_the_largest_parts_of_the_ppmi_matrix(tokens, vectors):
    df, both = Counter(t for s in tokens.values() for t in s), Counter()
    for s in tokens.values():
        both.update(combinations(sorted(s), 2))
    names = sorted({t for pair in both for t in pair})
    assert sorted(vectors) == names
    m = np.zeros((len(names), len(names)))
    for (f, g), k in both.items():
        m[names.index(f), names.index(g)] = m[names.index(g), names.index(f)] = max(0.0, math.log(k * len(tokens) / (df[f] * df[g])))
    # Here singular values tie, so the parts are known up to a rotation only: they are orthogonal eigenvectors of the squared
    # matrix, and their squared lengths are its largest singular values, in order.
    large = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1][:8]
    got = np.array([vectors[n] for n in names])
    assert np.allclose(got.T @ got, np.diag(large), atol=1e-4)
    assert np.allclose(m @ m @ got, got * large**2, atol=1e-3)


def test_mean_pooling_is_the_unit_mean_by_idf(spark, sf, tokens, vectors):
    df = Counter(t for s in tokens.values() for t in s)
    got = defaultdict(dict)
    for r in Q["sim15_mean_pooling"](spark, sf).collect():
        got[r["item"]][r["d"]] = r["v"]
    assert set(got) == {i for i, s in tokens.items() if s & vectors.keys()}
    for item, at in got.items():
        known = sorted(tokens[item] & vectors.keys())
        w = np.array([math.log((len(tokens) + 1) / (df[t] + 1)) + 1 for t in known])
        mean = w @ np.array([vectors[t] for t in known]) / w.sum()
        assert np.allclose([at[d] for d in range(len(mean))], mean / (np.linalg.norm(mean) or 1.0), atol=1e-4)


def test_pca_projects_on_the_two_widest_directions(spark, sf, points):
    ids, x = points
    lam, v = np.linalg.eigh(np.cov(x.T))
    assert min(lam[-1] - lam[-2], lam[-2] - lam[-3]) > 1e-9
    want = dict(zip(ids, np.abs(x @ v[:, [-1, -2]]), strict=True))
    got = Q["geo01_pca"](spark, sf).collect()
    assert len(got) == len(ids)
    assert all(np.allclose((r["x"], r["y"]), want[r["vec_id"]], atol=1e-4) for r in got)


def test_kmeans_is_as_tight_as_plain_lloyd(spark, sf, points):
    ids, x = points
    said = {r["vec_id"]: r["cluster"] for r in Q["geo10_kmeans"](spark, sf).collect()}
    assert sorted(said) == sorted(ids) and set(said.values()) == set(range(10))
    label = np.array([said[i] for i in ids])

    def spread(label):
        return sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))

    def lloyd(seed):
        centers = x[np.random.default_rng(seed).choice(len(x), 10, replace=False)]
        for _ in range(50):
            near = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
            centers = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(10)])
        return near

    assert spread(label) <= 1.1 * np.median([spread(lloyd(s)) for s in range(9)])
    means = np.array([x[label == c].mean(0) for c in range(10)])
    assert (((x[:, None] - means) ** 2).sum(2).argmin(1) == label).mean() >= 0.95


def test_quota_selection_takes_each_types_dearest_parts(spark, sf):
    groups, got = defaultdict(list), defaultdict(set)
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        groups[r["p_type"]].append((-r["p_retailprice"], r["p_partkey"]))
    for r in Q["smp02_quota_selection"](spark, sf).collect():
        got[r["p_type"]].add(r["p_partkey"])
    mass = sum(math.sqrt(len(g)) for g in groups.values())
    assert sum(map(len, got.values())) == 120
    for kind, rows in groups.items():
        n = len(got[kind])
        assert min(5, len(rows)) <= n <= 40 and abs(n - 120 * math.sqrt(len(rows)) / mass) <= 1.5
        assert got[kind] == {key for _, key in sorted(rows)[:n]}


def matched(a: str, b: str) -> int:
    """Characters in the longest common block, the first in a, then in b, and in what lies left and right of it."""
    n, i, j = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=(0, 0, 0))
    return n + matched(a[:-i], b[:-j]) + matched(a[n - i :], b[n - j :]) if n else 0


def test_ratio_is_ratcliff_obershelp(spark, sf):
    names = sorted({r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()})
    got = {(r["a"], r["b"]): r["ratio"] for r in Q["txt10_ratio"](spark, sf).collect()}
    assert set(got) == set(combinations(names, 2))
    for a, b in sorted(got)[::7]:  # the test's own loop is slow: a seventh of the pairs
        assert got[a, b] == pytest.approx(2 * matched(a, b) / (len(a) + len(b)), abs=1e-6)
