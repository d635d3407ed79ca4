"""Pairing of two short label lists, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(s: str, layer: int) -> str:
    """Layers of likeness: as it is, lower case without spaces, without a plural s, sorted words."""
    flat = "".join(c for c in s.casefold() if c.isalnum())
    return (s, flat, flat.removesuffix("s"), " ".join(sorted(s.casefold().split())))[layer]


def _layer(a: str, b: str) -> int | None:
    for i in range(4):
        if _key(a, i) == _key(b, i):
            return i
    x, y = set(a.casefold().split()), set(b.casefold().split())
    return 4 if (x <= y or y <= x) and x and y and len(x ^ y) <= 1 else None


def greedy(gold: list[str], said: list[str]) -> list[tuple[str, str]]:
    """One-to-one pairs, closest layer first, names breaking ties."""
    options = sorted((layer, g, s, i, j) for i, g in enumerate(gold) for j, s in enumerate(said) if (layer := _layer(g, s)) is not None)
    used_g: set[int] = set()
    used_s: set[int] = set()
    out = []
    for _, g, s, i, j in options:
        if i not in used_g and j not in used_s:
            used_g.add(i)
            used_s.add(j)
            out.append((g, s))
    return out


def maximum(gold: list[str], said: list[str]) -> int:
    """The largest number of one-to-one pairs, by augmenting paths."""
    near = [[j for j, s in enumerate(said) if _layer(g, s) is not None] for g in gold]
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(gold)))


def _rowwise(f: Callable, kind: str) -> Callable[[str, str], Column]:
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for gold, said in batches:
            yield pd.Series([f([] if g is None else list(g), [] if s is None else list(s)) for g, s in zip(gold, said, strict=True)])

    return run


def fuzzy_pairs(gold: str, said: str) -> Column:
    return _rowwise(lambda g, s: [f"{a}={b}" for a, b in greedy(g, s)], "array<string>")(gold, said)


def maximum_pairs(gold: str, said: str) -> Column:
    return _rowwise(maximum, "int")(gold, said)
