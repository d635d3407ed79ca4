"""Parsers of packed text cells into arrays and structs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_list(cell: Column | str, last_colon: bool = True) -> Column:
    """``name:number|name:number`` as an array of name and strength; parts without a number are dropped.

    A name may hold colons itself if the last one counts; else the first one does.
    """
    pattern = r"(?s)^(.*):([^:]*)$" if last_colon else r"(?s)^([^:]*):(.*)$"
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda p: F.struct(F.regexp_extract(p, pattern, 1).alias("name"), F.regexp_extract(p, pattern, 2).try_cast("double").alias("strength")))
    return F.filter(parts, lambda p: p["strength"].isNotNull() & (p["name"] != ""))


def by_strength(arr: Column | str) -> Column:
    """Strength descending, then name."""
    keyed = F.transform(arr, lambda x: F.struct((-x["strength"]).alias("k"), x["name"].alias("name"), x["strength"].alias("strength")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["name"].alias("name"), x["strength"].alias("strength")))


def last_wins(arr: Column | str) -> Column:
    """Of elements with one name, the last."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    later = lambda x, i: ~F.exists(F.slice(arr, i + 2, F.greatest(F.size(arr) - i - 1, F.lit(0))), lambda y: y["name"] == x["name"])
    return F.filter(arr, later)


def union_of(*cells: str) -> Column:
    """The distinct members of several arrays, in order; nulls are empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(F.col(c), empty) for c in cells]))


def repaired_split(cell: str, vocabulary: list[str]) -> Column:
    """Splits at '|' and joins neighbours again where that makes a name of the vocabulary that holds a '|' itself.

    Greedy from the left, longest first. ``vocabulary``: the few such names.
    """
    longest = max((n.count("|") for n in vocabulary), default=0) + 1
    known = set(vocabulary)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            out = []
            for text in cells:
                parts, names, i = (text or "").split("|"), [], 0
                while i < len(parts):
                    n = next((n for n in range(min(longest, len(parts) - i), 1, -1) if "|".join(parts[i : i + n]) in known), 1)
                    names.append("|".join(parts[i : i + n]))
                    i += n
                out.append([n for n in names if n])
            yield pd.Series(out)

    return run(cell)


def fenced_json(text: Column | str, schema: str) -> Column:
    """The first JSON object in a reply, with or without a code fence; null if there is none."""
    bare = F.regexp_replace(text, "```[a-zA-Z]*", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def profile(schema, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every leaf of a nested schema; ``[]`` marks an array's elements."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in profile(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return profile(schema.elementType, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return profile(schema.valueType, f"{prefix}{{}}")
    return [(prefix, schema.simpleString())]
