from __future__ import annotations

import pytest

#: Texts that have broken something somewhere: null, empty, blank, repeated, very long, odd.
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "One  two three\nfour five SIX"), (6, "onetwothree four five six"), (None, "one two three four five six"),
    (7, "é Ä ß 日本 🙂 Straße"), (8, "word " * 30_000), (9, "x" * 50_000), (10, "A"), (11, "a"), (12, "mail bob@example.com or +1 (377) 555-0271, card 4111 1111 1111 1111, ip 10.0.0.1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A table with those texts and columns whose names an operator might use itself."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", True, 2, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash int, sha string, kept boolean, k1 int, _text string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
