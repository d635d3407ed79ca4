"""URL rules as one bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical URL ``.host<SEP>path`` and every glob a run of bits. The runs of all
globs are packed into 64-bit words, and one extended Shift-And step per byte moves all patterns at once:
``D = ((D << 1) | starts) & B[byte] | D & S[byte]``, where ``B`` holds the positions that a byte may enter and ``S``
those where it may stay (the stars). A batch of URLs is simulated together, one byte position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between host and path of the canonical URL. Taken out of hosts and paths, so it stands there once.
SEP = "\x1f"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """A ``?``- and ``*``-free rule fits its host and all subdomains, and every path that starts with its own."""
        return f"*.{self.host}{SEP}{self.path}*"


#: The fixed rules of the contract's query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


class ShiftAnd:
    """All globs of a rule set, packed into multiword masks. ``*`` stands for any bytes on its side of SEP, ``?`` for one."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        bits = sum(len(t) + 1 for t in tokens)
        self.words = max(1, -(-bits // 64))
        enter, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for toks in tokens:
            # Bit ``at`` is the pattern's start state; bit ``at + i`` says that i tokens have been read.
            self._set(self.first, at)
            for i, (allowed, star) in enumerate([((), ())] + toks):
                for b in allowed:
                    self._set(enter[b], at + i)
                for b in star:
                    self._set(stay[b], at + i)
            at += len(toks)
            self.ends.append((at // 64, np.uint64(1 << (at % 64))))
            at += 1
        # The start state of a glob that begins with a star keeps itself.
        at = 0
        for g, toks in zip(globs, tokens, strict=True):
            if g.startswith("*"):
                for b in self._side():
                    self._set(stay[b], at)
            at += len(toks) + 1
        self.enter, self.stay = enter, stay

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    @staticmethod
    def _side() -> list[int]:
        """What a wildcard reads: any byte but SEP, so a host's star never reaches into the path."""
        return [b for b in range(256) if b != ord(SEP)]

    def _tokens(self, glob: str) -> list[tuple[list[int], list[int]]]:
        """One token per literal byte or ``?``: the bytes that enter it, and the bytes on which a star after it stays."""
        out: list[tuple[list[int], list[int]]] = []
        for c in glob:
            if c == "*":
                if out:
                    out[-1] = (out[-1][0], self._side())
            elif c == "?":
                out.append((self._side(), []))
            else:
                out += [([b], []) for b in c.encode()]
        return out

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean (url, glob): which globs fit which whole URLs. Memory: the batch's bytes plus one state per URL."""
        n = len(urls)
        out = np.zeros((n, len(self.ends)), bool)
        sizes = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1][order]
        live = sizes[order]
        state = np.tile(self.first, (n, 1))
        for i in range(int(live[0]) if n else 0):
            k = int(np.searchsorted(-live, -i))  # the first k URLs are longer than i
            d, byte = state[:k], flat[begin[:k] + i]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.enter[byte]) | (d & self.stay[byte])
        for j, (word, bit) in enumerate(self.ends):
            out[order, j] = (state[:, word] & bit) != 0
        return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule (null if none) and the verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
    ``#`` or the end. Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
    gets ``default``; of rules of equal length the first given wins; repeated rows are judged alike; an empty table
    gives an empty result. Other columns are left behind.
    """
    automaton = ShiftAnd([r.glob for r in rules])
    longest = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lower = {c: c + 32 for c in range(65, 91)}
        for pdf in batches:
            hosts, paths = [], []
            for url in pdf["_url"]:
                _, found, rest = url.partition("://") if url is not None else ("", "", "")
                end = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest)) if found else 0
                tail = rest[end:]
                stop = min((p for p in map(tail.find, "?#") if p >= 0), default=len(tail))
                hosts.append(rest[:end].translate(lower) if found else "")
                paths.append(tail[:stop] if found else "")
            clean = [f".{h.replace(SEP, '%1F')}{SEP}{p.replace(SEP, '%1F')}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths, strict=True)]
            hit = automaton.match(clean)
            best = np.full(len(clean), -1)
            for j in reversed(longest):
                best[hit[:, j]] = j
            yield pd.DataFrame({
                "_id": pdf["_id"], "host": hosts, "path": paths,
                "rule": [rules[j].text if j >= 0 else None for j in best],
                "verdict": [rules[j].action if j >= 0 else default for j in best],
            })

    # The id travels as text: pandas would turn whole numbers beside nulls into floats.
    slim = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(url_col).cast("string").alias("_url"))
    judged = slim.mapInPandas(run, "_id string, host string, path string, rule string, verdict string")
    return judged.select(F.col("_id").cast(pages.schema[id_col].dataType).alias(id_col), "host", "path", "rule", "verdict")
