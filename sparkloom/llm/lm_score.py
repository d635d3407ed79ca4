"""Cross-entropy difference: how much likelier a text's words are under a target model than under the whole corpus.

Two bigram models are matched in all but their data: the target model counts the wanted documents, the background
model all documents. They share one vocabulary, the corpus's words, and one smoothing; the background's counts are
scaled to the target's number of tokens, as a sample of its size would have on average. A document's score is its mean
loss per token under the target less that under the background: the lower, the more like the target.

Every word and word pair is counted under a 64-bit hash of its own. The rows are dealt into pieces of bounded size; a
piece sends its distinct keys, with its own counts, to the owners of the keys' ranges and gets the corpus's counts of
them back in the keys' order. So what is counted grows with the corpus and no task or driver holds the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, fits, give_back, small_batches

_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' tokens: the words' keys, whether one is its text's first, the keys of the other ones' pairs with the
    word before; and each text's number of tokens."""
    if len(_words) > 150_000:
        _words.clear()
    found = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(found)), np.uint64, int(n.sum()))
    first = np.zeros(len(h), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    at = np.flatnonzero(~first)
    with np.errstate(over="ignore"):
        pair = (h[at - 1] * _P ^ h[at]) * _P
        pair ^= pair >> np.uint64(32)
        pair *= _P
    return h, first, pair, n


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, the eight bytes of each laid out apart, so that the empty ones take no space."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Adds the row's piece: consecutive batches of one task, of ``most_bytes`` and a batch at most."""
    piece, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if size > most_bytes:
            piece, size = piece + 1, 0
        size += batch.nbytes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, piece, np.int64))], names=["id", "text", "wanted", "piece"])


def _add_up(owned: pa.Table) -> pa.Table:
    """One owner's counts over the corpus, given back to each piece in the order of its keys."""
    keys, target, every = ([_unpack(x) for x in owned[c].to_pylist()] for c in ("keys", "target", "every"))
    keys = [np.cumsum(k, dtype=np.uint64) for k in keys]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate(x).astype(np.float64), minlength=len(known)).astype(np.int64) for x in (target, every)]
    own = {}
    for piece, where in zip(owned["piece"].to_pylist(), np.split(at, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        # A piece that a reader has cut in two comes twice.
        own[piece] = np.union1d(own[piece], where) if piece in own else where
    rest = [0] * (len(own) - 1)
    return pa.table({
        "piece": pa.array(list(own), pa.int64()), "slot": pa.array([owned["slot"][0].as_py()] * len(own), pa.int32()),
        "target": pa.array([_pack(sums[0][i]) for i in own.values()], pa.binary()), "every": pa.array([_pack(sums[1][i]) for i in own.values()], pa.binary()),
        "n_keys": pa.array([len(known), *rest], pa.int64()), "n_target": pa.array([int(sums[0].sum()), *rest], pa.int64()), "n_every": pa.array([int(sums[1].sum()), *rest], pa.int64()),
    })


def _exact(flagged: DataFrame, kind: str, k: float = 8.0, owner_chars: int = 10_000_000) -> DataFrame:
    """Scores of (id, text, wanted) rows by counts of real n-grams. An owner of keys has about ``owner_chars`` of text."""
    work = Workspace(flagged.sparkSession, "lm")
    docs = work.cut(flagged.mapInArrow(_pieces, f"id {kind}, text string, wanted boolean, piece long"), "pieces")
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    pair_owners = max(8, -(-chars // owner_chars))
    owners = (-(-pair_owners // 8), pair_owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(piece: int, texts: list[str | None], wanted: list[bool]) -> pa.RecordBatch:
            word, first, pair, n = _grams(texts)
            want = np.repeat(np.array(wanted, bool), n)
            out = []
            for base, count, keys, w in ((0, owners[0], word, want), (owners[0], owners[1], pair, want[~first])):
                known, at = np.unique(keys, return_inverse=True)
                target, every = np.bincount(at[w], minlength=len(known)), np.bincount(at, minlength=len(known))
                edges = np.searchsorted((known >> np.uint64(32)) * np.uint64(count) >> np.uint64(32), np.arange(count + 1, dtype=np.uint64))
                for i in range(count):
                    part = slice(edges[i], edges[i + 1])
                    if edges[i] < edges[i + 1]:
                        out.append((piece, base + i, _pack(np.diff(known[part], prepend=np.uint64(0))), _pack(target[part]), _pack(every[part])))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["piece", "slot", "keys", "target", "every"])

        piece, texts, wanted = None, [], []
        for batch in batches:
            for p, t, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != piece and texts:
                    yield rows(piece, texts, wanted)
                    texts, wanted = [], []
                piece = p
                texts.append(t)
                wanted.append(w)
        if texts:
            yield rows(piece, texts, wanted)
        _words.clear()
        give_back()

    sent = docs.select("piece", "text", "wanted").mapInArrow(send, "piece long, slot int, keys binary, target binary, every binary")
    totals = work.cut(sent.groupBy("slot").applyInArrow(_add_up, "piece long, slot int, target binary, every binary, n_keys long, n_target long, n_every long"), "totals")
    said = totals.filter(F.col("slot") < owners[0]).agg(F.sum("n_keys"), F.sum("n_target"), F.sum("n_every")).first()
    words, tokens, every_token = (float(x or 0) for x in said)
    scale = tokens / max(1.0, every_token)

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        word, first, pair, n = _grams(rows["text"].to_pylist())
        counts = counts.sort_by("slot")
        slot = counts["slot"].to_numpy()
        ats = [np.unique(keys, return_inverse=True) for keys in (word, pair)]
        doc, means = np.repeat(np.arange(len(n)), n), []
        for side, f in (("target", 1.0), ("every", scale)):
            packed = counts[side].to_pylist()
            found = []
            for (known, at), mine in zip(ats, (slot < owners[0], slot >= owners[0]), strict=True):
                c = np.concatenate([np.zeros(0, np.uint64), *(_unpack(packed[i]) for i in np.flatnonzero(mine))])
                if len(c) != len(known):
                    raise ValueError(f"{len(c)} counts for {len(known)} keys of a piece")
                found.append(c[at] * f)
            single = (found[0] + 1) / (tokens + words)
            p, at = single.copy(), np.flatnonzero(~first)
            p[at] = (found[1] + k * single[at]) / (found[0][at - 1] + k)
            means.append(np.bincount(doc, weights=-np.log(p), minlength=len(n)) / np.maximum(n, 1))
        return pa.table({"id": rows["id"], "n_tokens": pa.array(n, pa.int64()), "target_loss": means[0], "background_loss": means[1], "difference": means[0] - means[1]})

    counts = totals.select(F.col("piece").alias("of"), "slot", "target", "every")
    return docs.select("id", "text", "piece").groupBy("piece").cogroup(counts.groupBy("of")).applyInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, difference double")


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per input row: id, n_tokens, target_loss, background_loss, difference (target less background).

    ``target_ids``: the ids (one column) of the rows that the target model counts. Defined cases: a null text counts as
    empty; a text without words has losses and difference 0; a null id is never in the target; repeated rows count as
    often as they stand there and score alike; without target rows both models are flat; texts are whole, however long; an
    empty table gives an empty result. Other columns are left behind, whatever their names. ``broadcast_rows`` bounds the
    ids broadcast; beyond it the join is shuffled.
    """
    small_batches(docs.sparkSession)
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_id")).dropna().distinct().withColumn("_wanted", F.lit(True))
    ids = F.broadcast(ids) if fits(ids, broadcast_rows) else ids
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    flagged = slim.join(ids, "_id", "left").select("_id", "_text", F.coalesce("_wanted", F.lit(False)).alias("_wanted"))
    return _exact(flagged, slim.schema["_id"].dataType.simpleString()).withColumnRenamed("id", id_col)
