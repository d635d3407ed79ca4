"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per Python worker.

Encoding: the distinct words of a batch that the worker has not met before become token-position rows (one byte token
each). A recursive query joins neighbouring rows with the merge table and contracts, in every word, the leftmost pair
of minimum rank, until no pair of any word is in the table. Of a long word a step goes on from the left to the pair's other
occurrences, which come next in any case, up to the first contraction that makes a pair of a lower rank. And it is cut
where two bytes meet that no token holds side by side: nothing is ever contracted across. Decoding: ids join the vocabulary and an ordered
aggregation concatenates the bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import give_back, small_batches

#: Row-steps one recursive query may keep; a longer word takes several queries, each from where the last one stopped.
_ROW_STEPS = 1_000_000
#: Words in each of the two generations of a worker's cache.
_CACHE_WORDS = 150_000

# ``place`` is the word's number and the position in it; ``todo`` counts the steps that are left, and -1 marks a word at its
# fixpoint, whose rows leave the recursion.
_CONTRACT = """
with recursive state(place, token, todo) as (
  select place, token, $most::integer from start
  union all
  select n.* from (
    with pair as (select place, token, todo, case when (lead(place) over w >> 32) = (place >> 32) then (token::bigint << 32) | lead(token) over w end as joint, lag(place) over w as before
                  from state where todo > 0 window w as (order by place)),
         best as (select (place >> 32) as word, min(m.ranked | (place & 4294967295)) as pick from pair join merges m on m.joint = pair.joint group by 1)
    select pair.place, case when (pair.place & 4294967295) = (pick & 4294967295) then (pick >> 32)::integer else pair.token end as token, case when pick is null then -1 else todo - 1 end as todo
    from pair left join best on (pair.place >> 32) = best.word
    where pick is null or pair.before is null or (pair.before >> 32) <> (pair.place >> 32) or (pair.before & 4294967295) <> (pick & 4294967295)) n)
select place, token, todo from state where todo <= 0 order by place
"""
# The same on rows that come in order, as they do in one thread: without a sort in each step. It fails where they don't.
_CONTRACT_IN_ORDER = _CONTRACT.replace("lag(place) over w as before", "case when lag(place) over () >= place then error('order') else lag(place) over () end as before").replace(" window w as (order by place)", "").replace("over w", "over ()")


#: Bytes from which a word's steps contract all occurrences of the pair.
_LONG = 48
# As above, for all of the pair's occurrences. Those that follow each other without a gap overlap, so every other one counts.
_CONTRACT_ALL = """
with recursive state(place, token, todo) as (
  select place, token, $most::integer from start
  union all
  select n.* from (
    with pair as (select place, place >> 32 as word, token::bigint as token, todo, row_number() over w as nth,
                         case when (lead(place) over w >> 32) = (place >> 32) then (token::bigint << 32) | lead(token) over w end as joint,
                         case when (lag(place) over w >> 32) = (place >> 32) then lag(token) over w end as before, case when (lead(place, 2) over w >> 32) = (place >> 32) then lead(token, 2) over w end as after
                  from state where todo > 0 window w as (order by place)),
         ranked as (select nth, word, before, after, m.ranked >> 32 as id, min(m.ranked >> 32) over (partition by word) as least from pair join merges m on m.joint = pair.joint),
         run as (select *, nth - row_number() over (order by nth) as run from ranked where id = least),
         turn as (select *, row_number() over (partition by run order by nth) as turn from run),
         next as (select *, case when lag(nth) over (partition by word order by nth) = nth - 2 then id else before end as left_of from turn where turn % 2 = 1),
         made as (select next.*, coalesce(l.ranked >> 32 < id, false) or coalesce(r.ranked >> 32 < id, false) as lower
                  from next left join merges l on l.joint = (left_of::bigint << 32) | id left join merges r on r.joint = (id << 32) | after),
         pick as (select nth, id from (select nth, id, min(nth) filter (lower) over (partition by word) as last from made) where last is null or nth <= last),
         busy as (select distinct word from run)
    select pair.place, coalesce(pick.id, pair.token)::integer as token, case when busy.word is null then -1 else todo - 1 end as todo
    from pair left join pick on pick.nth = pair.nth left join pick gone on gone.nth = pair.nth - 1 left join busy on busy.word = pair.word
    where gone.nth is null) n)
select place, token, todo from state where todo <= 0 order by place
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file's ranks; a rank is also the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    """A worker's tables and cache. Pairs merge by the rank of what they form, as in the tiktoken library."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks = ranks
        merges = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.merges = pa.table([pa.array(c, pa.int64()) for c in zip(*merges, strict=True)] if merges else [pa.array([], pa.int64())] * 3, names=["l", "r", "id"])
        self.beside = np.zeros(1 << 16, bool)  # pairs of bytes that some token holds side by side
        held = np.frombuffer(b"".join(b + b"\0" for b in ranks), np.uint8).astype(np.int64)
        inside = np.ones(len(held), bool)
        inside[np.cumsum([len(b) + 1 for b in ranks]) - 1] = False
        self.beside[(held[:-1] << 8 | held[1:])[inside[:-1] & inside[1:]]] = True
        self.vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks]})  # a character for each byte
        self.db = None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rest(self) -> None:
        """Between tasks: the database goes, and of the cache all but the words that both halves hold, which are those that
        come again and again. So an idle worker is small."""
        self.known = {w: ids for w, ids in self.known.items() if w in self.older}
        self.older = {}
        if self.db is not None:
            self.db.close()
            self.db = None

    def _open(self) -> duckdb.DuckDBPyConnection:
        if self.db is None:
            self.db = duckdb.connect()
            self.db.execute("set threads = 1")
            self.db.execute("set memory_limit = '200MB'")
            self.db.execute("set temp_directory = ''")
            self.db.register("own_merges", self.merges)
            self.db.register("own_vocab", self.vocab)
            self.db.execute("create table merges as select (l << 32) | r as joint, id << 32 as ranked from own_merges")
            self.db.execute("create table vocab as from own_vocab")
        return self.db

    def _query(self, words: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, out: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """Contracts words given as one array of tokens; fills in the ids of those that are done and returns the rest."""
        db = self._open()
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        db.register("start", pa.table({"place": pa.array(np.repeat(words << 32, sizes) | pos), "token": pa.array(tokens)}))
        # Ordinary words end long before; only very long ones need another query, and, from some 60,000 tokens on, more memory.
        sql, least = (_CONTRACT_ALL, 2) if sizes.min() >= _LONG else (_CONTRACT_IN_ORDER, 64)
        if least == 2 and len(tokens) > _ROW_STEPS // 16:
            db.execute(f"set memory_limit = '{200 + len(tokens) // 800}MB'")
        most = {"most": max(least, _ROW_STEPS // len(tokens))}
        try:
            found = db.sql(sql, params=most).to_arrow_table()
        except duckdb.InvalidInputException:
            if sql is not _CONTRACT_IN_ORDER:
                raise
            found = db.sql(_CONTRACT, params=most).to_arrow_table()
        db.unregister("start")
        left, word = [], found["place"].to_numpy() >> 32
        flat, todo = found["token"].to_numpy().astype("<u4"), found["todo"].to_numpy()
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        raw, ends = flat.tobytes(), [*begin[1:].tolist(), len(flat)]
        for word, more, a, b in zip(word[begin].tolist(), (todo[begin] == 0).tolist(), begin.tolist(), ends, strict=True):
            if more:
                left.append((word, flat[a:b].astype(np.int32)))
            else:
                out[word] = raw[4 * a : 4 * b]
        return left

    def _cut(self, word: bytes) -> list[bytes]:
        """A long word's parts that no contraction crosses; a shorter word as it is."""
        if len(word) < _LONG:
            return [word]
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        ends = [*(np.flatnonzero(~self.beside[b[:-1] << 8 | b[1:]]) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _contract(self, raw: list[bytes]) -> list[bytes]:
        """Every word's ids at its fixpoint."""
        parts = [self._cut(w) for w in raw] if max(map(len, raw), default=0) >= _LONG else None
        flat = raw if parts is None else [p for x in parts for p in x]
        out, begin = [b""] * len(flat), 0
        order = sorted(range(len(flat)), key=lambda i: len(flat[i]) >= _LONG)  # long parts in queries of their own
        long = sum(len(p) >= _LONG for p in flat)
        while begin < len(order):
            end, rows = begin, 0
            most, room = (len(order) - long, _ROW_STEPS // 8) if begin < len(order) - long else (len(order), _ROW_STEPS // 64)
            while end < most and (end == begin or rows + len(flat[order[end]]) <= room):
                rows += len(flat[order[end]])
                end += 1
            words = order[begin:end]
            sizes = np.fromiter((len(flat[i]) for i in words), np.int64, len(words))
            left = self._query(np.array(words), sizes, self.byte[np.frombuffer(b"".join([flat[i] for i in words]), np.uint8)], out)
            while left:
                word, tokens = left.pop()
                left += self._query(np.array([word]), np.array([len(tokens)]), tokens, out)
            begin = end
        if parts is None:
            return out
        ids = iter(out)
        return [b"".join(next(ids) for _ in x) for x in parts]

    def learn(self, words: set[str]) -> None:
        """Encodes the words that the cache doesn't hold. Its older half goes when the newer one is full."""
        new = words - self.known.keys()
        back = new & self.older.keys()
        if len(self.known) + len(new) > _CACHE_WORDS:
            self.older, self.known = self.known, {}
            new, back = words, words & self.older.keys()
        self.known.update((w, self.older[w]) for w in back)
        new = list(new - back) if back else list(new)
        raw = [w.encode("utf-8", "replace") for w in new]
        # A word that is a token itself is that token, whatever its merges would give.
        whole = list(map(self.ranks.get, raw))
        parts = [i for i, r in enumerate(whole) if r is None]
        self.known.update(zip([new[i] for i in parts], self._contract([raw[i] for i in parts]), strict=True))
        self.known.update((w, r.to_bytes(4, "little")) for w, r in zip(new, whole, strict=True) if r is not None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        db = self._open()
        db.register("rows", pa.table({"text": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "id": flat}))
        out = [b""] * len(ids)
        found = db.sql("select text, string_agg(bytes, '' order by pos) as said from rows join vocab using (id) group by text").to_arrow_table()
        for text, said in zip(found["text"].to_pylist(), found["said"].to_pylist(), strict=True):
            out[text] = said.encode("latin-1")
        db.unregister("rows")
        return out


_workers: dict[tuple, Bpe] = {}
_sent: dict[tuple, object] = {}


def _ranks_of(spark: SparkSession, path: str) -> object:
    """A vocabulary's ranks, sent to an application's executors once."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        _sent.clear()
        _sent[key] = spark.sparkContext.broadcast(read_ranks(path))
    return _sent[key]


def worker(ranks: dict[bytes, int], pattern: str, name: tuple) -> Bpe:
    """This process's tables; a Python worker serves many tasks."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = Bpe(ranks, pattern)
    return _workers[name]


def _pieces(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row, in its place: id, n_tokens, ids_sha256, decoded_sha256, round_trip, and with
    ``with_ids`` also token_ids (array<int>).

    ``vocabulary``: path of a ``.tiktoken`` rank file that the driver can read; its content (a few MB whatever the
    corpus) goes to the executors. Special tokens' strings are ordinary text. Defined cases: a null text is empty and has no
    tokens; repeated rows give repeated rows; texts are whole and worked on one by one where they are long; an empty table gives
    an empty result. Other columns are left behind, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = _ranks_of(spark, vocabulary)
    name = (vocabulary, pattern)
    schema = pa.schema([("_id", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())] + ([("token_ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(ranks.value, pattern, name)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _pieces(texts):
                ids = bpe.encode(texts[a:b])
                back = bpe.decode(ids)
                cols = [
                    pa.array(keys[a:b], pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([x == t.encode("utf-8", "replace") for x, t in zip(back, texts[a:b], strict=True)]),
                ]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        bpe.rest()
        give_back()

    slim = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ddl = "_id string, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", token_ids array<int>" if with_ids else "")
    out = slim.mapInArrow(run, ddl)
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c != "_id"])
