from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from conftest_texts import TEXTS

from sparkloom.llm import bpe, chat_format, decontaminate, pii, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_matches_the_library(odd, none):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    rows = bpe.tokenize(odd, VOCABULARY, public_tokenizers.PATTERN).collect()
    texts = dict(TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenize(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_words_go_on_over_several_queries(monkeypatch):
    monkeypatch.setattr(bpe, "_ROW_STEPS", 2000)
    coder = bpe.Bpe(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    texts = ["ab" * 400, "=" * 300 + "é" * 50, "<|endoftext|> it's"]
    ids = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_long_words_without_a_break():
    coder = bpe.Bpe(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(2)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = ["x" * 200_000, "ab" * 5000 + "aba", "日本語テキスト" * 500, "=" * 999, word("ab", 3000), word("abcdefghijklmnopqrstuvwxyz", 2000), word("abcXYZäß日本", 20_000), " ".join(word("etaoinshr", n) for n in range(30, 130))]
    for text in texts:
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_WORDS", 3)
    coder = bpe.Bpe(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in ["aa bb cc dd ee ff gg", "aa bb zz", "yy aa qqqq bb"]:
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == library.encode_ordinary(t)


CHATS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\<|end|>\\\\<|next|>"), (2, 0, "user", "a\\"), (2, 1, "user", "\n<|end|>\n"), (2, 2, "assistant", None), (2, 2, "assistant", ""), (2, 3, "assistant", "z"),
    (3, None, None, "no role"), (3, 1, "tool\nbox %", ""), (None, 0, "assistant", "lost"), (4, 0, "assistant", "<|start|>user\nhi\n<|end|>\n"), (5, 1, "user", "same"), (5, 1, "user", "same"),
]


def test_chats_read_back(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in CHATS], "conv_id long, turn long, role string, text string, segments string, formatted int")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(turns)).collect()}
    for conv in {r[0] for r in CHATS}:
        rows = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in CHATS if k == conv))
        told = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[conv]["n_turns"] == len(rows)
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_chats_merge_adjacent_roles(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(turns).first()
    assert row["formatted"] == "<|start|>user\na\n<|next|>\nb\n<|end|>\n<|start|>assistant\nc\n<|end|>\n"
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["c"]


def brute_leaks(docs, items, window=10):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    low = lambda t: find(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                for item in grams.get(tuple(w[k : k + n]), ()):
                    hit |= set(range(k, k + n))
                    found |= {str(item)} - {"None"}
        covered = {p for p in hit}
        out.append((i, len(w), len(covered), sorted(found), bool(hit)))
    return sorted(out, key=str)


LEAKS = [(1, "Zero ONE two-three, four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten"), (3, "ten nine eight"), (4, None), (5, "é É one"), (6, "one " * 40), (6, "one " * 40), (7, "two three four five six seven eight nine ten eleven twelve")]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, "Two three four five six seven eight nine ten eleven"), (3, "eight"), (4, ""), (5, None), (6, "one one"), (None, "é"), (7, "never said before"), (8, "eight")]


def test_decontamination_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in LEAKS], "doc_id long, text string, k1 int, pos int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(got, key=str) == brute_leaks(LEAKS, ITEMS)
    shuffled = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.decontaminate(docs, items, broadcast_rows=0).collect()]
    assert sorted(shuffled, key=str) == sorted(got, key=str)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontaminate.Index(docs, items, "doc_id", "text", 10, 100)
    near = index.proximity(slop=3).select("k1", "k2").distinct()
    assert {r["doc_id"] for r in index.docs.join(near, ["k1", "k2"]).collect()} == {1, 3}
    assert index.phrases().count() == 0
    found = decontaminate.decontaminate(docs, items, slop=3).collect()
    assert {r["doc_id"]: (r["n_near"], r["n_hit"]) for r in found} == {1: (1, 0), 2: (0, 0), 3: (1, 0)}


def brute_near(text, items, window, slop):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    low = lambda t: find(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(low(t)[k : k + window]) for t in items for k in range(max(1, len(low(t)) - window + 1) if low(t) else 0)}
    return low(text), grams, lambda w, g, rare: any(x == rare and all(any(w[j] == t for j in range(max(0, i - len(g) - slop), min(len(w), i + len(g) + slop + 1))) for t in set(g)) for i, x in enumerate(w))


def test_proximity_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"t{x}" for x in rng.zipf(1.6, 60) % 30)) for i in range(40)]
    items = [" ".join(f"t{x}" for x in rng.zipf(1.6, 14) % 30) for _ in range(8)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    counts = {}
    for _, t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    want = {}
    for i, t in rows:
        w, grams, near = brute_near(t, items, 10, 2)
        # the rarest term is the first of those with the fewest postings
        want[i] = sum(all(x in counts for x in g) and near(w, g, min(g, key=lambda x: (counts[x], g.index(x)))) for g in grams)
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.decontaminate(docs, bench, slop=2).collect()}
    assert got == want and 0 < sum(want.values())


PRIVATE = [
    (1, None), (2, ""), (3, "a@b.c_d@e.f x@y 1.2.3.4.5 300.1.2.3 001.2.3.0004 +1 (377) 555-0271 +12345678 4111 1111 1111 1111  4111-1111--1111 11112 é4111111111111111é 12.1.1.1@q.w"),
    (4, "é Bob Zork 34@mail7.example.com qqqq"), (5, "ü Ann Zork 34@mail7.example.com blah 1 2 3 4 5 6 7 8 9 0 1 2 3 45"), (6, "0 1 - 2 4242424242424242-"), (7, "9" * 3000 + " 4111111111111111.x@y..z a@b-.c %@1.2"), (7, "x"), (8, "x" * 60_000), (9, "1" * 60_000 + "+" * 1000),
]


def luhn(d):
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))] if "." in t else []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_pii_base_spans_and_terms(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in PRIVATE], "doc_id long, text string, k1 int, spans string")
    found = pii.detect(docs)
    got = pii.digests(found).collect()
    want = sorted(hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in brute_spans(t or "")).encode()).hexdigest() for _, t in PRIVATE)
    assert sorted(r["base_sha256"] for r in got) == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[4] == "email:11:31,term:6:10"  # Zork gives the address away in two texts; Bob and Ann do in one
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(docs.filter("doc_id in (4, 5)"), found).collect()}
    assert clean[4] == "é Bob  [EMAIL] qqqq"
    odd = docs.filter("doc_id in (1, 4, 5)").selectExpr("doc_id", "text", "1 as _k1", "2 as _K2", "3 as _spans", "4 as base", "5 as terms")
    again = pii.sanitise(odd, found)
    assert again.columns == [*odd.columns, "sanitised"]
    assert {r["doc_id"]: r["sanitised"] for r in again.collect()} == {1: "", 4: clean[4], 5: clean[5]}
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_copies_do_not_hide_terms(spark):
    texts = [t for t in ("said Bob Zork 34@mail7.example.com", "wrote Ann Zork 34@mail7.example.com") for _ in range(30)] + [f"filler {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(pii.detect(docs)).collect()}
    assert spans[0].endswith(",term:9:13") and spans[59].endswith(",term:10:14")


def test_pii_terms_anywhere_in_the_document(spark):
    far = " ".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    texts = [f"{s} Zork, born 1980, card 4111 1111 1111 1111 {far[:k]} ends with Zork" for s, k in (("Bob", 390), ("Ann", 380))] + [f"filler {far} {i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.detect(docs).collect()}
    for i in (0, 1):
        zork = [(m.start(), m.end()) for m in re.finditer("Zork", texts[i])]
        assert len(zork) == 2 and set(zork) <= {(t["start"], t["end"]) for t in found[i]}
    assert not any(found[i] for i in range(2, 302))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y", "http://a.example.org/en/12", "https://notexample.org/en/1", "x://com/fr/", "x://a.com/de/#f", "x://org", "x://org/", "x://a.org.evil/", "x://evil/.org\x1f/", "x://a.com/fr", "x://EXAMPLE.org:80/es/"] + ["x://a.com/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "x://org/", "", "")], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == ((best.text, best.action) if best else (None, "allow"))
    assert got[None]["rule"] == "org/"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_many_wildcard_patterns_span_words():
    globs = [f"*a{i}?*z" for i in range(40)] + ["", "*", "exact"]
    a = url_filter.ShiftAnd(globs)
    assert a.words > 3
    texts = [b"xa7--z", b"a39qz", b"a39z", b"", b"exact", b"exactly"]
    want = [[bool(re.fullmatch(re.escape(g).replace(r"\*", "(?s:.*)").replace(r"\?", "(?s:.)"), t.decode())) for g in globs] for t in texts]
    assert a.match(texts).tolist() == want
