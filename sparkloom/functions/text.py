"""Text: normal forms, keys, distances, spans and product-title features."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hangul


def _mapped(f: Callable, kind: str = "string") -> Callable[[Column | str], Column]:
    """An Arrow-batched function of one text column; nulls stay null (a struct of a null is that of no text). The UDF is made when the function is used, since
    workers import this module without a session."""

    def apply(text: Column | str) -> Column:
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([None if t is None else f(t) for t in texts], dtype=object)

        @F.pandas_udf(kind)
        def run_fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([f(t or "") for t in texts])

        return (run_fields if kind.startswith("struct") else run)(text)

    return apply


def _fold(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def _decomposed(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


folded = _mapped(_fold)
latin_key = _mapped(lambda t: re.sub("[^a-z0-9]", "", _decomposed(t).lower()))
alnum_key = _mapped(lambda t: "".join(c for c in _decomposed(t).casefold() if c.isalnum()))


def compact_key(text: Column | str) -> Column:
    """Lower case, digits, Latin letters and Hangul syllables only; for text that is in NFKC already."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]", "")


def jamo_text(t: str) -> str:
    """Syllables as their letters, each a code point of its own."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFC", t))


romanised = _mapped(hangul.romanised_text)
jamo = _mapped(jamo_text)


def phonetic_key(text: Column | str) -> Column:
    """A rough sound key: romanised, like sounds merged, vowels dropped, repeats squeezed."""
    return hangul.sound_key(romanised(text))


def bounded_levenshtein(a: Column | str, b: Column | str, cap: int) -> Column:
    """The distance up to ``cap``, cap + 1 beyond."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def ratio(a: str, b: str, autojunk: bool = True) -> Column:
    """Twice the matched characters over both lengths, matching blocks found longest first."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=autojunk).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def containment(a: Column, b: Column) -> Column:
    """The shorter length over the longer if one holds the other, else 0."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when((la > 0) & (lb > 0) & (F.contains(a, b) | F.contains(b, a)), F.least(la, lb) / F.greatest(la, lb)).otherwise(0.0)


def any_token(text: Column, tokens: str) -> Column:
    """True where the text holds one of the comma-separated tokens, or none is asked for."""
    return F.exists(F.split(F.col(tokens), ","), lambda t: (t == "") | F.contains(text, t))


def find_spans(text: str, surfaces: list[str]) -> list[tuple[int, int, str]]:
    """Longest surfaces first, no overlaps, whole words where a surface's end is an ASCII letter or digit."""
    taken = [False] * len(text)
    out = []
    for s in sorted(set(surfaces), key=lambda x: (-len(x), x)):
        edge = re.escape(s)
        if s[:1].isascii() and s[:1].isalnum():
            edge = r"(?<![A-Za-z0-9])" + edge
        if s[-1:].isascii() and s[-1:].isalnum():
            edge += r"(?![A-Za-z0-9])"
        for m in re.finditer(edge, text):
            if s and not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * len(s)
                out.append((m.start(), m.end(), s))
    return sorted(out)


_SPANS = "array<struct<begin:int,finish:int,surface:string>>"


def spans(text: str, surfaces: list[str]) -> Column:
    """``find_spans`` over a column; the lexicon's surfaces go with the function."""
    return _mapped(lambda t: [{"begin": a, "finish": b, "surface": s} for a, b, s in find_spans(t, surfaces)], _SPANS)(text)


def negated_spans(text: str, surfaces: list[str], cues: list[str], before: int = 20, after: int = 30) -> Column:
    """The surfaces that stand within reach of a cue: ``before`` characters after it or ``after`` before it."""

    def run(t: str) -> list[str]:
        places = [(m.start(), m.end()) for c in cues for m in re.finditer(re.escape(c), t)]
        return [s for a, b, s in find_spans(t, surfaces) if any(0 <= a - e <= before or 0 <= p - b <= after for p, e in places)]

    return _mapped(run, "array<string>")(text)


def last_rule(text: str, rules: list[tuple[str, str]], wins: str) -> Column:
    """The label of the rule that matches last in the text; ``wins`` takes a tie of positions."""

    def run(t: str) -> str | None:
        found = [(m.start(), label == wins, label) for pattern, label in rules for m in re.finditer(pattern, t)]
        return max(found)[2] if found else None

    return _mapped(run)(text)


def after_cue(text: str, cue: str, stop: str = r"[.,;!?\n]") -> Column:
    """What stands between every ``cue`` and the next stop, folded."""
    return _mapped(lambda t: [_fold(re.split(stop, x)[0]) for x in re.split(cue, t)[1:]], "array<string>")(text)


def particle_bounded(word: str, particles: list[str]) -> str:
    """A pattern for ``word`` followed by an end, a non-Hangul sign, or a particle that is itself followed by one."""
    edge = "(?:$|[^가-힣])"
    return rf"{re.escape(word)}(?={edge}|(?:{'|'.join(map(re.escape, particles))}){edge})"


def singulars(name: Column) -> Column:
    """The forms under which a name is looked up, in order: as it is, lower, without any word's last s, and of that with y for
    a last e, and with a y."""
    low = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "))
    one = F.trim(F.regexp_replace(low, r"s\b", ""))
    return F.array_distinct(F.array(name, low, one, F.concat(F.regexp_replace(one, "e$", ""), F.lit("y")), F.concat(one, F.lit("y"))))


def slipped(text: Column | str, kind: str, seed: int = 0) -> Column:
    """One slip of a kind of ``hangul.SLIPS`` in every text."""
    return _mapped(lambda t: hangul.slip(t, kind, seed))(text)


def typos(text: str, kind: str, seed: int = 0) -> Column:
    """One deterministic slip per text, its place drawn from a hash: a swap, a lost or a doubled letter, a lost space."""

    def run(t: str) -> str:
        spots = [i for i in range(len(t) - 1) if (t[i] == " ") == (kind == "space")]
        if not spots:
            return t
        i = spots[int.from_bytes(__import__("hashlib").md5(f"{seed}/{t}".encode()).digest()[:4], "big") % len(spots)]
        return {"swap": t[:i] + t[i + 1] + t[i] + t[i + 2 :], "lost": t[:i] + t[i + 1 :], "double": t[:i] + t[i] + t[i:], "space": t[:i] + t[i + 1 :]}[kind]

    return _mapped(run)(text)


# Product titles. Look-arounds are written out, since what a word boundary is depends on the engine.
#: Concentration labels, strongest first, with the forms they take.
CONCENTRATIONS = (("Extrait", "extrait(?: de parfum)?"), ("EDP", "eau de parfum|edp"), ("EDT", "eau de toilette|edt"), ("Cologne", "eau de cologne|edc|cologne"), ("Parfum", "parfum|perfume"))
_NOT_IN_WORD = ("(?<![a-z가-힣])(?:", ")(?![a-z가-힣])")


def concentrations(title: Column) -> Column:
    """All concentration labels of a title; a form that one label has used is gone for the next."""
    rest, found = F.lower(title), []
    for label, forms in CONCENTRATIONS:
        pattern = f"{_NOT_IN_WORD[0]}{forms}{_NOT_IN_WORD[1]}"
        found.append(F.when(rest.rlike(pattern), F.lit(label)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_compact(F.array(*found))


def volumes(title: Column) -> Column:
    """All volumes of a title in millilitres, ``30/50ml`` giving both."""
    groups = F.regexp_extract_all(F.lower(title), F.lit(r"((?:[0-9]+(?:\.[0-9]+)?/)*[0-9]+(?:\.[0-9]+)?) ?(?:ml|㎖)"), 1)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "/"))), lambda v: v.cast("double"))


def cleaned_name(title: Column, brand: Column) -> Column:
    """A title without brackets, volumes, counts, additions, form words and the brand, squeezed."""
    t = F.lower(title)
    for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", r"(?:[0-9.]+/)*[0-9.]+ ?(?:ml|㎖|g)(?![a-z])", r"[0-9]+ ?(?:ea|pcs|개)", r"\+.*$", "|".join(f"{_NOT_IN_WORD[0]}{f}{_NOT_IN_WORD[1]}" for _, f in CONCENTRATIONS)):
        t = F.regexp_replace(t, pattern, " ")
    t = F.replace(t, F.lower(brand), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^0-9a-z가-힣 ]", " "), " +", " "))


def normalised_with_provenance(title: str) -> Column:
    """A title's clean form, and what was taken off: noise and attributes."""

    def run(t: str) -> dict:
        noise = re.findall(r"\[[^\]]*\]|\+.*$", t)
        bare = re.sub(r"\[[^\]]*\]|\+.*$", " ", t)
        attributes = re.findall(r"(?i)(?:[0-9.]+/)*[0-9.]+ ?ml|eau de \w+|edp|edt", bare)
        bare = re.sub(r"(?i)(?:[0-9.]+/)*[0-9.]+ ?ml|eau de \w+|edp|edt", " ", bare)
        return {"clean": _fold(bare), "noise": [x.strip() for x in noise], "attributes": [_fold(x) for x in attributes]}

    return _mapped(run, "struct<clean:string,noise:array<string>,attributes:array<string>>")(title)
