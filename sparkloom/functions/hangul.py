"""Hangul: romanisation, sound keys, and slips of the kinds that typing and hearing make.

A syllable's code point is 0xAC00 + (initial * 21 + medial) * 28 + final.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin spellings of the initials, medials and finals, in the order of their code points.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
MEDIALS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("", "k", "k", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lp", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "h")
#: What a sound key takes for one another, in this order.
SOUNDS = (("ph", "f"), ("v", "b"), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("eo", "o"), ("ae", "e"), ("eu", ""), ("ui", "i"), ("w", ""), ("y", ""), ("r", "l"))
#: The letters of the three places, the rows of the keyboard, vowels and finals that sound alike.
LETTERS = ("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")
KEYBOARD = ("ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔ", "ㅁㄴㅇㄹㅎㅗㅓㅏㅣ", "ㅋㅌㅊㅍㅠㅜㅡ")
VOWELS_ALIKE = {"ㅐ": "ㅔ", "ㅔ": "ㅐ", "ㅓ": "ㅗ", "ㅗ": "ㅓ", "ㅚ": "ㅙㅞ", "ㅙ": "ㅚㅞ", "ㅞ": "ㅚㅙ"}
FINALS_ALIKE = ("ㄴㅇㅁ", "ㄱㅋㄲ", "ㅅㅆㄷㅌ")

SLIPS = ("keyboard", "vowel", "final", "space")


def places(c: str) -> tuple[int, int, int] | None:
    """The numbers of a syllable's initial, medial and final; none for another character."""
    i = ord(c) - 0xAC00
    return (i // 588, i % 588 // 28, i % 28) if 0 <= i < 11172 else None


def romanised_text(t: str) -> str:
    """Lower-case Latin letters and digits; what is neither these nor a syllable separates words."""
    out = []
    for c in unicodedata.normalize("NFKC", t).lower():
        p = places(c)
        out.append("".join(table[i] for table, i in zip((INITIALS, MEDIALS, FINALS), p, strict=True)) if p else c if c.isascii() and c.isalnum() else " ")
    return " ".join("".join(out).split())


def sound_key(romanised: Column) -> Column:
    """Of a romanised column: like sounds merged, vowels dropped, repeats squeezed."""
    k = romanised
    for a, b in SOUNDS:
        k = F.replace(k, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(k, "[^a-z0-9]|[aeiou]", ""), r"(.)\1+", "$1")


def _slipped(kind: str) -> dict[tuple[int, str], str]:
    """For a place (0 to 2) and its letter, the letters that one slip of this kind can put there."""
    out = {}
    if kind == "keyboard":
        for row in KEYBOARD:
            for i, c in enumerate(row):
                for place, known in enumerate(LETTERS):
                    out[place, c] = "".join(x for x in row[max(0, i - 1) : i] + row[i + 1 : i + 2] if x in known)
    elif kind == "vowel":
        out = {(1, c): x for c, x in VOWELS_ALIKE.items()}
    else:
        out = {(2, c): " " for c in LETTERS[2][1:]}  # a final can always get lost
        for group in FINALS_ALIKE:
            out |= {(2, c): " " + group.replace(c, "") for c in group}
    return out


_SLIPPED = {kind: _slipped(kind) for kind in SLIPS[:3]}


def slips(syllable: str, kind: str) -> list[str]:
    """All syllables that one slip makes of this one."""
    p = places(syllable)
    out = []
    for place, number in enumerate(p or ()):
        for c in _SLIPPED[kind].get((place, LETTERS[place][number]), ""):
            q = [*p]
            q[place] = LETTERS[place].index(c)
            out.append(chr(0xAC00 + (q[0] * 21 + q[1]) * 28 + q[2]))
    return out


def slip(text: str, kind: str, seed: int = 0) -> str:
    """The text with one slip, drawn by a hash of text, kind and seed; as it is where no such slip is possible.

    ``space`` loses a space or puts one into a word, next to or between syllables.
    """
    if kind == "space":
        made = [text[:i] + text[i + 1 :] for i, c in enumerate(text) if c == " " and i and places(text[i - 1])]
        made += [text[:i] + " " + text[i:] for i in range(1, len(text)) if places(text[i - 1]) and places(text[i])]
    else:
        made = [text[:i] + x + text[i + 1 :] for i, c in enumerate(text) for x in slips(c, kind)]
    if not made:
        return text
    return made[int.from_bytes(hashlib.md5(f"{seed}/{kind}/{text}".encode()).digest()[:6], "big") % len(made)]


def is_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")
