from __future__ import annotations

import re

import pytest

from sparkloom.functions import hangul, titles
from sparkloom.functions import text as tx
from sparkloom.operators import resolve
from sparkloom.plans import q_extra, registry


def test_all_finals_are_spelled():
    said = "".join(chr(0xAC00 + (0 * 21 + 0) * 28 + i) for i in range(28))
    assert hangul.romanised_text(said) == "".join("ga" + f for f in "- k k ks n nj nh t l lk lm lp ls lt lp lh m p ps t t ng t t k t p h".replace("-", "").split(" "))
    assert hangul.romanised_text("  한국 Chanel-No.5 ") == "hankuk chanel no 5".replace("hankuk", "hanguk")


def test_sound_keys(spark):
    rows = spark.createDataFrame([("빈 센트",), ("Vincent",), ("Phoebe",), ("Felix",), ("로즈",), ("Rose",), ("",)], "t string")
    got = [r[0] for r in rows.select(tx.phonetic_key("t")).collect()]
    assert got == ["bnsnt", "bnknt", "fb", "flks", "lj", "ls", ""]


@pytest.mark.parametrize("kind", hangul.SLIPS[:3])
def test_a_slip_changes_one_letter_to_one_that_is_near(kind):
    near = {
        "keyboard": lambda place, a, b: any(abs(row.find(a) - row.find(b)) == 1 for row in hangul.KEYBOARD if a in row and b in row),
        "vowel": lambda place, a, b: place == 1 and b in hangul.VOWELS_ALIKE.get(a, ""),
        "final": lambda place, a, b: place == 2 and (b == " " or any(a in g and b in g for g in hangul.FINALS_ALIKE)),
    }[kind]
    letters = lambda c: [table[i] for table, i in zip(hangul.LETTERS, hangul.places(c), strict=True)]
    for code in range(0xAC00, 0xAC00 + 11172, 7):
        a = letters(chr(code))
        made = hangul.slips(chr(code), kind)
        want = {(p, x) for p in range(3) for x in hangul.LETTERS[p] if x != a[p] and not (p == 2 and a[p] == " ") and near(p, a[p], x)}
        got = set()
        for m in made:
            b = letters(m)
            changed = [p for p in range(3) if a[p] != b[p]]
            assert len(changed) == 1
            got.add((changed[0], b[changed[0]]))
        assert got == want and len(made) == len(got)


def test_slips_of_space_and_of_nothing():
    assert hangul.slip("latin only", "keyboard") == "latin only" == hangul.slip("latin only", "space")
    assert hangul.slip("한 국", "space") == "한국"
    assert hangul.slip("한국", "space") == "한 국"
    assert hangul.slip("", "vowel") == ""


def test_typo_query_is_the_slip_of_every_row(spark, sf):
    rows = registry.queries()["txt36_typos"](spark, sf).collect()
    assert len(rows) == 4 * spark.read.parquet(f"{sf}/part.parquet").count()
    assert all(r["typed"] == hangul.slip(r["said"], r["kind"]) for r in rows)
    assert sum(r["typed"] != r["said"] for r in rows) > len(rows) / 2


def test_robustness_matches_brute_force(spark, sf):
    words = [(g, w) for g, ws in q_extra.CONDITIONS.items() for w in ws]
    want = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        grp, meant = words[r["p_partkey"] % len(words)]
        for kind in hangul.SLIPS:
            typed = hangul.slip(f"{meant}에 어울리는 향 {r['p_name']}", kind)
            want.setdefault((grp, kind), []).append(next((w for _, w in words if w in typed), "none") == meant)
    got = {(r["grp"], r["kind"]): (r["n"], r["accuracy"]) for r in registry.queries()["xtr38_typo_robustness"](spark, sf).collect()}
    assert got == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}


def test_mentions_match_python(spark, sf):
    rows = registry.queries()["txt27_mentions"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/part.parquet").count()
    for r in rows:
        for flag, pattern in titles.MENTIONS.items():
            assert r[flag] == len(re.findall(pattern, r["title"], re.I)), (flag, r["title"])
    assert {f for f in titles.MENTIONS if any(r[f] for r in rows)} >= {"hair_body_mention", "planning_set", "gift_mention", "refill_mention", "explicit_option"}


@pytest.mark.parametrize(("title", "brand", "core", "more"), [
    *[(f"{t} EDP 50ml (+ 바디로션 증정)", "", t, {"concentrations": ["EDP"], "product_form": "LIQUID_PERFUME"}) for t in ("Cool Cotton", "Warm Cotton", "Energy", "Flame", "Blooming Bouquet", "쿨 코튼", "웜 코튼", "에너지", "플레임", "블루밍 부케", "밤쉘", "보디가드")],
    ("미스 디올 EDT", "디올", "미스 디올", {"brand_prefix": ""}), ("디올 소바쥬 EDT", "디올", "소바쥬", {"brand_prefix": "디올 ", "identity_text": "디올 소바쥬"}), ("[블랑쉬] EDP", "", "블랑쉬", {"noise": []}), ("NEW YORK EDP", "", "NEW YORK", {}),
    (None, "x", "", {"concentrations": []}), ("디올", "디올", "디올", {"brand_prefix": ""}), ("헤어 퍼퓸 롤온", "", "", {"product_form": "HAIR_FRAGRANCE", "attributes": ["헤어 퍼퓸", "롤온"]}),
])
def test_identity_of_a_title(spark, title, brand, core, more):
    row = titles.identity(spark.createDataFrame([(title, brand)], "title string, brand string"), "title", "brand").first()["identity"]
    assert row["core_name"] == core
    assert {k: row[k] for k in more} == more


def test_channels(spark):
    rows = [(1, "로즈", "Rose", ""), (2, "Rose Noir", "Rose", ""), (3, "없는 이름", "Blanche", "Blanche"), (4, "", "Rose", None), (5, "Felix", "Phelix", "")]
    got = {r["left_id"]: r for r in resolve.scored(spark.createDataFrame(rows, "left_id long, name string, catalogue_name string, llm_name string")).collect()}
    assert got[2]["contains"] == 0.5 and got[2]["score"] == max(got[2][c] for c in resolve.CHANNELS)
    assert got[3]["llm_direct"] == got[3]["llm_contains"] == got[3]["score"] == 1.0
    assert [got[4][c] for c in resolve.CHANNELS] == [0.0] * 5
    assert got[5]["phonetic"] == 1.0 and got[5]["direct"] < 1
