"""Product titles: what they mention, and the identity that is left when promotion and attributes are taken off.

All patterns are those of the domain and read ASCII and Hangul; ``(?U)`` makes a word character what Unicode calls one.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _mapped

#: What a title can mention, by the name of its flag.
MENTIONS = {
    "hair_body_mention": r"헤어|바디|hair|body",
    "mist_mention": r"미스트|(?<![a-z])mist(?![a-z])",
    "home_mention": r"룸\s*(?:스프레이|&패브릭)|섬유\s*향수|디퓨저|캔들|샤쉐|사쉐|인센스",
    "care_accessory_mention": r"샤워젤|샤워시트|샴푸|핸드크림|바디밀크|로션|모이스처라이저|애프터쉐이브|공병",
    "solid_cream_stick_mention": r"고체|솔리드|퍼퓸\s*밤|크림\s*퍼퓸|퍼퓸\s*젤|퍼퓸\s*스틱",
    "oil_rollon_mention": r"오일\s*퍼퓸|롤\s*온|롤러볼",
    "intimate_mention": r"이너\s*퍼퓸|속옷\s*향수|Y존",
    "explicit_option": r"택\s*\d+|선택|골라",
    "planning_set": r"기획|세트|키트|(?<![a-z])(?:set|kit|pack)(?![a-z])|(?<![가-힣])듀오|트리오|\d+\s*\+\s*\d+|\d+\s*개입|ml\s*[x×*]\s*\d+",
    "gift_mention": r"증정|기프트|선물박스|선물포장|사은품|포함",
    "discovery_trial_mention": r"디스커버리|트라이얼|discovery|trial|expedition\s+set",
    "sample_mini_mention": r"디스커버리|트라이얼|discovery|trial|expedition\s+set|샘플|sample|시향|바이알|미니어[처쳐]",
    "refill_mention": r"(?<![가-힣])리필|(?<![a-z])refill(?![a-z])",
    "possible_unit_typo": r"\d+(?:\.\d+)?m(?![a-z])",
}
#: Concentrations, strongest first; forms, in the order in which they decide; words of promotion.
CONCENTRATIONS = {
    "EXTRAIT": r"extrait(?:\s+de\s+parfum)?|exdp|엑스트레(?:\s*드\s*퍼퓸)?",
    "EDP": r"edp|eau\s+de\s+parfum|오\s*드\s*(?:퍼퓸|빠르펭|파르펭)",
    "EDT": r"edt|eau\s+de\s+toilette|오\s*드\s*뚜왈렛",
    "EDC": r"edc|eau\s+de\s+cologne|오\s*드\s*코롱|코롱|cologne",
}
FORMS = {
    "HAIR_FRAGRANCE": r"헤어\s*(?:퍼퓸|미스트|향수)|hair\s+(?:perfume|mist|fragrance)",
    "BODY_FRAGRANCE": r"바디\s*(?:퍼퓸|미스트|향수)|body\s+(?:mist|perfume|fragrance)",
    "SOLID_FRAGRANCE": r"(?:고체|솔리드)\s*(?:퍼퓸|향수)?|solid\s+perfume",
    "BALM_OR_STICK": r"퍼퓸\s*(?:밤|스틱)|perfume\s+(?:balm|stick)",
    "ROLL_ON": r"롤온|roll[- ]on",
}
NO_FORM = "LIQUID_PERFUME"
GENERIC = "향수|퍼퓸|perfume"
PROMOTION = ("단독기획", "기획", "증정", "정품", "리뷰이벤트", "PICK", "특가", "본품", "택1", "택 1", "세트", "바이알", "미니어처", "무료배송", "공식", "단품", "랜덤", "리뉴얼출시", "스테디셀러", "올영1위", "포카", "컬래버", "패키지", "package", r"gift\s+set")
PROMOTED_GROUP = r"PICK|증정|기획|미니어처|무료|포카|택\s*1|gift|리뷰이벤트"
SIZE = r"(?<!\w)\d+(?:\.\d+)?\s*(?:ml|g|oz)(?![A-Za-z가-힣])"
COUNT = r"\d+\s*(?:종|개|pack)"


def mentions(title: Column) -> dict[str, Column]:
    """A flag's evidence: all places of the title that its pattern finds, in order; empty if it doesn't hold."""
    return {flag: F.regexp_extract_all(title, F.lit(f"(?i){pattern}"), 0) for flag, pattern in MENTIONS.items()}


def _word(pattern: str) -> str:
    return rf"(?iU)(?<!\w)(?:{pattern})(?!\w)"


def _groups() -> str:
    """A bracketed group that promotes or adds something."""
    kinds = (r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}")
    return "(?iU)" + "|".join(rf"{a}(?:(?=\s*\+)|(?=[^{b}]*(?:{PROMOTED_GROUP})))[^{b}]*{b}" for a, b in kinds)


_NOISE = (_groups(), r"\+.*$", f"(?iU){SIZE}", _word(COUNT), _word("|".join(sorted(PROMOTION, key=len, reverse=True))))
_composed = _mapped(lambda t: unicodedata.normalize("NFKC", t))


def identity(df: DataFrame, title: str, brand: str, into: str = "identity") -> DataFrame:
    """Adds a struct: identity_text (the title without noise and attributes), core_name (that without a leading brand),
    concentrations, product_form, noise and attributes (what was taken off, in the order of the steps), brand_prefix.

    Only whole spans go, never a part of a word. Noise: groups that promote or add, all after a plus, sizes, counts, words of
    promotion. Attributes: concentrations, forms, and generic words that stand alone. A null title is empty.
    """
    empty = F.array().cast("array<string>")

    def taken(text: Column, patterns) -> tuple[Column, Column]:
        """What the patterns take off, one after the other, and what is left. Texts are kept in columns of a struct."""
        off = empty
        for p in patterns:
            off, text = F.concat(off, F.regexp_extract_all(text, F.lit(p), 0)), F.regexp_replace(text, p, " ")
        return off, text

    df = df.withColumn("_t", _composed(F.coalesce(F.col(title), F.lit(""))))
    noise, bare = taken(F.col("_t"), _NOISE)
    df = df.withColumns({"_noise": noise, "_bare": bare})
    form = F.coalesce(*[F.when(F.col("_bare").rlike(_word(p)), name) for name, p in FORMS.items()], F.lit(NO_FORM))
    found, rest = [], F.col("_bare")
    for name, p in CONCENTRATIONS.items():
        found.append(F.when(rest.rlike(_word(p)), F.lit(name)))
        rest = F.regexp_replace(rest, _word(p), " ")
    attributes, rest = taken(F.col("_bare"), [_word(p) for p in (*CONCENTRATIONS.values(), *FORMS.values(), GENERIC)])
    rest = F.regexp_replace(F.regexp_replace(rest, r"[\[\](){}<>]", " "), r"(?U)\s+", " ")
    df = df.withColumns({"_form": form, "_found": F.array_compact(F.array(*found)), "_attributes": attributes, "_id": F.regexp_replace(rest, r"^[ ,;/+]+|[ ,;/+]+$", "")})
    # The brand is taken off where it leads as a whole word and leaves something.
    lead = F.char_length(brand)
    behind = F.substr("_id", lead + 1, F.char_length("_id"))
    prefix = F.concat(F.substr("_id", F.lit(1), lead), F.regexp_extract(behind, r"(?U)^[\s,:/-]*", 0))
    core = F.regexp_replace(behind, r"(?U)^[\s,:/-]*", "")
    leads = (F.coalesce(lead, F.lit(0)) > 0) & F.lower("_id").startswith(F.lower(brand)) & ~behind.rlike(r"(?U)^\w") & (core != "")
    fields = [F.col("_id").alias("identity_text"), F.when(leads, core).otherwise(F.col("_id")).alias("core_name"), F.col("_found").alias("concentrations"), F.col("_form").alias("product_form"),
              F.col("_noise").alias("noise"), F.col("_attributes").alias("attributes"), F.when(leads, prefix).otherwise("").alias("brand_prefix")]
    return df.withColumn(into, F.struct(*fields)).drop("_t", "_noise", "_bare", "_form", "_found", "_attributes", "_id")
