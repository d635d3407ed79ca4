"""Personal data: base patterns, and terms that give the protected values away, in DataFrame operations only.

Base spans (email, ip, card, phone) are found by linear-time forms of their patterns. For the terms of their documents the
corpus says how much they reveal: with IC(e) = -ln P(e) the information of a protected value e and PMI(t; e) what a
term t tells about it, t discloses the share PMI / IC of e. A share of 1 means that whoever reads t knows e. Terms
above one threshold are generalised to their kind, above a higher one they are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, fits, row_key, unused

KINDS = ("email", "ip", "card", "phone")
# The leftmost match of email starts where a run of its characters does, or where the last match ended: \G. Together with
# possessive repetition this keeps long runs linear. Card: doubled separators are broken up first, see _card_text.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
# Base spans are overlaid with a character that no text has; a word that touches one is none.
_OVER = "\uffff"
_WORD = rf"(?<![\p{{L}}{_OVER}])\p{{L}}++(?!{_OVER})"
KEY = ["k1", "k2"]
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _card_text(text: Column) -> Column:
    """Every separator before another becomes a character that no pattern reads; lengths stay."""
    return F.regexp_replace(text, "[ -](?=[ -])", "\x00")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) + 1 - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.char_length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _places(values: Column, gaps: Column) -> Column:
    """All matches as structs of value, start and end, in order; positions in code points.

    A match's start is the length of all matches and gaps before it.
    """
    steps = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["v"].alias("value"), start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``spans`` for ``_text``: valid base spans in the order of KINDS, then start. Matches and gaps are columns of
    their own, so that each is computed once.
    """
    text = F.col("_text")
    for kind in KINDS:
        source = _card_text(text) if kind == "card" else text
        there = text.contains(_HINTS[kind]) if kind in _HINTS else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")
        df = df.withColumn(f"_v_{kind}", F.when(there, F.regexp_extract_all(source, F.lit(PATTERNS[kind]), 0)))
        df = df.withColumn(f"_g_{kind}", F.when(F.size(f"_v_{kind}") > 0, F.split(source, PATTERNS[kind], -1)))

    def of(kind: str) -> Column:
        found = F.transform(
            F.filter(_places(F.col(f"_v_{kind}"), F.col(f"_g_{kind}")), lambda s: _valid(kind, s["value"])),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
        )
        return F.when(F.size(f"_v_{kind}") > 0, found).otherwise(F.array().cast(_SPAN))

    return df.withColumn("spans", F.concat(*[of(k) for k in KINDS]))


def _overlaid(text: Column, spans: Column) -> Column:
    """The text with every base span overlaid; lengths stay."""

    def add(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substr(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(_OVER), s["end"] - begin))
        done = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(done)

    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(places, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.char_length(text))))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.8, remove: float = 0.95, min_texts: int = 2, shortest: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: id, k1, k2 (the row's key), base (array of kind, start, end, value), terms (array of start,
    end, share, act). Positions are code points, ends exclusive.

    A term is flagged with a value if ``min_texts`` different texts at least hold both, wherever they stand (copies of one
    text count once), and it discloses ``generalise`` of the value's information or more. Document frequencies of values, terms
    and both together are counted over all rows, copies included. Every occurrence of a flagged term outside base spans is marked in documents that
    hold the value. Defined cases: a null text is empty and has no span; repeated rows have equal spans; texts are whole, however
    long; an empty table gives an empty result. Other columns are left behind, whatever their names.
    """
    work = Workspace(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.hash(F.col(text_col), F.col(id_col)).alias("k2"), text.alias("_text"))
    spans = base_spans(keyed).select(id_col, *KEY, F.xxhash64("_text").alias("content"), "spans", F.when(F.size("spans") > 0, F.col("_text")).alias("_text"))
    spans = work.cut(spans, "base")
    n = float(spans.count())
    # Values and terms are the text's: what follows has each different text once, with its number of rows.
    held = spans.select("content", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).groupBy("content", "entity").agg(F.count("*").alias("copies"))
    held = work.cut(held, "held")
    known = held.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.count("*").alias("texts")).filter((F.col("texts") >= min_texts) & (F.col("df_entity") < n)).drop("texts")
    known = F.broadcast(known) if fits(known, broadcast_rows) else known
    held = work.cut(held.join(known, "entity"), "known")
    kept = held.select("content").distinct()
    kept = F.broadcast(kept) if fits(kept, broadcast_rows) else kept
    texts = spans.filter("_text is not null").join(kept, "content", "left_semi").groupBy("content").agg(F.first(F.struct("_text", "spans")).alias("t"))
    texts = work.cut(texts.select("content", _overlaid(F.col("t._text"), F.col("t.spans")).alias("_text")), "texts")
    said = keyed.select(F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("term"))
    words = texts.select("content", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(_WORD), 0), F.lower))).alias("term")).filter(F.char_length("term") >= shortest)
    words = work.cut(words, "words")
    terms = words.groupBy("term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select("term")
    terms = F.broadcast(terms) if fits(terms, broadcast_rows) else terms
    df_term = work.cut(said.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_term")), "terms")
    # A term in more rows than this can't have the share, even if it stands in all of the value's.
    most = F.pow(F.col("df_entity"), F.lit(generalise)) * F.pow(F.lit(n), F.lit(1 - generalise)) * 1.000001
    rare = df_term.join(held.agg(F.max(most).alias("most")), F.col("df_term") <= F.col("most")).drop("most")
    rare = F.broadcast(rare) if fits(rare, broadcast_rows) else rare
    met = words.join(rare, "term").join(held, "content").filter(F.col("df_term") <= most)
    pairs = met.groupBy("entity", "term", "df_entity", "df_term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    share = F.ln(F.col("both") * n / (F.col("df_entity") * F.col("df_term"))) / F.ln(n / F.col("df_entity"))
    flagged = pairs.withColumn("share", F.least(F.lit(1.0), share)).filter(F.col("share") >= generalise).select("entity", "term", "share")
    flagged = work.cut(flagged, "flagged")
    side = F.broadcast(flagged) if fits(flagged, broadcast_rows) else flagged
    told = work.cut(words.join(held.select("content", "entity"), "content").join(side, ["entity", "term"]).groupBy("content", "term").agg(F.max("share").alias("share")), "told")
    # Positions are running sums over a text's words.
    found = texts.join(told.select("content").distinct(), "content", "left_semi").select("content", F.regexp_extract_all("_text", F.lit(_WORD), 0).alias("v"), F.split("_text", _WORD, -1).alias("g"))
    found = found.select("content", F.posexplode(F.arrays_zip("v", F.slice("g", 1, F.size("v")).alias("g"))).alias("at", "w"))
    end = F.sum(F.char_length("w.g") + F.char_length("w.v")).over(Window.partitionBy("content").orderBy("at")).cast("int")
    found = found.select("content", F.lower("w.v").alias("term"), (end - F.char_length("w.v")).alias("start"), end.alias("end"))
    act = F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("act")
    marked = found.join(told, ["content", "term"]).groupBy("content").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share", act))).alias("terms"))
    marked = work.cut(marked, "marked")
    marked = F.broadcast(marked) if fits(marked, broadcast_rows // 50) else marked
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return spans.drop("_text").join(marked, "content", "left").select(
        id_col, *KEY, base.alias("base"), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,share:double,act:string>>")).alias("terms")
    )


def _entity(s: Column) -> Column:
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``sanitised``: base spans become their kind's tag, generalised terms ``[NAME]`` or ``[WORD]`` by their
    first letter's case, removed terms nothing. Where spans overlap, the one that starts first (the longer of two) counts.

    ``found``: what ``detect`` gives for these rows; rows that it doesn't name stay as they are. Defined cases: a null text becomes
    empty; repeated rows stay repeated; texts are whole, however long; columns may have any names but ``sanitised``, which is
    replaced; an empty table stays empty.
    """
    a, b, place = unused(docs, "_k1", "_k2", "_spans")
    one, two = row_key(docs[id_col], docs[text_col])
    keyed = docs.withColumns({a: one, b: two})
    spans = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), F.concat(F.lit("["), F.upper(b["kind"]), F.lit("]")).alias("tag"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), F.when(t["act"] == "remove", F.lit("")).otherwise(F.lit("[]")).alias("tag"))),
    ))
    side = found.select(F.col("k1").alias(a), F.col("k2").alias(b), spans.alias(place)).dropDuplicates([a, b])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def add(acc: Column, s: Column) -> Column:
        word = F.substr(text, s["start"] + 1, F.lit(1))
        tag = F.when(s["tag"] == "[]", F.when(F.upper(word) == word, F.lit("[NAME]")).otherwise(F.lit("[WORD]"))).otherwise(s["tag"])
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), tag)
        done = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(done)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.char_length(text)))
    joined = keyed.join(side, [a, b], "left")
    clean = F.when(F.size(place) > 0, F.aggregate(place, start, add, end)).otherwise(text)
    return joined.withColumn("sanitised", clean).drop(a, b, place)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the contract asks: counts by kind, the digest of the base spans, and all spans as text."""
    place = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: place(s["kind"], s))
    added = F.transform("terms", lambda s: place(F.lit("term"), s))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, KINDS), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"))
