"""Sources: JSON lines, CSV, HAR captures, HTML and Markdown, always with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the byte-order mark that some CSV files start with.
BOM = "﻿"


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, a broken one keeps its text in ``_corrupt_record``."""
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*given.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_lines_with(spark: SparkSession, path: str, needle: str, schema: str) -> DataFrame:
    """Parses only the lines that contain ``needle``: the text filter runs before the JSON parser."""
    return spark.read.text(path).filter(F.col("value").contains(needle)).select(F.from_json("value", schema).alias("r")).select("r.*")


def csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, empty cells as empty text, any BOM taken off the first header; gzip by extension."""
    df = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    return df.select(*columns) if columns else df


def har_entries(spark: SparkSession, path: str) -> DataFrame:
    """A browser capture's entries in order: method, url, host, path, status, mime type and decoded body."""
    body = "struct<mimeType:string,text:string,encoding:string>"
    schema = f"log struct<entries:array<struct<request:struct<method:string,url:string>,response:struct<status:int,content:{body}>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("log.entries").alias("entry", "e"))
    text = F.col("e.response.content.text")
    decoded = F.when(F.col("e.response.content.encoding") == "base64", F.unbase64(text).cast("string")).otherwise(text)
    url = F.col("e.request.url")
    return e.select("entry", F.col("e.request.method").alias("method"), url.alias("url"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"),
                    F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"), decoded.alias("body"))


def route(entries: DataFrame, endpoints: dict[str, tuple[str | None, str]]) -> DataFrame:
    """Names the entries that succeeded and fit an endpoint's (host, path prefix); without a host any will do."""
    name = None
    for key, (host, prefix) in endpoints.items():
        fits = (F.lit(True) if host is None else F.col("host") == host) & F.col("path").startswith(prefix) & (F.col("method") == "GET") & (F.col("status") == 200)
        name = F.when(fits, key) if name is None else name.when(fits, key)
    return entries.withColumn("endpoint", name).filter("endpoint is not null")


class _Cards(HTMLParser):
    """Collects the text and link of every element of one tag: a small state machine over the page's events."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.cards, self.depth, self.skip = tag, [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == self.tag:
            self.depth += 1
            if self.depth == 1:
                self.cards.append({"text": "", "href": None})
        if tag == "a" and self.depth and self.cards[-1]["href"] is None:
            self.cards[-1]["href"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == self.tag:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.cards[-1]["text"] += data


def html_cards(html: str, tag: str = "li") -> Column:
    """The outermost ``tag`` elements of a page as an array of text and first link."""

    @F.pandas_udf("array<struct<text:string,href:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out = []
            for page in pages:
                parser = _Cards(tag)
                parser.feed(page or "")
                out.append([{"text": " ".join(c["text"].split()), "href": c["href"]} for c in parser.cards])
            yield pd.Series(out)

    return run(html)


def script_json(html: Column | str, element: str, schema: str) -> Column:
    """The JSON inside the script block of an id."""
    return F.from_json(F.regexp_extract(html, rf'(?s)<script id="{element}"[^>]*>(.*?)</script>', 1), schema)


def tree_path(nodes: DataFrame, depth: int) -> DataFrame:
    """(id, path): names from the root down, for a tree of (id, parent, name) no deeper than ``depth``."""
    level = nodes.filter("parent is null").select("id", F.col("name").alias("path"))
    out = level
    for _ in range(depth - 1):
        level = nodes.join(level.select(F.col("id").alias("parent"), "path"), "parent").select("id", F.concat_ws("/", "path", "name").alias("path"))
        out = out.unionByName(level)
    return out


def page_contract(pages: DataFrame) -> DataFrame:
    """(page, size, offset, total, items) captures: one row per item with its rank, and whether the page's numbers agree."""
    ok = (F.col("offset") == F.col("page") * F.col("size")) & (F.size("items") <= F.col("size"))
    return pages.select("page", ok.alias("agrees"), "offset", F.posexplode("items").alias("pos", "item")).select("page", "agrees", (F.col("offset") + F.col("pos") + 1).alias("rank"), "item")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """(doc, line, text) lines: table rows with their cells and the heading they stand under."""
    head = F.when(F.col("text").rlike("^#+ "), F.regexp_replace("text", "^#+ +", ""))
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("heading", F.last(head, ignorenulls=True).over(w)).filter(F.col("text").rlike(r"^\|") & ~F.col("text").rlike(r"^\|[\s:|-]+$"))
    cells = F.transform(F.split(F.regexp_replace("text", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select("doc", "line", "heading", cells.alias("cells"))


def lexicon(entries: DataFrame) -> DataFrame:
    """(surface, expression): an expression and its '|'-joined aliases as surfaces, each once."""
    alias = F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: a != "")
    return entries.select("expression", F.explode(F.array_union(F.array("expression"), alias)).alias("surface")).distinct()
