"""Readers, sinks and streams on small files."""

from __future__ import annotations

import base64
import gzip
import json

from pyspark.sql import functions as F

from sparkloom.sources import readers, sinks
from sparkloom.streaming import events


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "tags": ["x"]}\n\n{"id": 2}\nbroken\n')
    rows = readers.json_lines(spark, str(p), "id long, tags array<string>").collect()
    assert [(r["id"], r["tags"]) for r in rows] == [(1, ["x"]), (2, None), (None, None)]
    assert rows[2]["_corrupt_record"] == "broken"
    assert [r["id"] for r in readers.json_lines_with(spark, str(p), '"tags"', "id long").collect()] == [1]


def test_csv_with_mark_and_gzip(spark, tmp_path):
    text = "﻿id,name\n1,NA\n2,\n3,\"a, \"\"b\"\"\"\n"
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    with gzip.open(tmp_path / "b.csv.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        df = readers.csv_text(spark, str(tmp_path / name))
        assert df.columns == ["id", "name"]
        assert [r["name"] or "" for r in df.orderBy("id").collect()] == ["NA", "", 'a, "b"']


def test_har_routing(spark, tmp_path):
    body = base64.b64encode("héllo".encode()).decode()
    entry = lambda url, status=200, **c: {"request": {"method": "GET", "url": url}, "response": {"status": status, "content": {"mimeType": "text/html", **c}}}
    har = {"log": {"entries": [entry("https://a.com/list?page=1", text=body, encoding="base64"), entry("https://a.com/list", 404, text="x"), entry("https://b.com/", text="y")]}}
    (tmp_path / "x.har").write_text(json.dumps(har))
    rows = readers.route(readers.har_entries(spark, str(tmp_path / "x.har")), {"list": ("a.com", "/list")}).collect()
    assert [(r["entry"], r["endpoint"], r["body"]) for r in rows] == [(0, "list", "héllo")]


def test_html_cards_and_script(spark):
    html = '<ul><li><a href="/x">A &amp; <b>B</b></a><script>no</script></li><li>C<li>nested</li></li></ul>'
    row = spark.createDataFrame([(html,), (None,)], "h string").select(readers.html_cards("h").alias("c")).collect()
    assert [(c["text"], c["href"]) for c in row[0]["c"]] == [("A & B", "/x"), ("Cnested", None)]
    assert row[1]["c"] == []


def test_markdown(spark):
    lines = ["# One", "| a | b |", "|---|---|", "| 1 | 2 |", "text", "## Two", "| 3 | 4 |"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, line int, text string")
    assert [(r["heading"], r["cells"]) for r in readers.markdown_rows(df).orderBy("line").collect()] == [("One", ["a", "b"]), ("One", ["1", "2"]), ("Two", ["3", "4"])]


def test_page_contract(spark):
    df = spark.createDataFrame([(0, 2, 0, ["a", "b"]), (1, 2, 3, ["c"])], "page int, size int, offset int, items array<string>")
    assert [(r["agrees"], r["rank"], r["item"]) for r in readers.page_contract(df).orderBy("rank").collect()] == [(True, 1, "a"), (True, 2, "b"), (False, 4, "c")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b "q"'), (1, "ä")], "id int, name string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {(r["id"], r["name"]) for r in readers.csv_text(spark, str(tmp_path / "csv")).collect()} == {("2", 'b "q"'), ("1", "ä")}
    sinks.write_document(df, str(tmp_path / "doc"), "id")
    assert json.loads(next((tmp_path / "doc").glob("part-*")).read_text()) == [{"id": 1, "name": "ä"}, {"id": 2, "name": 'b "q"'}]
    digest = sinks.manifest(spark, str(tmp_path / "csv")).filter(F.col("path").contains("part-")).first()
    assert digest["length"] > 0 and len(digest["sha256"]) == 64


def test_resume(spark, tmp_path):
    todo, path = spark.range(10), str(tmp_path / "done")
    assert sinks.append_missing(spark, todo.filter("id < 4"), "id", path, lambda d: d) == 4
    assert sinks.append_missing(spark, todo, "id", path, lambda d: d) == 6
    assert sinks.append_missing(spark, todo, "id", path, lambda d: d) == 0


def test_streams(spark, tmp_path):
    src, cache = tmp_path / "log", tmp_path / "cache"
    rows = spark.createDataFrame([(f"2024-01-01 0{i % 3}:10:00", f"k{i % 2}", i) for i in range(12)], "t string, key string, n int").select(F.to_timestamp("t").alias("ts"), "key", "n")
    rows.repartition(3).write.parquet(str(src))
    log = lambda: readers_log(spark, src)
    q = events.window_counts(log(), "key").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 12 and spark.table("counts").count() == 6
    events.keep_cache(log(), str(cache), "key", str(tmp_path / "c1")).awaitTermination(60)
    events.keep_cache(log(), str(cache), "key", str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(r["key"] for r in spark.read.parquet(str(cache)).collect()) == ["k0", "k1"]


def readers_log(spark, path):
    return events.read_log(spark, str(path), "ts timestamp, key string, n int", 1)
