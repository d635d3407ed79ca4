"""Scans, sources and sinks. Files are written from the tables to a scratch folder and read through the readers; what no file
holds (a page's HTML) is parsed from its column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.runs import run_lengths
from ..sources import readers, scratch, sinks
from .catalogue import twin
from .q_windows import _RUNS
from .registry import query


@query("src01_json_lines", "select p_partkey as id, p_name as name, [p_brand, p_type] as tags, p_size as size from part")
def _(c):
    path = scratch.folder(c.spark, "src01")
    c.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tags"), F.col("p_size").alias("size")).write.json(path)
    return readers.json_lines(c.spark, path, "id long, name string, tags array<string>, size int").filter("_corrupt_record is null").drop("_corrupt_record")


@query("src02_json_prefilter", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where contains(props, '7')")
def _(c):
    path = scratch.folder(c.spark, "src02")
    c.table("events").select(F.to_json(F.struct("event_id", "props")).alias("value")).write.text(path)
    found = readers.json_lines_with(c.spark, path, "7", "event_id long, props string")  # the id may hold a 7 too
    return found.filter(F.col("props").contains("7")).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src03_csv_subset", "select p_partkey, p_size from part")
def _(c):
    path = scratch.folder(c.spark, "src03")
    sinks.write_csv(c.table("part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    return readers.csv_text(c.spark, path, ["p_partkey", "p_size"]).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))


@query("src04_csv_no_na", "select p_partkey, case when p_size % 5 = 0 then '' when p_size % 5 = 1 then 'NA' else 'x' end as cell from part")
def _(c):
    path = scratch.folder(c.spark, "src04")
    cell = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "NA").otherwise("x")
    sinks.write_csv(c.table("part").select("p_partkey", cell.alias("cell")), path, bom=True)
    return readers.csv_text(c.spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "cell")


@query("src07_har_routing", "select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, case when regexp_matches(url, '://[^/]*/en/') then 'english' else 'french' end as endpoint, length(html) as body_chars from pages where regexp_matches(url, '://[^/]*/(en|fr)/')")
def _(c):
    """Captures of 500 requests a file; a capture's MIME type carries the page's id."""
    path = scratch.folder(c.spark, "src07")
    content = F.struct(F.concat(F.lit("text/html;id="), "page_id").alias("mimeType"), F.base64(F.encode("html", "UTF-8")).alias("text"), F.lit("base64").alias("encoding"))
    entry = F.struct(F.struct(F.lit("GET").alias("method"), "url").alias("request"), F.struct(F.lit(200).alias("status"), content.alias("content")).alias("response"))
    files = c.table("pages").groupBy(F.floor(F.col("page_id") / 500).alias("file")).agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("log"))).alias("value"))
    files.write.partitionBy("file").text(path)
    found = readers.route(readers.har_entries(c.spark, path), {"english": (None, "/en/"), "french": (None, "/fr/")})
    return found.select(F.regexp_extract("mime", "id=(.*)", 1).cast("long").alias("page_id"), "host", "endpoint", F.char_length("body").alias("body_chars"))


@query("src08_html_cards", "select page_id, (length(split_part(html, '</nav>', 1)) - length(replace(split_part(html, '</nav>', 1), '<li>', ''))) // 4 as cards from pages")
def _(c):
    nav = F.split_part("html", F.lit("</nav>"), F.lit(1))
    return c.table("pages").withColumn("nav", nav).select("page_id", F.size(readers.html_cards("nav")).cast("long").alias("cards"))


@query("src09_script_json", "select page_id, url from pages")
def _(c):
    doc = F.concat(F.lit('<html><script id="__DATA__" type="application/json">'), F.to_json(F.struct("page_id", "url")), F.lit("</script></html>"))
    return c.table("pages").select(doc.alias("html")).select(readers.script_json("html", "__DATA__", "page_id long, url string").alias("r")).select("r.*")


@query("src10_tree_path", "select n_nationkey as id, r_name || '/' || n_name as path from nation join region on r_regionkey = n_regionkey union all select -1 - r_regionkey, r_name from region")
def _(c):
    roots = c.table("region").select((-1 - F.col("r_regionkey")).alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    leaves = c.table("nation").select(F.col("n_nationkey").alias("id"), (-1 - F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    return readers.tree_path(roots.unionByName(leaves), 2)


@query("src11_pagination", "with p as (select l_returnflag, l_orderkey // 100 as page, row_number() over (partition by l_orderkey // 100, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem where l_returnflag = 'R') select page, page * 100 + pos as rank from p")
def _(c):
    rows = c.table("lineitem").filter("l_returnflag = 'R'").withColumn("page", F.floor(F.col("l_orderkey") / 100).cast("long"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("l_orderkey")).alias("items")).withColumn("size", F.lit(100)).withColumn("offset", F.col("page") * 100)
    return readers.page_contract(pages).select("page", "rank")


@query("src12_markdown_documents", "select p_brand as heading, p_partkey, p_name from part")
def _(c):
    """All parts, in documents of at most a thousand: below each brand's heading and a table's rule, a row for each of its parts."""
    p = c.table("part").select(F.floor(F.col("p_partkey") / 1000).alias("doc"), "p_brand", "p_partkey", "p_name")

    def line(df, at, text):
        return df.select("doc", F.struct("p_brand", at.alias("at")).alias("line"), text.alias("text"))

    rows = line(p, F.col("p_partkey").cast("long"), F.concat(F.lit("| "), "p_partkey", F.lit(" | "), "p_name", F.lit(" |")))
    heads = p.select("doc", "p_brand").distinct()
    above = line(heads, F.lit(-2).cast("long"), F.concat(F.lit("## "), "p_brand")).unionByName(line(heads, F.lit(-1).cast("long"), F.lit("|---|:--|")))
    return readers.markdown_rows(above.unionByName(rows)).select("heading", F.col("cells")[0].cast("long").alias("p_partkey"), F.col("cells")[1].alias("p_name"))


@query("src14_embeddings", "select vec_id, len(embedding) as dims, round(embedding[1]::double, 5) as first from embeddings")
def _(c):
    return c.table("embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("src15_lexicon", "select distinct p_name as expression, unnest(list_distinct([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) as surface from part")
def _(c):
    return readers.lexicon(c.table("part").select(F.col("p_name").alias("expression"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("aliases")))


@query("snk02_json_document", "select count(*) as n, sum(r_regionkey)::bigint as keys from region")
def _(c):
    path = scratch.folder(c.spark, "snk02")
    sinks.write_document(c.table("region").select("r_regionkey", "r_name"), path, "r_regionkey")
    one = c.spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<r_regionkey:int,r_name:string>>").alias("a"))
    return one.select(F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["r_regionkey"]).alias("keys"))


@query("snk01_csv_with_mark", "select c_custkey, c_name, c_acctbal, cast(1 as bigint) as marked from customer")
def _(c):
    path = scratch.folder(c.spark, "snk01")
    sinks.write_csv(c.table("customer").select("c_custkey", "c_name", "c_acctbal"), path, bom=True)
    files = c.spark.read.format("binaryFile").load(path).agg(F.min((F.hex(F.substring("content", 1, 3)) == "EFBBBF") & ~F.contains(F.col("content"), F.lit(b"\r"))).cast("long").alias("marked"))
    rows = readers.csv_text(c.spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return rows.crossJoin(F.broadcast(files))  # one row


@query("snk03_resume", "select o_orderkey from orders where o_orderstatus <> 'F'")
def _(c):
    o = c.table("orders").select("o_orderkey", "o_orderstatus")
    return sinks.resume(o, o.filter("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")


@query("snk04_bridge_tables", twin("feat", "select item, row_number() over (partition by item order by strength desc, feature) as rank, feature as name, strength as weight from feat"))
def _(c):
    nested = c.feat.groupBy("item").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("k"), "feature", "strength"))).alias("features"))
    return sinks.bridge(nested, "item", "features", {"feature": "name", "strength": "weight"})


@query("snk06_manifest", "select n_nationkey, length(n_name || ' of region ' || n_regionkey) + 1 as length, sha256(n_name || ' of region ' || n_regionkey || chr(10)) as sha256 from nation")
def _(c):
    """A file for each nation, known by its folder."""
    path = scratch.folder(c.spark, "snk06")
    c.table("nation").select("n_nationkey", F.concat("n_name", F.lit(" of region "), "n_regionkey").alias("value")).write.partitionBy("n_nationkey").option("lineSep", "\n").text(path)
    return sinks.manifest(c.spark, path).select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "length", "sha256")


@query("snk07_rle", _RUNS.replace("select l_orderkey, run, min(l_returnflag) as flag, count(*) as n from g group by 1, 2", ", r as (select l_orderkey, run, min(l_returnflag) as flag, count(*) as n from g group by 1, 2) select l_orderkey, string_agg(flag || n, '' order by run) as rle from r group by 1"))
def _(c):
    runs = run_lengths(c.table("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")
    ordered = F.array_sort(F.collect_list(F.struct("run", F.concat("value", "n").alias("code"))))
    return runs.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["code"]), "").alias("rle"))


@query("src05_gzip_capture", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as source_rank from part")
def _(c):
    path = scratch.folder(c.spark, "src05")
    sinks.write_csv(c.table("part").select("p_partkey", "p_brand", "p_retailprice"), path, compression="gzip")
    rows = readers.csv_text(c.spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return ranking.row_rank(rows, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], "source_rank").select("p_partkey", "source_rank")
