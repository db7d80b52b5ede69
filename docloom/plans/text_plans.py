"""Queries on text functions: escapes, offsets, callouts, images, attributes, tables of contents, references, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import headers, links
from docloom.functions import lines as ln
from docloom.functions import text as fn
from docloom.operators import rules, search
from docloom.sources.tables import table

from .registry import query

_text = lambda name: F.col(name).cast("string")


@query(r"SELECT page_id, regexp_replace(url, '([!-/:-@\[-`{-~])', '\\\1', 'g') AS escaped FROM pages")
def escaped_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.escape_markdown(F.col("url")).alias("escaped"))


@query("SELECT conv_id, turn, text, len(list_filter(range(1, length(text) + 1), lambda i: strlen(left(text, (i - 1)::BIGINT)) < 7 * turn + 5))::INTEGER AS chars FROM (SELECT conv_id, turn, left(text, 80) || 'éß漢😀' || turn AS text FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL)")
def char_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text is not null and turn is not null")
    rows = rows.select("conv_id", "turn", F.concat(F.substring("text", 1, 80), F.lit("éß漢😀"), _text("turn")).alias("text"))
    return rows.select("conv_id", "turn", "text", fn.char_offset(F.col("text"), (7 * F.col("turn") + 5).cast("int")).alias("chars"))


@query("""WITH s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id + 0.5 WHEN 1 THEN page_id * 10.0 ELSE 100.0 END::DOUBLE AS width, CASE page_id % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 7.0 ELSE 100.0 END::DOUBLE AS height FROM pages)
SELECT page_id, width, height, round(CASE WHEN width * 3 > 4096 OR height * 3 > 4096 THEN least(4096 / width, 4096 / height) ELSE 3.0 END, 9) AS scale FROM s""")
def svg_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    svg = F.when(n % 3 == 0, F.concat(F.lit('<?xml?><svg a="b" width="'), _text("page_id"), F.lit('.5px" height=\'20\'><g/></svg>')))
    svg = svg.when(n % 3 == 1, F.concat(F.lit('<svg viewBox="0 0 '), _text("page_id"), F.lit('0 7"\n width="100%x">'))).otherwise(F.concat(F.lit("<svg><g width='"), _text("page_id"), F.lit("'/></svg>")))
    rows = table(spark, d, "pages").select("page_id", fn.svg_size(svg).alias("s")).select("page_id", "s.width", "s.height")
    return rows.withColumn("scale", F.round(fn.capped_scale(F.col("width"), F.col("height"), F.lit(3.0)), 9))


_CALLOUT = f"""'<p><sub><em>Download as <a href="' || replace(url, '&', '&amp;') || '">a &amp; ' || page_id || '</a>, <a href="u">' || page_id || '&lt;</a> {headers.GENERATED}</em></sub></p>'"""


@query(f"SELECT page_id, sha256({_CALLOUT} || CASE WHEN page_id % 2 = 0 THEN '' ELSE chr(10) END || html) AS put, sha256(html) AS stripped FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages WHERE url IS NOT NULL AND url NOT LIKE '%\"%')")
def office_callouts(spark: SparkSession, d: str) -> DataFrame:
    """Put once for odd pages and twice, with other links first, for even ones: the second takes the place of the first and of its line end."""
    rows = table(spark, d, "pages").where("url is not null and url not like '%\"%'").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    link = lambda url, name: F.struct(url.alias("url"), name.alias("name"))
    before = F.when(F.col("page_id") % 2 == 0, headers.put_callout(F.col("html"), F.array(link(F.lit("old"), F.lit("old"))))).otherwise(F.col("html"))
    both = F.array(link(F.col("url"), F.concat(F.lit("a & "), _text("page_id"))), link(F.lit("u"), F.concat(_text("page_id"), F.lit("<"))))
    put = headers.put_callout(before, both)
    return rows.select("page_id", fn.body_hash(put).alias("put"), fn.body_hash(headers.strip_callout(put)).alias("stripped"))


@query("""SELECT doc_id, '![a](dir/x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.svg' END || ' "t") and ![b](' || lang || '.svg) ![c](confluence-attachment:x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.svg' END || ')' AS body
FROM documents WHERE lang IS NOT NULL""")
def png_images(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lit("x"), _text("doc_id"))
    body = F.concat(F.lit("![a](dir/"), file, F.lit('.svg "t") and ![b]('), F.col("lang"), F.lit(".svg) ![c](confluence-attachment:"), file, F.lit(".svg)"))
    names = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.concat(file, F.lit(".svg")), F.concat(file, F.lit(".png")))).otherwise(F.create_map(F.lit("q.svg"), F.lit("q.png")))
    return table(spark, d, "documents").where("lang is not null").select("doc_id", links.svg_as_png(body, names).alias("body"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'two' ELSE lang END AS a, 'say "' || source || '" \\' AS bc, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 2 END::INTEGER AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def attribute_maps(spark: SparkSession, d: str) -> DataFrame:
    info = F.concat(F.lit('div {a="'), F.col("lang"), F.lit('" b:c="say \\"'), F.col("source"), F.lit('\\" \\\\"'), F.when(F.col("doc_id") % 3 == 0, ' a="two"').otherwise(""), F.lit(' 1x="no"} {z="late"}'))
    got = table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", fn.attributes(info).alias("m"))
    pick = lambda k: F.try_element_at("m", F.lit(k))
    return got.select("doc_id", pick("a").alias("a"), pick("b:c").alias("bc"), (F.size("m") - F.when(pick("x").isNotNull(), 1).otherwise(0)).alias("n"))


@query("""SELECT s_suppkey, '# Real ' || s_name || chr(10) || 'text 1' AS toc, CASE WHEN s_suppkey % 2 = 0 THEN 'intro' || chr(10) || '## Next' || chr(10) || s_name ELSE 'intro' || chr(10) || '## Kept ' || s_name || chr(10) || 'x' || chr(10) || '## Next' || chr(10) || s_name END AS sections,
'keep ' || s_name AS lines, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' | x' ELSE s_name || chr(10) || '| kept |' END AS body FROM supplier""")
def cleaned_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows, even = table(spark, d, "supplier"), F.col("s_suppkey") % 2 == 0
    real = F.concat(F.lit("# Real "), "s_name", F.lit("\ntext 1"))
    toc = F.when(even, F.concat(F.lit("## Table of  Contents\n\n1. One 3\n* Two 14\n\n2.1\tThree\t9\n"), real)).otherwise(real)
    title = F.when(even, F.lit("Meeting things 2020")).otherwise(F.concat(F.lit("Kept "), "s_name"))
    sections = F.concat(F.lit("intro\n## "), title, F.when(even, "\ngone\n### Deeper\ngone too\n").otherwise("\nx\n"), F.lit("## Next\n"), "s_name")
    lines = F.concat(F.lit("##\n- see [x\n####### deep\nkeep "), "s_name", F.when(even, "\n  * See [y").otherwise("\n#   "))
    third = F.col("s_suppkey") % 3 == 0
    body = F.when(third, F.concat(F.lit("| a |\n|---|\n \n\n"), "s_name", F.lit(" | x\n"))).otherwise(F.concat("s_name", F.lit("\n| kept |")))
    clean = ln.without_lines(fn.without_empty_headings(lines), (r"\s*[-*] (?i:see) \[",))
    return rows.select("s_suppkey", ln.without_toc(toc).alias("toc"), ln.without_sections(sections, r"meeting\s+things").alias("sections"), clean.alias("lines"), ln.without_leading_table(body).alias("body"))


@query("""SELECT p_partkey, 'a ![](' || p_name || '.png) b ' || CASE WHEN p_partkey % 2 = 0 THEN '<!-- image dropped -->' ELSE '![](two)' END || CASE WHEN p_partkey % 3 = 0 THEN ' c' || chr(10) || chr(10) || 'late' || chr(10) ELSE ' c' END AS body FROM part""")
def filled_images(spark: SparkSession, d: str) -> DataFrame:
    second = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("![](two)")
    own = F.array(F.concat(F.lit("![]("), "p_name", F.lit(".png)")), second)
    found = F.when(F.col("p_partkey") % 3 == 0, F.concat(own, F.array(F.lit(""), F.lit("late")))).otherwise(own)
    return table(spark, d, "part").select("p_partkey", ln.with_images(F.lit("a <!-- image --> b <!-- image --> c"), found).alias("body"))


@query("""SELECT c_custkey, 'a & é' || c_name || '&#x41;&#66;&nope; <' AS all_named, 'a &amp; é' || c_name || 'AB&nope; &lt;' AS safe FROM customer""")
def decoded_references(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a &amp; &eacute;"), "c_name", F.lit("&#x41;&#66;&nope; &lt;"))
    return table(spark, d, "customer").select("c_custkey", ln.decode_entities(text).alias("all_named"), ln.decode_safe_entities(text).alias("safe"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'a: ' || item_id || chr(10) || 'sharepoint:' || chr(10) || '  x: 1' WHEN 1 THEN 'b: 2' END AS yaml, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN '---' || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || text ELSE text END AS plain,
CASE item_id % 3 WHEN 0 THEN '---' || chr(10) || 'a: ' || item_id || chr(10) || '---' || chr(10) || 'new' WHEN 1 THEN '---' || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || 'new' ELSE 'new' END AS merged FROM benchmark""")
def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    whole = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("---\na: "), _text("item_id"), F.lit("\nsharepoint:\n  x: 1\n---\n"), "text")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("---\nb: 2\n---\n"), "text")).otherwise(F.col("text"))
    rows = table(spark, d, "benchmark").select("item_id", whole.alias("whole"))
    return rows.select("item_id", fn.split_frontmatter(F.col("whole"))["yaml"].alias("yaml"), fm.without_source_block(F.col("whole")).alias("plain"), fm.keep_other_keys(F.lit("new"), F.col("whole")).alias("merged"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no FROM documents)
SELECT doc_id, line_no, regexp_replace(line, '((?i)license|copyright)', '<\1>', 'g') AS marked, CASE WHEN length(line) <= 40 THEN line ELSE left(line, 39) || '…' END AS cut FROM lines WHERE regexp_matches(line, '(?i)license|copyright')"""
)
def highlighted_lines(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_lines(table(spark, d, "documents"), "license|copyright", per_document=None)
    none = F.array().cast(search.SPANS)
    marked = search.highlighted(F.col("line"), search.spans(F.col("line"), "(?i)license|copyright"), "<", ">")
    return found.select("doc_id", "line_no", marked.alias("marked"), search.truncated(F.col("line"), none, 40)["text"].alias("cut"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 100)::DOUBLE WHEN 1 THEN greatest(0.0, epoch(o_orderdate::TIMESTAMP) - epoch(TIMESTAMP '1995-06-01 00:00:00')) END::DOUBLE AS wait FROM orders""")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), (F.col("o_orderkey") % 100).cast("string"))).when(F.col("o_orderkey") % 3 == 1, date).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", fn.retry_after(header, F.lit("1995-06-01 00:00:00").cast("timestamp")).alias("wait"))


@query("""SELECT doc_id, CASE WHEN lang = source THEN lang || ',x' ELSE lang || ',' || source || ',x' END AS items, CASE WHEN lang = 'en' THEN 'k=en,m=' || source ELSE 'k=' || lang || ',' || lang || '=1,m=' || source END AS attrs, left(sha1(lang || source), 16) AS short, lower(hex(unhex(sha256(source)))) AS digest
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def joined_lists(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    fresh = F.array(pair(F.lit("k"), F.col("lang")))
    cached = F.array(pair(F.lit("k"), F.lit("old")), pair(F.col("lang"), F.lit("1")), pair(F.lit("skip"), F.lit("2")), pair(F.lit("m"), F.col("source")))
    filled = fn.fill_attributes(fresh, cached, F.array(F.lit("skip"), F.lit("en")))
    rows = table(spark, d, "documents").where("lang is not null and source is not null")
    return rows.select(
        "doc_id",
        F.array_join(fn.union_in_order(F.array("lang", "source"), F.array(F.col("source"), F.lit("x"))), ",").alias("items"),
        F.array_join(F.transform(filled, lambda a: F.concat(a["k"], F.lit("="), a["v"])), ",").alias("attrs"),
        fn.short_hash(F.concat("lang", "source")).alias("short"),
        F.lower(F.hex(fn.content_digest(F.col("source")))).alias("digest"),
    )


@query("""SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' - Documents' WHEN n_nationkey % 3 = 1 THEN '' ELSE ' - documents' END AS site,
CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN n_regionkey = 1 WHEN 2 THEN false END AS may FROM nation""")
def sites_and_rights(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " - Documents - Documents").when(F.col("n_nationkey") % 3 == 1, " - Documents").otherwise(" - documents"))
    user = F.concat(F.lit('{"update":{"restrictions":{"user":{"results":[{"accountId":"a'), _text("n_regionkey"), F.lit('"},{"accountId":"z"}]}}}}'))
    json = F.when(F.col("n_nationkey") % 4 == 0, "{}").when(F.col("n_nationkey") % 4 == 1, user).when(F.col("n_nationkey") % 4 == 2, '{"update":{"restrictions":{"group":{"results":[{"name":"g"}]}}}}').otherwise("not json")
    return table(spark, d, "nation").select("n_nationkey", fn.site_name(name).alias("site"), rules.can_update(json, F.lit("a1")).alias("may"))
