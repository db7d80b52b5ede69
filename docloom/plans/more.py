"""Further queries: ignore files, gates, mirrors, reconciliation, names, trees, caches, reviews and node passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import headers, links
from docloom.functions import lines as ln
from docloom.functions import text as fn
from docloom.operators import bm25, ignore, mirrors, names, nodes, reconcile, review, rules, search, trees
from docloom.sources.tables import table

from .registry import _BM25, _states, query


@query(_BM25 + r""", qdocs AS (SELECT doc_id AS q FROM documents WHERE doc_id % 100 = 0),
q AS (SELECT doc_id AS q, term, tf AS qtf FROM post WHERE doc_id % 100 = 0),
part AS (SELECT q, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM q JOIN terms USING (term) JOIN post USING (term), corpus GROUP BY ALL),
scored AS (SELECT qdocs.q, d.doc_id, coalesce(s, 0.0) AS score FROM qdocs, documents d LEFT JOIN part ON part.q = qdocs.q AND part.doc_id = d.doc_id WHERE d.doc_id <> qdocs.q AND d.lang <> 'en')
SELECT doc_id_query, doc_id, score, rank FROM (SELECT q AS doc_id_query, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 3""")
def bm25_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches here: rows whose id is divisible by 100, against all."""
    docs = table(spark, d, "documents")
    return bm25.top_k(docs.where("doc_id % 100 = 0"), docs, 3, "doc_id", "text", pool=docs.where("lang <> 'en'"), itself=True)


@query(r"""WITH base AS (SELECT item_id AS doc_id, text FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM base),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corpus GROUP BY term, n),
terms AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
part AS (SELECT a.doc_id AS q, b.doc_id AS d, round(sum(a.tf * idf * b.tf * 2.5 / (b.tf + 1.5 * (0.25 + 0.75 * b.dl / avgdl))), 6) AS s FROM post a JOIN terms USING (term) JOIN post b USING (term), corpus GROUP BY ALL),
ranked AS (SELECT x.doc_id AS q, y.doc_id AS d, coalesce(s, 0.0) AS score, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(s, 0.0) DESC, y.doc_id) AS r FROM base x, base y LEFT JOIN part ON part.q = x.doc_id AND part.d = y.doc_id WHERE x.doc_id <> y.doc_id),
kept AS (SELECT *, row_number() OVER (PARTITION BY least(q, d), greatest(q, d) ORDER BY q) AS k FROM ranked WHERE r <= 5 AND score >= 1)
SELECT q AS a, d AS b, score FROM kept WHERE k = 1""")
def bm25_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k_pairs(table(spark, d, "benchmark"), 5, 1.0, "item_id", "text")


_ANCHORED = "SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no FROM documents) WHERE regexp_matches(line, '^[A-Z][^ ]* .*[.]$')"


@query(_ANCHORED)
def search_anchored(spark: SparkSession, d: str) -> DataFrame:
    return search.search_lines(table(spark, d, "documents"), "^[A-Z][^ ]* .*[.]$", per_document=None).select("doc_id", "line_no", "line")


_SHOWN = """WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no FROM documents),
hits AS (SELECT *, strpos(lower(line), 'license') - 1 AS s FROM lines WHERE regexp_matches(line, '(?i)license'))"""


@query(
    _SHOWN
    + """, marked AS (SELECT source || '/' || doc_id || '.md' AS path, line_no, source, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM hits)
SELECT path, line_no, CASE WHEN source = 'src1' THEN 'first' WHEN source = 'src2' THEN 'second' END AS mirror, CASE WHEN source = 'src1' THEN 'first/' || regexp_extract(path, '/(.*)', 1) WHEN source = 'src2' THEN 'second/' || regexp_extract(path, '/(.*)', 1) ELSE path END AS display_path FROM marked WHERE r <= 50"""
)
def search_with_mirrors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    found = search.search_lines(docs, "license", "path")
    roots = [{"path": "src1", "mirror_name": "first"}, {"path": "src2/", "mirror_name": "second"}]
    return search.with_metadata(found, docs, roots).select("path", "line_no", "mirror", "display_path")


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '^[^:]*://', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)de(/|$)') AND NOT regexp_matches(path, '^[^/]*net/de/[^/]+(/.*)?$') THEN true WHEN regexp_matches(path, '^[^/]*[.]com/') THEN true ELSE false END AS ignored FROM p"""
)
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[^:]*://", "").alias("path"))
    lines = ["# folders of one language", "de", "", "!/*net/de/*", "*.com/"]
    return pages.select("page_id", ignore.is_ignored(F.col("path"), lines).alias("ignored"))


@query(
    """SELECT CASE WHEN source IS NULL OR source = '' THEN 'unknown' WHEN lower(source) = 'src3' OR starts_with(lower(source), 'src1') THEN 'listed' END AS refused, count(*) AS n FROM documents GROUP BY 1"""
)
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(rules.gate(F.col("source"), ["SRC3", "Src1*", "*"]).alias("refused")).agg(F.count("*").alias("n"))


@query(
    """SELECT r_name AS system, n_name AS id, CASE WHEN n_regionkey = 3 THEN 'unidentified' WHEN n_regionkey = 2 THEN NULL WHEN n_name LIKE 'A%' AND n_regionkey IN (0, 4) THEN 'listed' WHEN n_name = 'BRAZIL' AND n_regionkey = 1 THEN 'listed' END AS refused
FROM (SELECT CASE n_regionkey WHEN 0 THEN 'confluence' WHEN 1 THEN 'sharepoint' WHEN 2 THEN 'none' WHEN 3 THEN 'other' ELSE 'confluence' END AS r_name, n_name, n_regionkey FROM nation)"""
)
def push_gates(spark: SparkSession, d: str) -> DataFrame:
    system = F.element_at(F.array(*map(F.lit, ["confluence", "sharepoint", "none", "other", "confluence"])), F.col("n_regionkey") + 1)
    source = F.struct(system.alias("system"), F.col("n_name").alias("id"))
    return table(spark, d, "nation").select(system.alias("system"), F.col("n_name").alias("id"), rules.push_gate(source, ["A*"], ["brazil"]).alias("refused"))


@query(
    """SELECT l_orderkey % 7 AS bucket, sum((NOT (l_quantity > 30 AND l_returnflag = 'N'))::INT)::BIGINT AS fresh, sum((l_quantity > 30 AND l_returnflag = 'N')::INT)::BIGINT AS stale FROM lineitem GROUP BY 1"""
)
def stale_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("bucket", F.col("l_orderkey") % 7)
    dated = F.when(F.col("l_returnflag") == "N", F.timestamp_seconds(1_000_000_000 - F.col("l_quantity").cast("long") * 86400))
    old, new = rules.partition_stale(rows, dated, F.timestamp_seconds(F.lit(1_000_000_000)), 30)
    both = old.select("bucket", F.lit(1).alias("old")).unionByName(new.select("bucket", F.lit(0).alias("old")))
    return both.groupBy("bucket").agg(F.sum((1 - F.col("old")).cast("long")).alias("fresh"), F.sum(F.col("old").cast("long")).alias("stale"))


@query(
    "SELECT o_orderkey, coalesce(o_orderstatus = CASE WHEN c_nationkey < 10 THEN 'O' ELSE 'F' END, false) AS hit FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def cache_hit_rows(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("sha"))
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") < 10, "O").otherwise("F").alias("sha"))
    return rules.cache_hits(wanted, stored, "key", ["sha"]).select("o_orderkey", "hit")


@query(
    """WITH gone AS (SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de'))
SELECT l.doc_id AS page_id, CASE WHEN l.quality = 1 THEN 'CROSS_SPACE_MOVE' ELSE 'DELETED' END AS kind, CASE WHEN l.quality = 1 THEN 'moved to space S' || toxic ELSE '' END AS note FROM labels l JOIN gone USING (doc_id)"""
)
def cross_space_events(spark: SparkSession, d: str) -> DataFrame:
    desired, current = _states(spark, d)
    desired = desired.join(table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")
    events = reconcile.page_events(desired, current).where("kind = 'DELETED'")
    everywhere = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("S"), F.col("toxic").cast("string")).alias("space_key"), F.lit("other").alias("space_id"))
    return reconcile.cross_space_moves(events, reconcile.moved_pages(events, everywhere, "here")).select("page_id", "kind", "note")


@query("SELECT n, count(*)::BIGINT AS events FROM (SELECT 'local-authored publish candidate' AS n FROM region UNION ALL SELECT '' FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))) GROUP BY 1")
def new_pages(spark: SparkSession, d: str) -> DataFrame:
    desired, current = _states(spark, d)
    events = reconcile.page_events(desired, current, untracked=table(spark, d, "region").select(F.col("r_name").alias("path")))
    return events.where("kind = 'NEW'").groupBy(F.col("note").alias("n")).agg(F.count("*").alias("events"))


@query(
    """SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents)) AS pages, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents) AND toxic = 0) AS current FROM labels"""
)
def state_after_run(spark: SparkSession, d: str) -> DataFrame:
    desired, current = _states(spark, d)
    state = reconcile.next_state(current, reconcile.page_events(desired, current), desired)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), "toxic")
    rows = state.join(labels, "page_id")
    return rows.agg(F.count("*").alias("pages"), F.count_if((F.col("toxic") == 0) & F.lower("status").isin("current")).alias("current"))


@query(
    """WITH p AS (SELECT p_partkey, 'f' || (p_size % 3) AS folder, p_name AS title FROM part), r AS (SELECT *, min(p_partkey) OVER (PARTITION BY folder, title) AS first FROM p)
SELECT p_partkey, folder || '/' || title || CASE WHEN p_partkey <> first OR title IN (SELECT p_name FROM part WHERE p_partkey <= 5) AND folder = 'f0' THEN ' (' || p_partkey || ')' ELSE '' END || '.md' AS new_path FROM r"""
)
def renamed_paths(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    pages = part.select("p_partkey", F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string")).alias("folder"), F.col("p_name").alias("title"), F.lit("old.md").alias("current_path"))
    used = part.where("p_partkey <= 5").select(F.concat(F.lit("f0/"), "p_name", F.lit(".md")).alias("path"))
    return names.renamed_paths(pages, used, "p_partkey").select("p_partkey", "new_path")


@query(
    """SELECT p_partkey, 'd/' || p_name || CASE WHEN p_partkey % 4 = 0 THEN '(' || p_partkey || ')' WHEN p_partkey % 4 = 1 THEN '(' || p_partkey || ')(2)' ELSE '' END || '.md' AS path FROM (SELECT p_partkey, p_brand || p_partkey AS p_name FROM part)"""
)
def disambiguated_paths(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("d/"), "p_brand", F.col("p_partkey").cast("string")).alias("stem"))
    path, kind = F.concat("stem", F.lit(".md")), F.col("p_partkey") % 4
    other = F.concat("stem", F.lit("("), F.col("p_partkey").cast("string"), F.lit(").md"))
    row = lambda p, owner, some: part.where(some).select(p.alias("path"), owner.alias("page_id"))
    nobody = F.lit(None).cast("long")
    taken = row(path, nobody, kind < 2).unionByName(row(other, F.lit(-1).cast("long"), kind == 1)).unionByName(row(path, F.col("p_partkey"), kind == 2))
    return names.disambiguated(part.select("p_partkey", path.alias("path")), taken, "path", "p_partkey")


@query(
    """SELECT c_custkey + 1000000 AS node_id, r_name AS parent_name, 2 AS height FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_custkey + 1000000, n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def page_ancestors(spark: SparkSession, d: str) -> DataFrame:
    tree = _regions(spark, d)
    named = tree.select(F.col("node_id").alias("ancestor_id"), F.col("title").alias("parent_name"))
    wanted = tree.where("node_id >= 1000000")
    return trees.ancestors(tree, wanted).join(named, "ancestor_id").select("node_id", "parent_name", "height")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("title"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("title"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("node_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("title"))
    return region.unionByName(nation).unionByName(customer)


@query(
    """SELECT row_number() OVER (ORDER BY r_name, n_name NULLS FIRST, c_name NULLS FIRST) AS place, node_id FROM (
SELECT r_name, NULL AS n_name, NULL AS c_name, r_regionkey::BIGINT AS node_id FROM region UNION ALL SELECT r_name, n_name, NULL, n_nationkey + 100 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, n_name, c_name, c_custkey + 1000000 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
)
def tree_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    paths = trees.page_paths(spark, _regions(spark, d))
    return paths.select(F.row_number().over(Window.orderBy("sort_key")).cast("long").alias("place"), "node_id")


@query(
    """SELECT p_partkey, 'https://git.test/' || replace(p_brand, '#', '') || '/repo/-/blob/main/' || replace(url_encode(p_name), '+', '%20') || '.md' AS url FROM part"""
)
def blob_urls(spark: SparkSession, d: str) -> DataFrame:
    clone = F.concat(F.lit("git@GIT.test:"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/repo.git"))
    url = fn.blob_url(clone, F.concat("p_name", F.lit(".md")), F.lit(None).cast("string"), "git.test")
    return table(spark, d, "part").select("p_partkey", url.alias("url"))


@query(
    """SELECT page_id, html LIKE '%<p>%' AS has, 'x' || chr(10) || '<p><sub><em>At <a href="' || replace(url, '&', '&amp;') || '">' || replace(url, '&', '&amp;') || '</a></em></sub></p>' AS body FROM pages"""
)
def footers(spark: SparkSession, d: str) -> DataFrame:
    once = headers.put_footer(F.lit("x"), F.lit("http://before"), "At")
    return table(spark, d, "pages").select("page_id", F.contains("html", F.lit("<p>")).alias("has"), headers.put_footer(once, F.col("url"), "At").alias("body"))


@query("SELECT page_id, 'confluence-page:' || replace(url_encode(url), '+', '%20') || ';space-key=S' AS uri, url AS target FROM pages")
def page_uris(spark: SparkSession, d: str) -> DataFrame:
    start = F.concat(F.lit("confluence-page:S/"), links.quote(F.col("url")))
    rows = table(spark, d, "pages").withColumn("ref", links.parse_uri(start))
    return rows.select("page_id", links.render_uri(F.col("ref")).alias("uri"), F.col("ref.target").alias("target"))


@query("SELECT item_id, text AS back, sha256('---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text) AS digest FROM benchmark")
def protected_texts(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit("---\na: 1\n---\n"), "text")
    rows = table(spark, d, "benchmark").select("item_id", "text", whole.alias("whole")).withColumn("p", ln.protect("whole"))
    back = ln.restore(F.col("p.text"), F.col("p.regions"))
    return rows.select("item_id", fm.body(back).alias("back"), fn.body_hash(back).alias("digest"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang AS kind FROM documents")
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _flat_nodes(spark, d)
    return nodes.assign_ids(rows).select(F.element_at("path", -1).alias("doc_id"), F.substring("node_id", 2, 9).cast("long").alias("n"), "kind")


def _flat_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A block for each document, in a tree for each source."""
    attrs = F.array(F.struct(F.lit("z").alias("k"), F.lit("1").alias("v")), F.struct(F.lit("colspan").alias("k"), F.lit("1").alias("v")), F.struct(F.col("lang").alias("k"), F.lit("x").alias("v")))
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("doc_id"), F.array("doc_id").alias("path"), F.lit("block").alias("tier"), F.lit("children").alias("slot"), F.col("lang").alias("kind"), F.lit("").alias("node_id"), "text", attrs.alias("attrs"), F.lit(False).alias("tight"))


@query("SELECT doc_id, lang || ',z' AS keys FROM documents")
def sorted_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes.sort_attrs(nodes.dedupe_attrs(_flat_nodes(spark, d)))
    return rows.select(F.element_at("path", -1).alias("doc_id"), F.array_join(F.transform("attrs", lambda a: a["k"]), ",").alias("keys"))


@query("SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS calls, count(*) FILTER (WHERE user_id % 2 = 1) AS cached_calls, count(*) * 2 AS prompt_tokens, sum(event_id)::BIGINT AS completion_tokens, 0.0::DOUBLE AS cost_usd FROM events")
def call_counts(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select((F.col("user_id") % 2 == 1).alias("cached"), F.lit(2).alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"), F.lit(None).cast("double").alias("cost_usd"))
    return review.run_counts(calls)


@query("SELECT quality, count(*) AS n, list_aggregate(list(doc_id::VARCHAR ORDER BY doc_id::VARCHAR), 'string_agg', ',') AS names FROM labels GROUP BY 1")
def pair_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("quality", F.col("doc_id").cast("string").alias("name"))
    return reconcile.pair_summary(rows, "quality").select("quality", "n", F.array_join("names", ",").alias("names"))


@query("""SELECT doc_id, CASE WHEN v = 3 THEN 'skip_size' WHEN v = 2 THEN 'keep' ELSE 'download' END AS action FROM (SELECT doc_id, CASE WHEN length(text) > 3000 THEN 3 WHEN lang = 'en' THEN 2 ELSE 1 END AS v FROM documents)""")
def attachment_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("f.png").alias("filename"), F.lit(2).alias("version"), F.length("text").alias("size"), F.lit(1).alias("ord"), "lang")
    older = docs.withColumns({"version": F.lit(1), "ord": F.lit(0), "size": F.lit(0)})
    manifest = docs.where("lang = 'en'").select("page_id", "filename", "version")
    return mirrors.attachment_plan(docs.drop("lang").unionByName(older.drop("lang")), manifest, 3000).select(F.col("page_id").alias("doc_id"), "action")


@query("SELECT item_id, text AS body, 'x' || chr(10) || text AS other FROM benchmark")
def stripped_headers(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit("\n> \n> **Confluence export** of a page\n> and more\n\n# Title #\n\n"), "text")
    body = headers.strip_title_heading(headers.strip_export_header(quoted), F.lit("Title"))
    return table(spark, d, "benchmark").select("item_id", body.alias("body"), headers.strip_export_header(F.concat(F.lit("x\n"), "text")).alias("other"))


@query("SELECT item_id, '2024-0' || (1 + item_id % 9) || '-05' AS day, '7' AS page, text AS body FROM benchmark")
def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    day = F.concat(F.lit("2024-0"), (1 + F.col("item_id") % 9).cast("string"), F.lit("-05"))
    whole = F.concat(F.lit("---\nupdated_at: '"), day, F.lit("'\nconfluence:\n  page_id: 7\n---\n"), "text")
    rows = table(spark, d, "benchmark").select("item_id", whole.alias("whole")).withColumn("fm", fm.frontmatter(F.col("whole")))
    return rows.select("item_id", fm.updated_at(F.col("whole"), F.col("fm")).cast("string").alias("day"), fm.page_id(F.col("fm")).alias("page"), fm.body(F.col("whole")).alias("body"))


@query("SELECT item_id, 'a b' || item_id || '.png,f.pdf' AS sources FROM benchmark")
def image_sources(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("![alt](a%20b"), F.col("item_id").cast("string"), F.lit('.png "t") `![no](x.png)` ![web](http://h/i.png)\n```\n![no](y.png)\n```\n[l](confluence-attachment:f.pdf;v=2) '), F.lower(F.regexp_replace("text", r"[^A-Za-z ]", "")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(links.local_images(text), ",").alias("sources"))


@query("SELECT item_id, 1::INT AS first, 3::INT AS last, true AS same FROM benchmark")
def frontmatter_lines(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit("---\nz: 1\n---\n"), "text")
    rows = table(spark, d, "benchmark").select("item_id", whole.alias("whole"), fm.line_range(whole).alias("r"))
    synced = fm.put_sync(F.col("whole"), F.lit('{"hash": "x"}'))
    same = fm.content_hash(synced) == fm.content_hash(fm.put_sync(F.col("whole"), F.lit('{"hash": "y"}')))
    return rows.select("item_id", F.col("r.start").alias("first"), F.col("r.end").alias("last"), same.alias("same"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Callout' ELSE 'BlockQuote' END AS kind, CASE WHEN lang = 'en' THEN 'note' END AS callout, CASE WHEN lang = 'en' THEN source ELSE '[!other] ' || source END AS text FROM documents")
def callout_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    none = F.array().cast("array<struct<k:string,v:string>>")
    mark = F.concat(F.when(F.col("lang") == "en", "[!NOTE]  ").otherwise("[!other] "), "source")
    row = lambda path, tier, kind, text: docs.select("doc_id", F.array(*[F.lit(p) for p in path]).alias("path"), F.lit(tier).alias("tier"), F.lit("children").alias("slot"), F.lit(kind).alias("kind"), F.lit("").alias("node_id"), text.alias("text"), none.alias("attrs"), F.lit(False).alias("tight"))
    nothing = F.lit(None).cast("string")
    tree = row([0], "block", "BlockQuote", nothing).unionByName(row([0, 0], "block", "Paragraph", nothing)).unionByName(row([0, 0, 0], "inline", "Text", mark))
    done = nodes.normalise(tree)
    texts = done.where("kind = 'Text'").select("doc_id", "text")
    return done.where("size(path) = 1").select("doc_id", "kind", F.col("text").alias("callout")).join(texts, "doc_id")
