"""Queries by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import bm25, mirrors, names, reconcile, rules, search, trees
from docloom.sources.tables import table
from docloom.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "search_lines"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents),
hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines WHERE regexp_matches(line, '(?i)license')),
capped AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '(?i)license'))::BIGINT AS n_matches FROM hits WHERE r <= 50)"""


@query(f"WITH {_LINES} SELECT doc_id, line_no, line, n_matches FROM capped")
def search_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.search_lines(table(spark, d, "documents"), "license")


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sum(n_matches)::BIGINT AS n_matches, min(line_no) AS first_line FROM capped GROUP BY 1")
def search_grouped(spark: SparkSession, d: str) -> DataFrame:
    return search.group_matches(search.search_lines(table(spark, d, "documents"), "license"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, line, n_matches FROM capped ORDER BY 1, 2 LIMIT 100")
def search_truncated(spark: SparkSession, d: str) -> DataFrame:
    return search.total_limit(search.search_lines(table(spark, d, "documents"), "license"), 100)


@query(
    """SELECT conv_id, turn, role, line_no, line FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM conversations)
WHERE regexp_matches(line, 'Thtion')"""
)
def search_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn", "role"))
    found = search.search_lines(rows, "Thtion", key="key", per_document=None)
    return found.select("key.*", "line_no", "line")


_BM25 = r"""WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
raw AS MATERIALIZED (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corpus GROUP BY term, n),
terms AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


@query(
    _BM25
    + r""", q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN terms USING (term) JOIN post USING (term), corpus GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(
    r"""WITH df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents) GROUP BY term),
raw AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, (SELECT count(*) AS n FROM documents)),
mean AS (SELECT avg(idf) AS m FROM raw)
SELECT term, round(CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END, 9) AS idf FROM raw, mean"""
)
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    return bm25.terms(table(spark, d, "documents")).select("term", F.round("idf", 9).alias("idf"))


@query("SELECT sha256(text) AS body_hash, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", fn.body_hash(F.col("text")).alias("body_hash"))
    return docs.groupBy("body_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")).where("n_docs > 1")


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    desired = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("title"), F.col("source").alias("parent_id"), F.lit("current").alias("status"), F.col("n_chars").alias("version"), F.array("lang", "source").alias("labels"))
    current = labels.select(
        F.col("doc_id").alias("page_id"),
        F.lit("en").alias("title"),
        F.when(F.col("quality") == 1, "src1").otherwise("src2").alias("parent_id"),
        F.when(F.col("toxic") == 1, "archived").otherwise("Current").alias("status"),
        F.lit(2000).cast("long").alias("version"),
        F.array(F.lit("src1"), F.lit("en")).alias("labels"),
        (F.col("quality") == 0).alias("attachments_skipped"),
    )
    return desired, current


_EVENTS = """WITH s AS (SELECT coalesce(documents.doc_id, labels.doc_id) AS page_id, documents.doc_id IS NOT NULL AS remote, labels.doc_id IS NOT NULL AS local,
  CASE WHEN toxic = 1 THEN 'UNARCHIVE' END AS archive,
  CASE WHEN lang <> 'en' AND source <> CASE WHEN quality = 1 THEN 'src1' ELSE 'src2' END THEN 'RENAME_MOVE' WHEN lang <> 'en' THEN 'RENAME' WHEN source <> CASE WHEN quality = 1 THEN 'src1' ELSE 'src2' END THEN 'MOVE' END AS structure,
  CASE WHEN n_chars > 2000 OR quality = 0 THEN 'CONTENT_EDIT' END AS content, list_sort([lang, source]) <> ['en', 'src1'] AS drift
  FROM documents FULL JOIN labels ON documents.doc_id = labels.doc_id),
e AS (SELECT page_id, unnest(CASE WHEN NOT local THEN ['NEW'] WHEN NOT remote THEN ['DELETED'] ELSE [archive, structure, content, CASE WHEN archive IS NULL AND structure IS NULL AND content IS NULL AND drift THEN 'METADATA_ONLY' END] END) AS kind FROM s),
events AS (SELECT page_id, kind FROM e WHERE kind IS NOT NULL)"""


@query(_EVENTS + " SELECT page_id, kind FROM events")
def sync_events(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.page_events(*_states(spark, d)).select("page_id", "kind")


@query(_EVENTS + " SELECT kind, count(*) AS n FROM events GROUP BY 1")
def sync_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.page_events(*_states(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(_EVENTS + " SELECT page_id, CASE WHEN kind = 'CONTENT_EDIT' AND page_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'CONFLICT' ELSE kind END AS kind FROM events")
def sync_conflicts(spark: SparkSession, d: str) -> DataFrame:
    edited = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("page_id"))
    return reconcile.upgrade(reconcile.page_events(*_states(spark, d)), edited, "CONTENT_EDIT", "CONFLICT").select("page_id", "kind")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'A' AS office, l_tax > 0.01 AS markdown, l_quantity > 48 AS locked, l_discount > 0.01 AS synced, l_quantity > 25 AS office_same, l_linestatus = 'O' AS markdown_same, l_returnflag = 'R' AS up FROM lineitem)
SELECT CASE WHEN locked AND office THEN 'word_locked' WHEN NOT markdown THEN 'first_sync_docx_authoritative' WHEN NOT office THEN 'first_sync_md_authoritative' WHEN NOT synced THEN 'first_sync_both_docx_wins'
  WHEN office_same AND markdown_same THEN 'no_op' WHEN markdown_same THEN 'docx_to_md' WHEN NOT up THEN 'skip_md_update' WHEN office_same THEN 'md_to_docx' ELSE 'diverged' END AS action, count(*) AS n FROM p GROUP BY 1"""
)
def pair_action_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    action = reconcile.pair_action(c("l_returnflag") != "A", c("l_tax") > 0.01, c("l_quantity") > 48, c("l_discount") > 0.01, c("l_quantity") > 25, c("l_linestatus") == "O", c("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name), '[\\s/\\\\:*?"<>|]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM part""")
def repo_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.repo_name(F.col("p_name")).alias("name"))


@query("SELECT page_id, translate(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '-_', '  ') AS title FROM pages")
def path_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.path_title(F.col("url")).alias("title"))


@query(
    """SELECT n_nationkey + 100 AS node_id, 1 AS depth, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, 0, r_name FROM region"""
)
def page_tree(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.col("r_regionkey").alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("title"))
    leaves = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("node_id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    return trees.page_paths(spark, roots.unionByName(leaves)).select("node_id", "depth", "path")


@query("SELECT source, count(*) AS n FROM documents WHERE NOT (lower(source) = 'src3' OR starts_with(lower(source), 'src1')) GROUP BY 1")
def blacklist_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(rules.first_match(F.col("source"), ["SRC3", "Src1*"]).isNull()).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, sum(CASE WHEN floor(epoch(TIMESTAMP '1998-08-02' - o_orderdate) / 86400) > 365 THEN 1 ELSE 0 END)::BIGINT AS stale, count(*) AS n FROM orders GROUP BY 1")
def stale_partition(spark: SparkSession, d: str) -> DataFrame:
    age = rules.age_days(F.lit("1998-08-02").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum((age > 365).cast("long")).alias("stale"), F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, count(*) AS n_events FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events")).select("user_id", F.unix_timestamp("start").alias("started"), "n_events")


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("conversations"))


_SAFE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ': ' || p_type || '?..', ' +', ' ', 'g'), '[<>:"/\\\\|?*]', '-', 'g'), '^[. ]+|[. ]+$', '', 'g'), '-+', '-', 'g')"""


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(replace(regexp_replace({_SAFE}, '^-|-$', '', 'g'), '..', '-'), '-+', '-', 'g'), '^-|-$', '', 'g') AS name FROM part")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(": "), "p_type", F.lit("?.."))
    return table(spark, d, "part").select("p_partkey", fn.safe_name(title).alias("name"))


@query(
    """SELECT p_partkey, 'https://wiki.test/wiki/spaces/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '/pages/' || p_partkey || '/' || replace(url_encode(p_name || ' ~*' || p_type), '%20', '+') AS url,
  regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS space, p_partkey::VARCHAR AS page_id FROM part"""
)
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    space = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    url = fn.page_url(F.lit("https://wiki.test"), space, F.col("p_partkey"), F.concat("p_name", F.lit(" ~*"), "p_type"))
    rows = table(spark, d, "part").select("p_partkey", url.alias("url"))
    return rows.withColumn("ref", fn.page_ref(F.col("url"), "wiki.test")).select("p_partkey", "url", "ref.space", "ref.page_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Last reviewed "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" by 2001-01-01"))
    return table(spark, d, "orders").select("o_orderkey", fn.date_in(text).cast("string").alias("day"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS body_hash FROM documents")
def body_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.body_hash(F.coalesce("text", F.lit(""))).alias("body_hash"))


@query("SELECT doc_id, source, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source, lang) THEN coalesce(lang, doc_id::VARCHAR) ELSE coalesce(lang, doc_id::VARCHAR) || '(' || doc_id || ')' END AS name FROM documents")
def sibling_names(spark: SparkSession, d: str) -> DataFrame:
    return names.sibling_names(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id", "lang").select("doc_id", "source", "name")


@query("SELECT p_partkey, p_brand || '/' || p_name || CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN ' (' || p_partkey || ')' ELSE '' END || '.md' AS path FROM part")
def collided_paths(spark: SparkSession, d: str) -> DataFrame:
    return names.collided_paths(table(spark, d, "part"), "p_brand", "p_name", "p_partkey").select("p_partkey", "path")


@query(
    """WITH f AS (SELECT l_linenumber % 2 = 0 AS has_md, l_quantity > 45 AS ignored, lower(l_shipmode) AS ext FROM (SELECT l_linenumber, l_quantity, ['docx', 'md', 'PDF', 'xls', 'txt', 'pptx'][1 + l_partkey % 6] AS l_shipmode FROM lineitem))
SELECT CASE WHEN ignored THEN 'skip_ignored' WHEN ext = 'md' THEN 'copy_markdown' WHEN ext = 'xls' THEN 'ignore' WHEN ext = 'txt' THEN 'skip_with_warning' WHEN has_md THEN 'copy_markdown' ELSE 'convert_' || ext END AS action, count(*) AS n FROM f GROUP BY 1"""
)
def file_action_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["docx", "md", "PDF", "xls", "txt", "pptx"]))
    path = F.concat(F.lit("site/a.b."), F.element_at(kinds, (1 + F.col("l_partkey") % 6).cast("int")))
    action = mirrors.file_action(path, F.col("l_linenumber") % 2 == 0, F.col("l_quantity") > 45)
    return table(spark, d, "lineitem").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


_PATHS = "WITH p AS (SELECT page_id, regexp_replace(url, '^[^:]*://', '') AS path FROM pages)"


@query(
    _PATHS
    + """, c AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/de)/', 1) AS a FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) FROM p)
SELECT page_id, (SELECT max_by(a, len(a)) FROM c WHERE a <> '' AND starts_with(p.path, a || '/')) AS ancestor FROM p"""
)
def nearest_ancestors(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[^:]*://", "").alias("path"))
    deep = pages.select(F.regexp_extract("path", "^([^/]*/de)/", 1).alias("path"))
    flat = pages.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("path"))
    return mirrors.nearest_ancestor(pages, deep.union(flat).where("path <> ''")).select("page_id", "ancestor")


@query("SELECT d.doc_id, NOT coalesce(l.quality = 1 AND l.toxic = 0, false) AS needed FROM documents d LEFT JOIN labels l USING (doc_id)")
def conversions_needed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))
    labels = table(spark, d, "labels")
    good = F.when(F.col("quality") == 1, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise("changed")
    manifest = labels.select("doc_id", good.alias("sha256"), F.when(F.col("toxic") == 0, "v2").otherwise("v1").alias("converter_version"))
    return mirrors.conversions(docs, manifest, "v2", "doc_id").select("doc_id", "needed")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    return mirrors.latest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT CASE WHEN source = 'src1' THEN 'first' WHEN lang = 'de' THEN 'second' WHEN regexp_matches(text, '(?i)license') THEN 'third' END AS owner, count(*) AS n FROM documents GROUP BY 1")
def owner_counts(spark: SparkSession, d: str) -> DataFrame:
    owners = [{"name": "third", "patterns": ["(?i)license"]}, {"name": "second", "accounts": ["de"]}, {"name": "first", "spaces": ["src1"]}]
    owner = mirrors.owner(F.col("source"), F.array(F.col("source")), F.col("lang"), F.col("text"), owners)
    return table(spark, d, "documents").groupBy(owner.alias("owner")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^.+/') THEN regexp_extract(url, '^(.+/)', 1) || 'New+title%21' ELSE url END AS url FROM pages")
def retitled_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.url_with_title(F.col("url"), F.lit("New title!")).alias("url"))


@query(
    """WITH s AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, array_to_string(parts, '|') AS parts, CASE WHEN parts[1] = 'en' THEN parts[2] END AS after_en FROM s"""
)
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", fn.url_segments(F.col("url")).alias("s"))
    return rows.select("page_id", F.array_join("s", "|").alias("parts"), F.when(F.get("s", F.lit(0)) == "en", F.get("s", F.lit(1))).alias("after_en"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'a' || chr(10) || '# ' || p_type || chr(10) || '# b' ELSE p_type END AS text FROM part")
def derived_titles(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a\n# "), "p_name", F.lit("\n# b"))).otherwise(F.col("p_type"))
    path = F.concat(F.lit("a/"), "p_brand", F.lit(".md"))
    return part.select("p_partkey", fn.derived_title(text, path).alias("title"), fn.with_first_heading(text, F.col("p_type")).alias("text"))


@query("SELECT p_partkey, ' ' || chr(10) || p_type || chr(10) AS body FROM part")
def outer_blanks(spark: SparkSession, d: str) -> DataFrame:
    original = F.concat(F.lit(" \n"), "p_name", F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", fn.keep_outer_blanks(original, F.concat(F.lit("\t"), "p_type")).alias("body"))


@query("SELECT l_returnflag, sum((l_shipdate < DATE '1995-06-17' OR l_quantity > 40)::INT)::BIGINT AS n_stale, sum((l_partkey > l_suppkey)::INT)::BIGINT AS n_ahead FROM lineitem GROUP BY 1")
def stale_exports(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("l_quantity") <= 40, F.col("l_shipdate"))
    stale, ahead = mirrors.is_stale(made, F.lit("1995-06-17").cast("date")), mirrors.remote_ahead(F.col("l_suppkey"), F.col("l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(stale.cast("long")).alias("n_stale"), F.sum(ahead.cast("long")).alias("n_ahead"))


@query("SELECT DISTINCT o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) UNION SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def resolved_roots(spark: SparkSession, d: str) -> DataFrame:
    named = lambda name, key: table(spark, d, name).select(F.col(key).alias("path"))
    excluded = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("path"))
    return mirrors.resolve_roots(named("orders", "o_custkey"), named("supplier", "s_suppkey"), excluded)
