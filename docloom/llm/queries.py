"""The driver's queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontam, embed_dedup, langid, periodic, secrets, sentpiece, simhash, substring, topk, toxicity, trie, urls

#: Path of the SentencePiece model.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(items: Column, glue: str = ",") -> Column:
    return F.sha2(F.array_join(items, glue).cast("binary"), 256)


def _named(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), _digest(_named(base)).alias("base_sha256"), F.array_join(_named(F.col("secrets")), ",").alias("spans"), number("markov"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    weights = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark, and the items that have these windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, _digest(F.array_sort("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted; digests of what reads back from the text."""
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_conversations(rows)
    masked = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    done = done.withColumn("masked", masked)
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _digest(turns, "").alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without passages of 35 words that stand elsewhere too."""
    done = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentpiece.encode(docs, PIECE_MODEL, decoded="decoded").drop("text")
    ids = _digest(F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal labels, from a cosine of 0.93."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_columns=False)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by models of labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every vector whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def _crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """Texts of documents with crc32(doc_id) % 10 = 0 go on, from some word, by repeating the words from there."""
    h = _crc(F.col("doc_id"))
    g = F.floor(h / 10)

    def rebuilt(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda j: F.element_at(w, a + 1 + j % p))
        return F.array_join(F.concat(F.slice(w, 1, a), tail), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # Bound as a lambda's argument, the list of words is made once and not for each of its words.
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rebuilt(w))), 1)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(changed, "text")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the one of the highest exponent, and what is left without repeats."""
    docs = with_periodic_ends(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs, collapsed="text")
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  exact: no fractions
    top = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.element_at("runs", 1), lambda best, x: F.when(better(x, best), x).otherwise(best)))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = found.withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        _digest(F.transform("runs", line), "").alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt on the first turns of its hundred's first conversation."""
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie.prefix_trie(*trie.with_shared_heads(turns, _crc(F.col("conv")) % 6, 100))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_url_filters, op3_benchmark_decontamination, op4_chat_formatting, op5_language_id, op6_substring_dedup, op7_sentencepiece, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_toxicity, op11_exact_topk, op12_periodic_runs, op13_prefix_trie)}

_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d CROSS JOIN lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.s, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CONFLICT = r"(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>)"
_OP4 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONFLICT}'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 21 + length(role) + len(regexp_extract_all(role, '{_CONFLICT}')) END AS size FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT md5(gram) AS h FROM p GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS pos FROM p WHERE md5(gram) IN (SELECT h FROM again)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: crc32 is not among DuckDB's functions: its table of 256 entries is made by eight shifts, then bytes are folded over it.
_OP13 = r"""
WITH shifts AS (
  SELECT list(x ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384)) AS x FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i))),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a // 256, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h FROM ids, shifts),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
rebuilt AS (
  SELECT heads.c, p, role, text FROM heads JOIN t ON t.c = heads.base WHERE p < h
  UNION ALL SELECT heads.c, least(h, coalesce(n.n, 0)) + p - h, role, text FROM heads JOIN t USING (c) LEFT JOIN n ON n.c = heads.base WHERE p >= h),
lists AS (SELECT c, list(role || chr(0) || text ORDER BY p) AS turns, list(length(text) ORDER BY p) AS sizes FROM rebuilt GROUP BY c),
convs AS (SELECT ids.c, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN lists USING (c)),
steps AS (SELECT c, d, turns[:d] AS k, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(turns) = d AS ends FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM convs)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM steps GROUP BY d, k),
children AS (SELECT d - 1 AS d, k[:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
flat AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)),
below AS (SELECT up AS d, k[:up] AS k, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(generate_series(0, d)) AS up FROM flat) GROUP BY 1, 2)
SELECT flat.conv_id, flat.d AS depth, parent.conv_id AS parent_conv_id, flat.n_convs, flat.n_children::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(flat.ends) AS ends_sha256
FROM flat JOIN below USING (d, k) LEFT JOIN nodes AS parent ON parent.d = flat.d - 1 AND parent.k = flat.k[:flat.d - 1]
"""

_OP11 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
QUALIFY rank <= 5
"""

#: Queries that SQL can't express (models, XXH64, the tokenizer, links by approximate search) are held against brute force in tests/llm.
ORACLE_SQL = {"op3_benchmark_decontamination": _OP3, "op4_chat_formatting": _OP4, "op6_substring_dedup": _OP6, "op11_exact_topk": _OP11, "op13_prefix_trie": _OP13}
