"""Queries on document trees: as JSON texts, as rows of nodes, and grafted on trees that were kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import identity, tree_json
from docloom.sources.tables import table

from .registry import query

_TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL"
_NO_FIELDS = "map<string,string>"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())) - 1
    rows = table(spark, d, "conversations").where("conv_id is not null").withColumn("p", place)
    return rows.select(F.col("conv_id").alias("doc_id"), "p", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _fields(**values: Column) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()]).cast("array<struct<k:string,v:string>>"))


def _node(rows: DataFrame, path: Column, slot: str | None, kind: str | Column, fields: Column) -> DataFrame:
    return rows.select("doc_id", path.cast("array<int>").alias("path"), F.lit(slot).cast("string").alias("slot"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), fields.cast(_NO_FIELDS).alias("fields"))


@query(
    f"""SELECT conv_id AS doc_id, '{{"root":{{"children":[' || string_agg('{{"attributes":{{"role":' || to_json(role) || '}},"children":[{{"inlines":[{{"content":' || to_json(text) || ',"type":"Text"}}],"type":"Paragraph"}}],"type":"BlockQuote"}}', ',' ORDER BY p)
|| '],"type":"Document"}},"version":2}}' AS json FROM ({_TURNS}) GROUP BY 1"""
)
def tree_texts(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    quote = _node(turns, F.array("p"), "children", "BlockQuote", _fields(attributes=F.to_json(F.struct("role")), node_id=F.lit('""')))
    par = _node(turns, F.array(F.col("p"), F.lit(0)), "children", "Paragraph", _fields(trailing_ws=F.lit("null")))
    text = _node(turns, F.array(F.col("p"), F.lit(0), F.lit(0)), "inlines", "Text", _fields(content=tree_json.quoted(F.col("text"))))
    root = _node(turns.select("doc_id").distinct(), F.array(), None, "Document", _fields(x=F.lit("null")))
    whole = quote.unionByName(par).unionByName(text).unionByName(root)
    return tree_json.write(tree_json.canonical(whole))


@query(
    f"""WITH t AS ({_TURNS}), rows AS (
SELECT conv_id, '' AS path, NULL AS slot, 'Document' AS kind, NULL AS content FROM (SELECT DISTINCT conv_id FROM t) WHERE conv_id % 10 <> 0
UNION ALL SELECT conv_id, p::VARCHAR, 'children', CASE role WHEN 'user' THEN 'Paragraph' ELSE 'BlockQuote' END, NULL FROM t WHERE conv_id % 10 <> 0
UNION ALL SELECT conv_id, p || '.0', CASE role WHEN 'user' THEN 'inlines' ELSE 'children' END, CASE role WHEN 'user' THEN 'Text' ELSE 'CodeBlock' END, text FROM t WHERE conv_id % 10 <> 0
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'unsupported version 1', NULL FROM t WHERE conv_id % 10 = 0)
SELECT conv_id AS doc_id, path, slot, kind, content FROM rows"""
)
def tree_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts written here are read as trees; those of an older version, each tenth, give the reason why not."""
    one = F.when(F.col("role") == "user", F.concat(F.lit('{"type":"Paragraph","inlines":[{"type":"Text","content":'), tree_json.quoted(F.col("text")), F.lit("}]}")))
    one = one.otherwise(F.concat(F.lit('{"children":[{"content":'), tree_json.quoted(F.col("text")), F.lit(',"type":"CodeBlock"}],"type":"BlockQuote"}')))
    lists = _turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", one.alias("t")))).alias("t"))
    version = F.when(F.col("doc_id") % 10 == 0, "1").otherwise("2")
    docs = lists.select("doc_id", F.concat(F.lit('{"version":'), version, F.lit(',"root":{"type":"Document","children":['), F.array_join(F.transform("t", lambda x: x["t"]), ","), F.lit("]}}")).alias("json"))
    content = F.get_json_object(F.concat(F.lit('{"c":'), F.col("fields")["content"], F.lit("}")), "$.c")
    rows = tree_json.read(docs).select("doc_id", F.array_join("path", ".").alias("path"), "slot", "kind", content.alias("content"))
    none = F.lit(None).cast("string")
    bad = docs.select("doc_id", none.alias("path"), none.alias("slot"), tree_json.problem(F.col("json")).alias("kind"), none.alias("content")).where("kind is not null")
    return rows.unionByName(bad)


@query(
    """WITH t AS (SELECT doc_id, lang, source, coalesce(n_chars, 0) % 3 AS m FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, 'k' || doc_id AS node_id,
  CASE WHEN m = 0 AND lang <> 'en' THEN 'Text:' || source || ',SoftBreak:,Strong:,Text:' || lang
       WHEN m = 0 THEN 'Text:' || source || ' ,Emph:,Text:' || lang
       WHEN m = 1 THEN 'Text:' || source || '! ,Strong:,Text:' || lang
       ELSE 'Text:' || source || ' ,Strong:,Text:' || lang END AS inlines,
  CASE WHEN m = 1 THEN '{"source_format":"html"}' ELSE '{"entity_form":[[0,"&amp;"]],"source_format":"html"}' END AS origin,
  CASE WHEN m = 2 THEN 'class,ac:local-id' ELSE 'ac:local-id' END AS keys
FROM t"""
)
def grafted_trees(spark: SparkSession, d: str) -> DataFrame:
    """A paragraph of three inlines for each document: changed in a break alone, in its emphasis, in its text, or in its attributes."""
    docs = table(spark, d, "documents").where("doc_id is not null and lang is not null and source is not null").withColumn("m", F.coalesce("n_chars", F.lit(0)) % 3)
    pairs = "array<struct<k:string,v:string>>"
    attr = lambda *kv: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in kv]).cast(pairs)
    none, empty = F.lit(None).cast("string"), F.map_from_entries(F.array().cast(pairs))

    def row(path, tier, slot, kind, text=none, attrs=None, origin=none, node_id=None):
        path = F.array(*map(F.lit, path)).cast("array<int>")
        parts = {"path": path, "tier": F.lit(tier), "slot": F.lit(slot), "kind": kind, "node_id": F.lit("") if node_id is None else node_id, "text": text, "attrs": attr() if attrs is None else attrs, "tight": F.lit(False), "origin": origin, "fields": empty}
        return docs.select("doc_id", "lang", "m", *[c.alias(n) for n, c in parts.items()])

    def tree(*rows):
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    soft = (F.col("m") == 0) & (F.col("lang") != "en")
    origin = F.lit('{"entity_form":[[0,"&amp;"]],"source_format":"html"}')
    lead = F.when(soft, F.col("source")).otherwise(F.concat("source", F.lit(" ")))
    cached = tree(
        row([0], "block", "children", F.lit("Paragraph"), attrs=attr(("ac:local-id", "L")), node_id=F.concat(F.lit("k"), F.col("doc_id").cast("string"))),
        row([0, 0], "inline", "inlines", F.lit("Text"), lead, origin=origin),
        row([0, 1], "inline", "inlines", F.lit("SoftBreak")).where(soft),
        row([0, 2], "inline", "inlines", F.lit("Strong")),
        row([0, 2, 0], "inline", "tokens", F.lit("Text"), F.col("lang")),
    )
    fresh = tree(
        row([0], "block", "children", F.lit("Paragraph"), attrs=F.when(F.col("m") == 2, attr(("class", "c"))).otherwise(attr())),
        row([0, 0], "inline", "inlines", F.lit("Text"), F.concat("source", F.when(F.col("m") == 1, "! ").otherwise(" "))),
        row([0, 1], "inline", "inlines", F.when((F.col("m") == 0) & (F.col("lang") == "en"), "Emph").otherwise("Strong")),
        row([0, 1, 0], "inline", "tokens", F.lit("Text"), F.col("lang")),
    )
    done = identity.graft(fresh, cached)
    inlines = done.where("tier = 'inline'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", F.concat("kind", F.lit(":"), F.coalesce("text", F.lit(""))).alias("t"), "origin"))).alias("i"))
    block = done.where("tier = 'block'").select("doc_id", "node_id", F.array_join(F.transform("attrs", lambda a: a["k"]), ",").alias("keys"))
    return block.join(inlines, "doc_id").select("doc_id", "node_id", F.array_join(F.transform("i", lambda x: x["t"]), ",").alias("inlines"), F.get("i", F.lit(0))["origin"].alias("origin"), "keys")
