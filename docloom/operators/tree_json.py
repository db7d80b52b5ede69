"""Document trees as canonical JSON texts: read into rows of nodes of any depth, and written from them.

A node is a row: doc_id, path (places from the top, empty for the root), slot (the member of its parent that lists it),
kind and fields (its other members: their JSON texts by name). A node's children are numbered over all its lists, in
the order of the lists' names. ``table_of`` and ``fields_of`` go over to the node tables of ``nodes`` and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import parent
from .store import stored

# The version that is read and written, the root's kind, and members that say nothing at these values.
VERSION = 2
ROOT = "Document"
DEFAULTS = {
    "attributes": "{}", "params": "{}", "node_id": '""', "alt": '""', "space_key": '""', "version_at_save": '""', "posting_day": '""', "page_title": '""',
    "page_space_key": '""', "user_local_id": '""', "body_leading_ws": '""', "tight": "false", "compact": "false", "omit_start": "false", "no_wrapper": "false",
    "block_level": "false", "header": "false", "has_header": "false", "rich_body": "false", "start": "1", "rowspan": "1", "colspan": "1", "format": '"xhtml"',
    "align": "[]", "tokens": "[]", "body_tokens": "[]", "inlines": "[]", "children": "[]", "items": "[]", "rows": "[]", "cells": "[]", "sections": "[]", "body": "[]",
}
# Kinds by tier, and the member that holds a node's own text.
INLINE = ("Text", "LineBreak", "SoftBreak", "Strong", "Emph", "Strikethrough", "Code", "Link", "ConfluenceLink", "Image", "ConfluenceImage", "InlineMacro", "Emoticon", "Placeholder", "RawInline")
PARTS = ("ListItem", "TableRow", "TableCell", "LayoutSection", "LayoutCell")
BLOCKS = ("HorizontalRule", "Heading", "Paragraph", "BulletList", "OrderedList", "CodeBlock", "BlockQuote", "Table", "Callout", "ConfluenceMacro", "Layout", "RawBlock")
TEXT_FIELDS = {
    "Text": "content", "Code": "content", "CodeBlock": "content", "Placeholder": "content", "RawInline": "content", "RawBlock": "content", "ConfluenceLink": "target",
    "ConfluenceImage": "source", "Image": "src", "Link": "href", "InlineMacro": "name", "Emoticon": "name", "ConfluenceMacro": "name", "Callout": "kind",
}
_FIELDS = "map<string,string>"
_LAST = 2**31 - 1


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.substring(whole, 6, F.length(whole) - 6)


def problem(json: Column, version: int = VERSION, key: str = "version", root: str = ROOT) -> Column:
    """Why a text is no tree that can be read, or null: no JSON, no object, another version, no root of the right kind."""
    v = F.try_parse_json(json)
    members = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
    said = F.try_variant_get(v, f"$.{key}", "string")
    kind = F.try_variant_get(v, "$.root.type", "string")
    return (
        F.when(v.isNull(), "not JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(~F.array_contains(members, key), f"no {key}")
        .when(~F.coalesce(said == str(version), F.lit(False)), F.concat(F.lit(f"unsupported {key} "), F.coalesce(said, F.lit("null"))))
        .when(~F.array_contains(members, "root"), "no root")
        .when(~F.coalesce(kind == root, F.lit(False)), F.concat(F.lit("the root is a "), F.coalesce(kind, F.lit("value"))))
    )


def _listed(value: Column) -> Column:
    """A member's nodes, or null where it is no list of nodes alone (of one at least)."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when((F.size(items) > 0) & F.forall(items, lambda x: F.try_variant_get(x, "$.type", "string").isNotNull()), items)


def _grown(entries: Column) -> Column:
    """The row itself, finished, and its children, still to be opened."""
    lists = F.filter(entries, lambda e: e["a"].isNotNull())
    children = F.flatten(F.transform(lists, lambda e: F.transform(e["a"], lambda x: F.struct(e["k"].alias("slot"), x.alias("node")))))
    others = F.filter(entries, lambda e: e["a"].isNull() & (e["k"] != "type"))
    fields = F.map_from_entries(F.transform(others, lambda e: F.struct(e["k"], F.to_json(e["v"]))))
    none = F.lit(None)
    row = lambda path, slot, kind, fields, node: F.struct(path.alias("path"), slot.alias("slot"), kind.alias("kind"), fields.alias("fields"), node.alias("node"))
    own = row(F.col("path"), F.col("slot"), F.try_variant_get("node", "$.type", "string"), fields, none.cast("variant"))
    below = F.transform(children, lambda c, i: row(F.concat("path", F.array(i)), c["slot"], none.cast("string"), none.cast(_FIELDS), c["node"]))
    return F.concat(F.array(own), below)


def read(docs: DataFrame, doc_id: str = "doc_id", json: str = "json", version: int = VERSION, key: str = "version", levels: int = 8) -> DataFrame:
    """Rows of nodes (doc_id, path, slot, kind, fields) of every text that is a tree; see ``problem`` for the others.

    One step opens one level: a row still to be opened becomes itself and its children, others pass. Steps need no
    shuffle; after each ``levels`` of them the rows are stored and looked at, so trees may be of any depth. A member
    that lists nodes, and nodes only, is opened; every other one stays a field, with the members of its objects in order.
    """
    v = F.variant_get(F.parse_json(json), "$.root", "variant")
    rows = docs.where(problem(F.col(json), version, key).isNull()).select(
        F.col(doc_id).alias("doc_id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("slot"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(_FIELDS).alias("fields"), v.alias("node")
    )
    while True:
        for _ in range(levels):
            entries = F.transform(F.map_entries(F.expr("cast(node as map<string,variant>)")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), _listed(e["value"]).alias("a")))
            itself = F.array(F.struct("path", "slot", "kind", "fields", "node"))
            rows = rows.select("doc_id", F.explode(F.when(F.col("node").isNull(), itself).otherwise(_let(entries, _grown))).alias("n")).select("doc_id", "n.*")
        rows = stored(rows, "tree-rows")
        if rows.where("node is not null").isEmpty():
            return rows.drop("node")


def unknown_kinds(tree: DataFrame, kinds: tuple[str, ...] = (*INLINE, *PARTS, *BLOCKS, ROOT)) -> DataFrame:
    """doc_id, path and kind of the nodes whose kind isn't known."""
    return tree.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).select("doc_id", "path", "kind")


def canonical(tree: DataFrame) -> DataFrame:
    """The tree without fields that are null or have their default value."""
    standard = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    return tree.withColumn("fields", F.map_filter("fields", lambda k, v: v.isNotNull() & (v != "null") & ~F.coalesce(v == standard[k], F.lit(False))))


def write(tree: DataFrame, version: int = VERSION, key: str = "version") -> DataFrame:
    """doc_id and json: each tree as one JSON text without blanks, the members of every object in order of names.

    Three shuffles, whatever the depth: children's places meet at their parent, which writes what stands before,
    between and after its children; the pieces of a document, put in the order of the tree, are its text. A document
    without a root row, or with a node whose parent is missing, gives a text that can't be read.
    """
    kids = tree.where("size(path) > 0").groupBy("doc_id", parent().alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("place"), "slot"))).alias("kids"))
    rows = tree.join(kids, ["doc_id", "path"], "left")
    many = "array<int>"
    slots = F.array_distinct(F.transform(F.coalesce("kids", F.array().cast("array<struct<place:int,slot:string>>")), lambda x: x["slot"]))
    places = lambda s: F.transform(F.filter("kids", lambda x: x["slot"] == s), lambda x: x["place"])
    entry = lambda name, text, at: F.struct(name.alias("name"), text.alias("text"), at.alias("at"))
    own = F.transform(F.map_entries(F.map_filter("fields", lambda k, v: v.isNotNull())), lambda e: entry(e["key"], e["value"], F.lit(None).cast(many)))
    lists = F.transform(slots, lambda s: entry(s, F.lit(None).cast("string"), places(s)))
    kind = F.array(entry(F.lit("type"), quoted(F.col("kind")), F.lit(None).cast(many)))
    members = F.array_sort(F.concat(F.coalesce(own, F.array().cast("array<struct<name:string,text:string,at:array<int>>>")), lists, kind))

    # A child at place p has the key 2p + 1 below its parent's; what stands before it has 2p, so pieces sort between children.
    here = F.transform("path", lambda p: 2 * p + 1)
    piece = lambda at, text: F.struct(F.concat(here, at).alias("key"), text.alias("text"))

    def pieces(all_members: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            comma = F.when(i > 0, ",").otherwise("")
            later = F.filter(F.slice(all_members, i + 1, F.size(all_members)), lambda x: x["at"].isNotNull())
            last = F.coalesce(F.element_at("kids", -1)["place"] * 2 + 2, F.lit(0))
            at = F.when(F.size(later) > 0, F.element_at(F.get(later, F.lit(0))["at"], 1) * 2).otherwise(last)
            name = F.concat(comma, quoted(m["name"]), F.lit(":"))
            listed = F.transform(m["at"], lambda p, j: piece(F.array(2 * p, i), F.when(j == 0, F.concat(name, F.lit("["))).otherwise(",")))
            end = F.array(piece(F.array(F.element_at(m["at"], -1) * 2 + 2, F.lit(-1)), F.lit("]")))
            return F.when(m["at"].isNotNull(), F.concat(listed, end)).otherwise(F.array(piece(F.array(at, i), F.concat(name, m["text"]))))

        return F.flatten(F.transform(all_members, one))

    whole = F.concat(F.array(piece(F.array(F.lit(-1)), F.lit("{"))), _let(members, pieces), F.array(piece(F.array(F.lit(_LAST)), F.lit("}"))))
    texts = rows.select("doc_id", F.explode(whole).alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "")
    first, second = (f'"{key}":{version}', '"root":')
    text = F.concat(F.lit("{" + second), body, F.lit("," + first + "}")) if "root" < key else F.concat(F.lit("{" + first + "," + second), body, F.lit("}"))
    return texts.select("doc_id", text.alias("json"))


def table_of(tree: DataFrame) -> DataFrame:
    """Nodes as in node tables: doc_id, path, tier, slot, kind, node_id, text, attrs, tight; origin and fields keep the rest. The root goes."""
    field = F.create_map(*[F.lit(x) for pair in TEXT_FIELDS.items() for x in pair])[F.col("kind")]
    value = lambda name: F.variant_get(F.parse_json(F.col("fields")[name]), "$", "string")
    attrs = F.transform(F.map_entries(F.from_json(F.col("fields")["attributes"], "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    tier = F.when(F.col("kind").isin(*INLINE), "inline").when(F.col("kind").isin(*PARTS), "struct").otherwise("block")
    taken = F.concat(F.array(F.lit("node_id"), F.lit("attributes"), F.lit("tight"), F.lit("origin")), F.when(field.isNotNull(), F.array(field)).otherwise(F.array().cast("array<string>")))
    return tree.where("size(path) > 0").select(
        "doc_id", "path", tier.alias("tier"), "slot", "kind",
        F.coalesce(value("node_id"), F.lit("")).alias("node_id"),
        value(field).alias("text"),
        F.coalesce(attrs, F.array().cast("array<struct<k:string,v:string>>")).alias("attrs"),
        F.coalesce(value("tight") == "true", F.lit(False)).alias("tight"),
        F.col("fields")["origin"].alias("origin"),
        F.map_filter("fields", lambda k, v: ~F.array_contains(taken, k)).alias("fields"),
    )


def fields_of(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Rows for ``write`` from a node table (fields and origin may be missing), with a root for each document.

    ``roots`` are rows of roots from ``read``; without them each document gets a plain one. Attributes are written in
    order of their keys, of equal keys the first.
    """
    rest = F.col("fields") if "fields" in nodes.columns else F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    origin = F.col("origin") if "origin" in nodes.columns else F.lit(None).cast("string")
    field = F.create_map(*[F.lit(x) for pair in TEXT_FIELDS.items() for x in pair])[F.col("kind")]
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    keys = F.array_sort(F.array_distinct(F.transform("attrs", lambda a: a["k"])))
    first = lambda k: F.coalesce(F.get(F.filter("attrs", lambda a: a["k"] == k), F.lit(0))["v"], F.lit(""))
    attrs = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), quoted(first(k)))), ","), F.lit("}"))
    own = F.array(
        pair(F.lit("node_id"), quoted(F.coalesce("node_id", F.lit("")))), pair(F.lit("attributes"), F.coalesce(attrs, F.lit("{}"))),
        pair(F.lit("tight"), F.coalesce(F.col("tight"), F.lit(False)).cast("string")), pair(F.lit("origin"), origin), pair(field, quoted(F.col("text"))),
    )
    good = F.filter(own, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    rows = nodes.select("doc_id", "path", "slot", "kind", F.map_concat(rest, F.map_from_entries(good)).alias("fields"))
    if roots is None:
        none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
        roots = nodes.select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("slot"), F.lit(ROOT).alias("kind"), none.alias("fields"))
    return canonical(rows.unionByName(roots))
