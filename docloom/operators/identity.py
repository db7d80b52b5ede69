"""What a tree read anew takes over from the tree kept of before: ids, attributes, sources of blocks and inlines.

Node tables as of ``nodes``, with two more columns, as ``tree_json.table_of`` gives them: origin (the JSON text of where
a node comes from, or null) and fields (JSON texts of a node's other members by name). Places are positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import JOINED, PLAIN, TEXT_BLOCKS, drop_nodes, parent
from .store import stored

# Inlines whose kind and members a written page keeps, by the members that count; those with inlines of their own.
FAITHFUL = {"Strong": (), "Emph": (), "Strikethrough": (), "Link": ("text", "title"), "Image": ("text", "alt", "title"), "Code": ("text",)}
HOLDERS = ("Strong", "Emph", "Strikethrough", "Link")
BREAKS = ("Text", "SoftBreak", "LineBreak")
# Inlines that have an origin; members that fill in where the new node has none, by kind; attributes that are never taken over.
SOURCED = ("Text", "Code", "Link", "ConfluenceLink", "Image", "ConfluenceImage", "InlineMacro", "RawInline")
FILLED = {
    "BulletList": ("compact",), "OrderedList": ("compact", "omit_start"), "CodeBlock": ("no_wrapper",), "Callout": ("params", "title", "body_leading_ws", "body_trailing_ws"),
    "ConfluenceMacro": ("params", "plain_body", "body_leading_ws", "body_trailing_ws"),
}
NOT_TAKEN = {"TableCell": ("rowspan", "colspan"), "LayoutSection": ("ac:type",)}
SCHEMES = ("", "http://", "https://", "mailto:")


def _above(rows: DataFrame, least: int = 1, own: bool = True) -> DataFrame:
    """A row for each of a node's ancestors (column _up), itself included if ``own``."""
    n = F.size("path") - (0 if own else 1)
    ups = F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.slice("path", F.lit(1), i)))
    return rows.withColumn("_up", F.explode(ups))


def seen_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, path and seen: what a reader sees of the inlines below each text block and each inline, white space collapsed.

    Every visible text goes to each of its ancestors at once, so a shuffle does for trees of any depth.
    """
    inline = nodes.where("tier = 'inline'").select("doc_id", "path", "kind", "text")
    shown = F.when(F.col("kind").isin(*PLAIN), F.coalesce("text", F.lit(""))).when(F.col("kind") == "LineBreak", "\n").when(F.col("kind") == "SoftBreak", " ")
    visible = drop_nodes(inline, inline.where(~F.col("kind").isin(*PLAIN, *JOINED, "LineBreak", "SoftBreak")).select("doc_id", "path"))
    pieces = _above(visible.select("doc_id", "path", shown.alias("shown")).where("shown is not null"), own=False)
    lists = pieces.groupBy("doc_id", F.col("_up").alias("path")).agg(F.array_sort(F.collect_list(F.struct("path", "shown"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["shown"]), "")
    return lists.select("doc_id", "path", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("seen"))


def signatures(nodes: DataFrame) -> DataFrame:
    """doc_id, path, seen and shape of each text block: two blocks of equal ones carry the same content.

    shape is a SHA-256 over the block's inlines in the tree's order, without texts and breaks: each gives its depth, kind,
    members that count and the text seen below it; inlines of other kinds give a mark, and nothing below them counts.
    Depths in that order say how they nest. A link whose text is its own address counts as text.
    """
    member = lambda name: F.col("text") if name == "text" else F.get_json_object(F.concat(F.lit('{"x":'), F.coalesce(F.col("fields")[name], F.lit("null")), F.lit("}")), "$.x")
    blocks = nodes.where(F.col("kind").isin(*TEXT_BLOCKS)).select("doc_id", F.col("path").alias("_up"))
    seen = stored(seen_texts(nodes), "graft-seen")
    inline = nodes.where("tier = 'inline'").join(seen, ["doc_id", "path"], "left").withColumn("seen", F.coalesce("seen", F.lit("")))
    bare = F.coalesce((F.col("kind") == "Link") & F.col("text").isin(*[F.concat(F.lit(s), F.col("seen")) for s in SCHEMES]), F.lit(False))
    members = F.coalesce(*[F.when(F.col("kind") == k, F.to_json(F.array(*[member(m) for m in names])) if names else F.lit("")) for k, names in FAITHFUL.items()])
    piece = F.when(members.isNull(), F.lit("?")).otherwise(F.to_json(F.struct("kind", members.alias("members"), F.when(F.col("kind").isin(*HOLDERS), F.col("seen")).alias("seen"))))
    tokens = inline.select("doc_id", "path", "kind", bare.alias("bare"), piece.alias("piece"))
    closed = tokens.where(F.col("bare") | ~F.col("kind").isin(*HOLDERS, *BREAKS)).select("doc_id", F.col("path").alias("_up"))
    hidden = _above(tokens.select("doc_id", "path"), own=False).join(closed, ["doc_id", "_up"], "left_semi").select("doc_id", "path").distinct()
    counted = tokens.where(~F.col("bare") & ~F.col("kind").isin(*BREAKS)).join(hidden, ["doc_id", "path"], "left_anti")
    placed = _above(counted, own=False).join(blocks, ["doc_id", "_up"])
    lists = placed.groupBy("doc_id", "_up").agg(F.array_sort(F.collect_list(F.struct("path", "piece"))).alias("s"))
    shape = F.sha2(F.to_json(F.transform("s", lambda x: F.struct((F.size(x["path"]) - F.size("_up")).alias("d"), x["piece"].alias("p")))), 256)
    joined = blocks.join(lists.select("doc_id", "_up", shape.alias("shape")), ["doc_id", "_up"], "left").withColumnRenamed("_up", "path")
    return joined.join(seen, ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("seen", F.lit("")).alias("seen"), F.coalesce("shape", F.lit("")).alias("shape"))


def _merged(mine: Column, theirs: Column, skip: Column) -> Column:
    """Attributes with those of the other node whose keys are neither there nor skipped."""
    keys = F.transform(mine, lambda a: a["k"])
    more = F.filter(theirs, lambda a: ~F.array_contains(keys, a["k"]) & ~F.coalesce(F.array_contains(skip, a["k"]), F.lit(False)))
    return F.coalesce(F.concat(mine, more), mine)


def _by_kind(values: dict[str, tuple[str, ...]], always: tuple[str, ...] = ()) -> Column:
    table = F.create_map(*[x for k, names in values.items() for x in (F.lit(k), F.array(*map(F.lit, (*names, *always))))])
    return F.coalesce(table[F.col("kind")], F.array(*map(F.lit, always)).cast("array<string>"))


def _without_entities(origin: Column) -> Column:
    """An origin without the places of entities, which only hold for the text that they were counted on."""
    return F.to_json(F.map_filter(F.try_variant_get(F.try_parse_json(origin), "$", "map<string,variant>"), lambda k, v: k != "entity_form"))


def alike_nodes(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """doc_id and path of blocks and their parts that stand at one place in both trees, with the same kind all the way down."""
    mine, theirs = (t.where("tier <> 'inline'").select("doc_id", "path", F.col("kind").alias(k)) for t, k in ((fresh, "_kind"), (cached, "_cached")))
    kinds = mine.join(theirs, ["doc_id", "path"], "left")
    return drop_nodes(kinds, kinds.where(~F.col("_kind").eqNullSafe(F.col("_cached"))).select("doc_id", "path")).select("doc_id", "path")


def graft(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """The fresh tree with what the cached one knows of it (columns doc_id, path, tier, slot, kind, node_id, text, attrs, tight, origin, fields).

    A block at the same place and of the same kind as in the cached tree, all the way from the top, takes its id,
    origin and missing members and attributes; fresh ones win. Its inlines are replaced by the cached ones, whole
    subtrees with their origins, if both carry the same content (``signatures``), and a heading's level is the same.
    Else inlines of one kind and place take attributes and origin, without the places of entities if the text changed.
    An inserted block shifts those after it, and below a block of another kind nothing is taken. Both trees, the pairs
    of blocks and the signatures are stored, for each is read several times.
    """
    columns = ["doc_id", "path", "tier", "slot", "kind", "node_id", "text", "attrs", "tight", "origin", "fields"]
    fresh, cached = (stored(t.select(columns), "graft-tree") for t in (fresh, cached))
    alike = stored(alike_nodes(fresh, cached), "graft-alike")

    old = cached.where("tier <> 'inline'").select("doc_id", "path", *[F.col(c).alias(f"_{c}") for c in ("node_id", "text", "attrs", "origin", "fields")]).join(alike, ["doc_id", "path"], "left_semi")
    block = (F.col("tier") == "block") & F.col("_fields").isNotNull()
    names = F.map_keys("fields")
    wanted = F.when(block, _by_kind(FILLED, ("trailing_ws",))).otherwise(F.array().cast("array<string>"))
    filled = F.map_concat("fields", F.map_filter("_fields", lambda k, v: F.array_contains(wanted, k) & ~F.array_contains(names, k)))
    macro = block & (F.col("kind") == "ConfluenceMacro")
    rich = F.map_concat(F.map_filter(filled, lambda k, v: k != "rich_body"), F.map_filter("_fields", lambda k, v: k == "rich_body"))
    held = fresh.where("tier <> 'inline'").join(old, ["doc_id", "path"], "left")
    held = held.withColumns(
        {
            "node_id": F.coalesce(F.nullif("_node_id", F.lit("")), "node_id"),
            "text": F.when(macro & (F.coalesce("text", F.lit("")) == ""), F.col("_text")).otherwise(F.col("text")),
            "attrs": _merged(F.col("attrs"), F.col("_attrs"), _by_kind(NOT_TAKEN)),
            "origin": F.when(block, F.coalesce("_origin", "origin")).otherwise(F.col("origin")),
            "fields": F.when(macro, rich).when(F.col("_fields").isNotNull(), filled).otherwise(F.col("fields")),
        }
    ).select(columns)

    level = lambda t: t.where(F.col("kind").isin(*TEXT_BLOCKS)).select("doc_id", "path", F.col("fields")["level"].alias("level"))
    same_level = level(fresh).join(level(cached).withColumnRenamed("level", "_level"), ["doc_id", "path"]).where("level <=> _level").select("doc_id", "path")
    open_blocks = same_level.join(alike, ["doc_id", "path"], "left_semi")
    new_marks, old_marks = (stored(signatures(t), "graft-signatures") for t in (fresh, cached))
    same = stored(open_blocks.join(new_marks.join(old_marks, ["doc_id", "path", "seen", "shape"]), ["doc_id", "path"], "left_semi").select("doc_id", F.col("path").alias("_up")), "graft-same")

    def below(rows: DataFrame, how: str) -> DataFrame:
        hit = _above(rows.select("doc_id", "path"), own=False).join(same, ["doc_id", "_up"], "left_semi").select("doc_id", "path").distinct()
        return rows.join(hit, ["doc_id", "path"], how)

    new, kept = fresh.where("tier = 'inline'"), cached.where("tier = 'inline'")
    taken, rest = below(kept, "left_semi"), below(new, "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "_parent").orderBy("path"))
    tops = lambda t: t.withColumn("_parent", parent()).withColumn("_n", place)
    theirs = tops(kept).select("doc_id", "_parent", "_n", "kind", *[F.col(c).alias(f"_{c}") for c in ("text", "attrs", "origin")])
    theirs = theirs.join(open_blocks.withColumnRenamed("path", "_parent"), ["doc_id", "_parent"], "left_semi")
    joined = tops(rest).join(theirs, ["doc_id", "_parent", "_n", "kind"], "left")
    source = F.when(F.col("text").eqNullSafe(F.col("_text")) | ~F.col("kind").isin("Text", "Code"), F.col("_origin")).otherwise(_without_entities(F.col("_origin")))
    none = F.array().cast("array<string>")
    rest = joined.withColumns({"attrs": _merged(F.col("attrs"), F.col("_attrs"), none), "origin": F.when(F.col("kind").isin(*SOURCED), F.coalesce(source, "origin")).otherwise(F.col("origin"))}).select(columns)
    return held.unionByName(taken).unionByName(rest)
