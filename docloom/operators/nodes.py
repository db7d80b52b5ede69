"""Document trees as tables of nodes: passes that bring trees into normal form, ids, texts and references.

A node is a row: doc_id, path (array of its place below each node from the top), tier (block, inline or struct: list
items, table rows and cells, layout parts), slot (which list of its parent it stands in), kind, node_id, text, attrs (array
of k and v, in order) and tight. Other columns stay as they are. Passes keep paths, so a removed node leaves a gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lines as ln

from .store import stored

# Keys that make a node an anchor, kinds of callouts, attributes that say nothing, kinds of text blocks.
IDENTITY = ("ac:local-id", "ac:macro-id", "local-id")
CALLOUTS = "tip|note|warning|info|panel"
DEFAULTS = {"colspan": "1", "rowspan": "1"}
TEXT_BLOCKS = ("Paragraph", "Heading")
PLAIN, JOINED = ("Text", "Code"), ("Strong", "Emph", "Strikethrough", "Link", "ConfluenceLink")


def parent() -> Column:
    """Path of a node's parent; empty for a top one."""
    return F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))


def _has_identity(attrs: Column) -> Column:
    return F.coalesce(F.exists(attrs, lambda a: a["k"].isin(*IDENTITY)), F.lit(False))


def transform_nodes(nodes: DataFrame, change: dict[str, Column], where: Column) -> DataFrame:
    """Columns of the nodes that a condition holds for get other values."""
    return nodes.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in change.items()})


def drop_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes without those of ``gone`` (doc_id, path) and all below them: an equi-join on the paths above each node."""
    above = nodes.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("_up"))
    hit = above.join(gone.select("doc_id", F.col("path").alias("_up")).distinct(), ["doc_id", "_up"], "left_semi").select("doc_id", "path").distinct()
    return nodes.join(hit, ["doc_id", "path"], "left_anti")


def filter_blocks(nodes: DataFrame, keep: Column) -> DataFrame:
    """The nodes without the blocks that a condition doesn't hold for, and what is below them."""
    return drop_nodes(nodes, nodes.where((F.col("tier") == "block") & ~F.coalesce(keep, F.lit(False))).select("doc_id", "path"))


def collapse_soft_breaks(nodes: DataFrame) -> DataFrame:
    """Soft breaks become texts of one blank."""
    return transform_nodes(nodes, {"text": F.lit(" "), "kind": F.lit("Text")}, F.col("kind") == "SoftBreak").withColumn("text", F.when((F.col("kind") == "Text") & F.col("text").isNull(), " ").otherwise(F.col("text")))


def tighten_lists(nodes: DataFrame) -> DataFrame:
    """Lists all of whose items hold one paragraph and nothing else are tight; a list without items stays as it is."""
    blocks = nodes.where("tier = 'block'").groupBy("doc_id", parent().alias("_item")).agg(F.count("*").alias("_n"), F.count_if(F.col("kind") == "Paragraph").alias("_p"))
    items = nodes.where("kind = 'ListItem'").select("doc_id", F.col("path").alias("_item"), parent().alias("_list"))
    lists = items.join(blocks, ["doc_id", "_item"], "left").groupBy("doc_id", "_list").agg(F.bool_and(F.coalesce((F.col("_n") == 1) & (F.col("_p") == 1), F.lit(False))).alias("_tight"))
    joined = nodes.join(lists.withColumnRenamed("_list", "path"), ["doc_id", "path"], "left")
    return joined.withColumn("tight", F.when(F.col("_tight"), True).otherwise(F.col("tight"))).select(nodes.columns)


def default_ordered_start(nodes: DataFrame) -> DataFrame:
    """Ordered lists that begin at 1 already have their normal form."""
    return nodes


def normalise_entities(nodes: DataFrame) -> DataFrame:
    """Named character references of texts become characters."""
    return nodes.withColumn("_text", ln.decode_entities("text")).withColumn("text", F.when(F.col("kind") == "Text", F.col("_text")).otherwise(F.col("text"))).drop("_text")


def normalise_whitespace(nodes: DataFrame) -> DataFrame:
    """Runs of blanks and tabs in the texts of paragraphs and headings become one; the first and last inline lose outer white space.

    Paragraphs that are anchors stay as they are. First and last come from an aggregate by parent.
    """
    blocks = nodes.where(F.col("kind").isin(*TEXT_BLOCKS) & ~((F.col("kind") == "Paragraph") & _has_identity(F.col("attrs")))).select("doc_id", F.col("path").alias("_up"))
    ends = nodes.where("tier = 'inline'").groupBy("doc_id", parent().alias("_up")).agg(F.min("path").alias("_first"), F.max("path").alias("_last")).join(blocks, ["doc_id", "_up"], "left_semi")
    joined = nodes.withColumn("_up", parent()).join(ends, ["doc_id", "_up"], "left")
    text = F.regexp_replace("text", r"[ \t]+", " ")
    text = F.when(F.col("path") == F.col("_first"), F.regexp_replace(text, r"^\s+", "")).otherwise(text)
    text = F.when(F.col("path") == F.col("_last"), F.regexp_replace(text, r"\s+\z", "")).otherwise(text)
    return joined.withColumn("text", F.when((F.col("kind") == "Text") & F.col("_first").isNotNull(), text).otherwise(F.col("text"))).select(nodes.columns)


def drop_empty_paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs go that have no inline, or one text that is empty or a blank, unless they are anchors."""
    inside = nodes.where("tier = 'inline'").groupBy("doc_id", parent().alias("path")).agg(F.count("*").alias("_n"), F.count_if((F.col("kind") == "Text") & F.col("text").isin("", " ")).alias("_blank"))
    rows = nodes.where((F.col("kind") == "Paragraph") & ~_has_identity(F.col("attrs"))).select("doc_id", "path").join(inside, ["doc_id", "path"], "left")
    return drop_nodes(nodes, rows.where("_n is null or (_n = 1 and _blank = 1)"))


def attach_callout_kind(nodes: DataFrame) -> DataFrame:
    """Quotes whose first block is a paragraph that begins with ``[!kind]`` become callouts (text: the kind), without that mark.

    A text or paragraph that holds nothing but the mark goes.
    """
    mark = rf"(?i)^\[!({CALLOUTS})\]\s*"
    quotes = nodes.where("kind = 'BlockQuote'").select("doc_id", F.col("path").alias("_quote"))
    first = lambda rows, up: rows.groupBy("doc_id", parent().alias(up)).agg(F.min(F.struct("path", "kind", "text")).alias("f"), F.count("*").alias("n"))
    paragraphs = first(nodes.where("tier = 'block'"), "_quote").join(quotes, ["doc_id", "_quote"], "left_semi").where("f.kind = 'Paragraph'").select("doc_id", "_quote", F.col("f.path").alias("_par"))
    texts = first(nodes.where("tier = 'inline'"), "_par").where((F.col("f.kind") == "Text") & F.col("f.text").rlike(mark)).select("doc_id", "_par", F.col("f.path").alias("_path"), F.col("f.text").alias("_text"), "n")
    found = paragraphs.join(texts, ["doc_id", "_par"]).withColumns({"_kind": F.lower(F.regexp_extract("_text", mark, 1)), "_rest": F.regexp_replace("_text", mark, "")})
    joined = nodes.join(found.select("doc_id", F.col("_quote").alias("path"), "_kind"), ["doc_id", "path"], "left").join(found.select("doc_id", F.col("_path").alias("path"), "_rest"), ["doc_id", "path"], "left")
    changed = joined.withColumns({"kind": F.when(F.col("_kind").isNotNull(), "Callout").otherwise(F.col("kind")), "text": F.coalesce("_kind", "_rest", "text")}).select(nodes.columns)
    empty = found.where("_rest = ''")
    return drop_nodes(changed, empty.select("doc_id", F.when(F.col("n") == 1, F.col("_par")).otherwise(F.col("_path")).alias("path")))


def dedupe_attrs(nodes: DataFrame) -> DataFrame:
    """Attributes that only state the default go."""
    none = F.lit(False)
    return nodes.withColumn("attrs", F.filter("attrs", lambda a: ~F.greatest(none, *[(a["k"] == k) & (a["v"] == v) for k, v in DEFAULTS.items()])))


def sort_attrs(nodes: DataFrame) -> DataFrame:
    """Attributes go in order of keys, but for those of storage (an ``ac:``, ``ri:`` or ``local-id`` key), whose order means something."""
    storage = F.exists("attrs", lambda a: a["k"].startswith("ac:") | a["k"].startswith("ri:") | (a["k"] == "local-id"))
    return nodes.withColumn("attrs", F.when(storage, F.col("attrs")).otherwise(F.array_sort("attrs")))


#: The passes in their order; callouts come after empty paragraphs are gone, sorting is last.
PASSES: tuple[Callable[[DataFrame], DataFrame], ...] = (collapse_soft_breaks, tighten_lists, default_ordered_start, normalise_entities, normalise_whitespace, drop_empty_paragraphs, attach_callout_kind, dedupe_attrs, sort_attrs)


#: Passes that read the nodes several times; what goes into each is stored, so that the plan doesn't grow with the passes.
WIDE = (tighten_lists, normalise_whitespace, drop_empty_paragraphs, attach_callout_kind)


def normalise(nodes: DataFrame) -> DataFrame:
    """All passes, one after the other."""
    for step in PASSES:
        nodes = step(stored(nodes, "nodes") if step in WIDE else nodes)
    return nodes


# Kinds that hold a source's text as it is.
OPAQUE = ("RawBlock", "RawInline")


def to_opaque(nodes: DataFrame, where: Column, content: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Blocks that a condition holds for become raw ones with a text and nothing below; and an event for each: doc_id, path, kind (as it was), reason.

    Of such blocks below one another only the topmost counts: its text holds the others.
    """
    hit = stored(nodes.where((F.col("tier") == "block") & F.coalesce(where, F.lit(False))).select("*", content.alias("_content"), reason.alias("_reason")), "opaque")
    ups = hit.where("size(path) > 1").select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("_up"))
    inner = ups.join(hit.select("doc_id", F.col("path").alias("_up")), ["doc_id", "_up"], "left_semi").select("doc_id", "path").distinct()
    tops = hit.join(inner, ["doc_id", "path"], "left_anti")
    raw = tops.withColumns({"kind": F.lit("RawBlock"), "text": F.col("_content")}).select(nodes.columns)
    return drop_nodes(nodes, hit.select("doc_id", "path")).unionByName(raw), tops.select("doc_id", "path", "kind", F.col("_reason").alias("reason"))


def normalise_with_events(nodes: DataFrame, passes: tuple[Callable[[DataFrame], DataFrame], ...] = PASSES) -> tuple[DataFrame, DataFrame]:
    """All passes, and events (doc_id, path, kind, reason) on what a reader of the result doesn't see as it was.

    A node that a pass dropped has the pass's name as reason, with all that was below it; raw nodes of the result have
    ``opaque``. What goes into each pass is stored, and compared by place with what comes out.
    """
    events = None
    for step in passes:
        before = stored(nodes, "nodes")
        nodes = stored(step(before), "nodes")
        lost = before.join(nodes.select("doc_id", "path"), ["doc_id", "path"], "left_anti").select("doc_id", "path", "kind", F.lit(step.__name__).alias("reason"))
        events = lost if events is None else events.unionByName(lost)
    raw = nodes.where(F.col("kind").isin(*OPAQUE)).select("doc_id", "path", "kind", F.lit("opaque").alias("reason"))
    return nodes, raw if events is None else events.unionByName(raw)


def assign_ids(nodes: DataFrame) -> DataFrame:
    """Blocks without a node_id get ``b00001`` and so on, in the tree's order within their document; ids that are there use up no number."""
    new = (F.col("tier") == "block") & (F.coalesce("node_id", F.lit("")) == "")
    number = F.row_number().over(Window.partitionBy("doc_id", new).orderBy("path"))
    return nodes.withColumn("node_id", F.when(new, F.concat(F.lit("b"), F.lpad(number.cast("string"), 5, "0"))).otherwise(F.col("node_id")))


def identities(nodes: DataFrame) -> DataFrame:
    """doc_id and its nodes' macro and local ids, in the tree's order."""
    values = F.transform(F.filter("attrs", lambda a: a["k"].isin("ac:macro-id", "ac:local-id")), lambda a: a["v"])
    each = nodes.select("doc_id", "path", F.posexplode(values).alias("at", "v"))
    return each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "at", "v"))), lambda s: s["v"]).alias("ids"))


def attachment_refs(nodes: DataFrame) -> DataFrame:
    """doc_id, path and filename of images and links of attachments (text: the file), duplicates included."""
    target = F.filter("attrs", lambda a: a["k"] == "target-kind")
    return nodes.where(F.col("kind").isin("ConfluenceImage", "ConfluenceLink") & (F.get(target, F.lit(0))["v"] == "attachment")).select("doc_id", "path", F.col("text").alias("filename"))


def flat_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, path and flat_text of each text block: what a reader sees of its inlines, white space collapsed.

    Inlines below others than emphasis and links aren't seen.
    """
    shown = F.when(F.col("kind").isin(*PLAIN), F.col("text")).when(F.col("kind") == "LineBreak", "\n").when(F.col("kind") == "SoftBreak", " ")
    blocks = nodes.where(F.col("kind").isin(*TEXT_BLOCKS)).select("doc_id", F.col("path").alias("_block"))
    inline = nodes.where("tier = 'inline'").select("doc_id", "path", "kind", shown.alias("shown"))
    hidden = drop_nodes(inline, inline.where(~F.col("kind").isin(*PLAIN, *JOINED, "LineBreak", "SoftBreak")).select("doc_id", "path"))
    above = hidden.select("doc_id", "path", "shown", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("_block"))
    texts = above.join(blocks, ["doc_id", "_block"]).groupBy("doc_id", "_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "shown"))), lambda s: F.coalesce(s["shown"], F.lit(""))), "").alias("t"))
    joined = blocks.join(texts, ["doc_id", "_block"], "left")
    return joined.select("doc_id", F.col("_block").alias("path"), F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " ")).alias("flat_text"))


def same_inlines(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Text blocks (doc_id, path) that stand at one place in both trees with equal flat texts: their cached inlines can be taken as they are."""
    return flat_texts(fresh).join(flat_texts(cached), ["doc_id", "path", "flat_text"]).select("doc_id", "path")


def reattach(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Fresh blocks with the cached ids and attributes of the block of the same kind at the same place.

    Places are positions, so an inserted block shifts those after it; below a block of another kind nothing is taken.
    Fresh attributes win, cached ones fill in.
    """
    kinds = fresh.select("doc_id", "path", F.col("kind").alias("_kind")).join(cached.select("doc_id", "path", F.col("kind").alias("_cached")), ["doc_id", "path"], "left")
    unlike = kinds.where(~F.col("_kind").eqNullSafe(F.col("_cached"))).select("doc_id", "path")
    alike = drop_nodes(fresh.select("doc_id", "path", "tier"), unlike).where("tier <> 'inline'").select("doc_id", "path")
    old = cached.select("doc_id", "path", F.col("node_id").alias("_id"), F.col("attrs").alias("_attrs")).join(alike, ["doc_id", "path"], "left_semi")
    joined = fresh.join(old, ["doc_id", "path"], "left")
    keys = F.transform("attrs", lambda a: a["k"])
    filled = F.concat("attrs", F.filter("_attrs", lambda a: ~F.array_contains(keys, a["k"])))
    return joined.withColumns({"node_id": F.coalesce(F.nullif("_id", F.lit("")), "node_id"), "attrs": F.coalesce(filled, "attrs")}).select(fresh.columns)
