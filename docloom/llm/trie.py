"""Prefix trie of conversations: prefix-doubling names of turn blocks, prefixes composed from them, nodes grouped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Depths of one conversation that one window holds.
SPAN = 4096
_PLACE = 33


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Append each row's place, from 0 without gaps, in the order of ``by``: sorted by ranges, then counted up.

    No task holds more than its range. Only the ranges' sizes, a row for each partition, meet in one place.
    """
    sorted_rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(sorted_rows, "trie-order")
    part, place = F.shiftright("_at", _PLACE), F.col("_at").bitwiseAND((1 << _PLACE) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(sizes), part == F.col("_part")).withColumn(out, F.col("_before") + place).drop("_at", "_part", "_before")


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, pos, name, chars): each turn's place in its conversation, dense name of role and text, and length.

    Turns are ordered by number (null first), ties by role and text; null roles and texts are empty; rows without a
    conversation id are left out. Names follow the order of (role, text), so only names take part in the sorting.
    """
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    names = numbered(turns.select("role", "text").distinct(), ["role", "text"], "name")
    named = turns.join(names, ["role", "text"]).select("conv", "turn", "name", F.length("text").cast("long").alias("chars"))
    # A last key that differs by row, so that a range can be split even among equal rows.
    placed = numbered(stored(named, "trie-turns").withColumn("_row", F.monotonically_increasing_id()), ["conv", "turn", "name", "_row"], "at").drop("_row")
    placed = stored(placed, "trie-places")
    first = placed.groupBy("conv").agg(F.min("at").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("pos"), "name", "chars")


def with_shared_heads(turns: DataFrame, head: Column, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from (conv, pos, name, chars), and a row (conv, size) for each, even without a turn.

    The first ``head`` (a column of conv) turns are those of conversation ``conv - conv % group`` (all if it has
    fewer, none if it is absent); then follow the conversation's own turns from its place ``head`` on.
    """
    ids = turns.groupBy("conv").agg(F.count("*").alias("own"))
    base = F.col("conv") - F.col("conv") % group
    ids = stored(ids.withColumn("head", head.cast("long")).withColumn("base", base), "trie-ids")
    known = ids.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = ids.join(known, "base", "left").select("conv", "base", "head", "own", F.least("head", F.coalesce("there", F.lit(0))).alias("taken"))
    heads = ids.groupBy("base").agg(F.max("head").alias("most"))
    wanted = turns.withColumnRenamed("conv", "base").join(heads, "base").where("pos < most").drop("most")
    first = plan.join(wanted, "base").where("pos < head").select("conv", "pos", "name", "chars")
    rest = turns.join(plan, "conv").where("pos >= head").select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), "name", "chars")
    sizes = plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("size"))
    return stored(first.unionByName(rest), "trie-rebuilt"), stored(sizes, "trie-sizes")


def block_names(turns: DataFrame) -> tuple[DataFrame, int]:
    """Rows (conv, level, block, name) of all aligned blocks of 2**level turns, and the number of levels.

    Blocks of a level are equal if and only if their names are: a block's name is the dense name of the pair of
    names of its halves, so each level is one join of a level with itself and one round of naming.
    """
    level = turns.select("conv", F.col("pos").alias("block"), "name")
    longest = (turns.agg(F.max("pos")).first()[0] or 0) + 1
    out, k = level.withColumn("level", F.lit(0)), 0
    while 2 << k <= longest:
        left = level.where("block % 2 = 0").select("conv", F.shiftright("block", 1).alias("block"), F.col("name").alias("left"))
        right = level.where("block % 2 = 1").select("conv", F.shiftright("block", 1).alias("block"), F.col("name").alias("right"))
        pairs = stored(left.join(right, ["conv", "block"]), "trie-pairs")
        names = numbered(pairs.select("left", "right").distinct(), ["left", "right"], "name")
        level = stored(pairs.join(names, ["left", "right"]).select("conv", "block", "name"), "trie-level")
        k += 1
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out, k + 1


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (conv, depth, size, chars, names), for depths 0 to size: names identify the prefix among those of its depth.

    A depth's set bits, from the highest, cut the prefix into aligned blocks; their names in that order are its own.
    """
    blocks, levels = block_names(turns)
    depths = turns.select("conv", (F.col("pos") + 1).alias("depth"), "chars")
    bits = F.expr(f"filter(sequence(0, {levels - 1}), k -> (shiftright(depth, k) & 1) = 1)")
    needed = depths.select("conv", "depth", "chars", F.explode(bits).alias("level"))
    needed = needed.withColumn("block", F.expr("shiftright(depth, level) - 1"))
    met = needed.join(blocks, ["conv", "level", "block"])
    # At most one name for each level: lists of about 40 entries at most.
    named = met.groupBy("conv", "depth").agg(F.first("chars").alias("chars"), F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("level"), "name"))).alias("names"))
    named = named.select("conv", "depth", "chars", F.transform("names", lambda x: x["name"]).alias("names"))
    root = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<bigint>").alias("names"))
    return root.unionByName(named).join(sizes, "conv")


def _sums_below(rows: DataFrame, values: list[str]) -> DataFrame:
    """Each row's sums of ``values`` over its conversation's rows from its depth on, in windows of at most SPAN depths."""
    spans = rows.withColumn("span", F.floor(F.col("depth") / SPAN))
    totals = spans.groupBy("conv", "span").agg(*[F.sum(v).alias(f"{v}_all") for v in values])
    later = Window.partitionBy("conv").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "span", *[F.coalesce(F.sum(f"{v}_all").over(later), F.lit(0)).alias(f"{v}_later") for v in values])
    within = Window.partitionBy("conv", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = spans.select("*", *[F.sum(v).over(within).alias(f"{v}_own") for v in values]).join(totals, ["conv", "span"])
    return out.select(*rows.columns, *[(F.col(f"{v}_own") + F.col(f"{v}_later")).alias(f"{v}_below") for v in values])


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids, ascending and comma-joined, fed as they come: no list of a node's ids is ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = digest = None
        for batch in batches:
            done: list[tuple] = []
            for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (rep, depth) != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (rep, depth), hashlib.sha256(b"%d" % conv)
                else:
                    digest.update(b",%d" % conv)
            yield _digest_rows(done)
        if node:
            yield _digest_rows([(*node, digest.hexdigest())])

    return ends.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv").mapInArrow(run, "rep long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["rep", "depth", "ends_sha256"])


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv, pos, name, chars), with a row (conv, size) of ``sizes`` each.

    A node is a distinct sequence of the first ``depth`` turns; conversations that begin with it are its members, and
    the smallest of them names it (conv_id) among the nodes of its depth. Columns: conv_id, depth, parent_conv_id (null
    for the root), n_convs (members), n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (over its subtree, members less one times the code points of the node's last text), ends_sha256 (of
    the members that end there).

    Sums over subtrees need no walk: a node counts at its smallest member alone, there a sum runs up from the deepest
    node, and a node's subtree is what these sums have at its depth, over all its members. All rows are those of
    ``turns`` and the roots. A hot node is pre-aggregated, and joined by keys that the adaptive skew join splits;
    windows hold ``SPAN`` rows at most. Without conversations there is no node, not even a root.
    """
    rows = stored(prefixes(turns, sizes), "trie-prefixes")
    nodes = rows.groupBy("depth", "names").agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("size").alias("deepest"), F.first("chars").alias("chars"))
    nodes = stored(nodes, "trie-nodes")
    own = rows.select("conv", "depth", "names", "size").join(nodes.select("depth", "names", "rep", "n_convs", "deepest", "chars"), ["depth", "names"])
    chief = F.col("conv") == F.col("rep")
    own = own.select(
        "conv", "depth", "size", "rep",
        F.when(chief, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"),
        F.when(chief & (F.col("deepest") == F.col("depth")), 1).otherwise(0).cast("long").alias("leaf"),
    )
    own = stored(own, "trie-members")
    sums = _sums_below(own.select("conv", "depth", "rep", "saved", "leaf"), ["saved", "leaf"])
    sums = sums.groupBy("rep", "depth").agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaf_below").alias("n_leaves"))
    above = own.select(F.col("conv").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    parents = stored(nodes.select("rep", "depth", "n_convs").join(above, ["rep", "depth"], "left"), "trie-parents")
    children = parents.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = _digests(own.where("size = depth").select("rep", "depth", "conv"))
    out = parents.join(sums, ["rep", "depth"]).join(children, ["rep", "depth"], "left").join(ends, ["rep", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
