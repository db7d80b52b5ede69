"""Page trees from parent links, level by level in doubling steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored

_ORDER = "array<struct<last:boolean,position:int,title:string>>"


def _cut(df: DataFrame) -> DataFrame:
    """Run a plan once and go on from its table in the shared folder."""
    return stored(df, "trees")


def page_paths(spark: SparkSession, nodes: DataFrame, position: str | None = None) -> DataFrame:
    """node_id, depth, path of titles and sort_key of every node (columns node_id, parent_id, title); roots have no parent.

    A node whose parent is absent is a root. Cycles have no root and yield nothing. Each step joins every node with
    the ancestor that it has come to, which doubles the way, so a tree of depth d takes log2(d) steps. Rows in order
    of sort_key are the tree's: siblings by position (nulls last), then title.
    """
    ids = nodes.select(F.col("node_id").alias("_p"))
    place = F.col(position).cast("int") if position else F.lit(None).cast("int")
    rows = nodes.join(ids, F.col("parent_id") == F.col("_p"), "left")
    own = F.array(F.struct(place.isNull().alias("last"), place.alias("position"), F.col("title").alias("title"))).cast(_ORDER)
    rows = _cut(rows.select("node_id", F.col("_p").alias("up"), F.lit(0).alias("depth"), F.col("title").alias("path"), own.alias("sort_key")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)))
    open_before = -1
    while (left := rows.where("up is not null").count()) and left != open_before:
        open_before = left
        above = rows.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("sort_key").alias("_key"))
        far = F.col("_depth").isNotNull()
        joined = rows.join(above, "up", "left")
        rows = _cut(
            joined.select(
                "node_id",
                F.col("_up").alias("up"),
                F.when(far, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
                F.when(far, F.concat("_path", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"),
                F.when(far, F.concat("_key", "sort_key")).otherwise(F.col("sort_key")).alias("sort_key"),
            )
        )
    return rows.where("up is null").select("node_id", "depth", "path", "sort_key")


def ancestors(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node_id, ancestor_id and height (1 for the parent) of wanted nodes, up to their roots: one join for each level.

    A node on a cycle has each other node of the cycle once.
    """
    links = nodes.where("parent_id is not null").select(F.col("node_id").alias("_n"), F.col("parent_id").alias("_up"))
    there = nodes.select(F.col("node_id").alias("_up")).distinct()
    links = links.join(there, "_up", "left_semi")
    level = wanted.select("node_id").distinct().join(links, F.col("node_id") == F.col("_n")).select("node_id", F.col("_up").alias("ancestor_id"), F.lit(1).alias("height"))
    out, height = None, 1
    while True:
        level = _cut(level)
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        height += 1
        step = level.join(links, F.col("ancestor_id") == F.col("_n")).select("node_id", F.col("_up").alias("ancestor_id"), F.lit(height).alias("height"))
        level = step.where("node_id <> ancestor_id").join(out.select("node_id", "ancestor_id"), ["node_id", "ancestor_id"], "left_anti")


def move_chain(nodes: DataFrame, parent: DataFrame, folders: DataFrame, files: DataFrame, space: str, root: str = "") -> DataFrame:
    """Steps from the top to a new parent (node_id), itself included: its folder and whether that is there (dir), only its file is (flat), or neither (absent).

    ``nodes`` have node_id, parent_id, name and space; a step of another space stops the job. ``folders`` and
    ``files`` have the paths there are.
    """
    up = ancestors(nodes, parent).select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("of"), "height")
    chain = up.unionByName(parent.select("node_id", F.col("node_id").alias("of"), F.lit(0).alias("height"))).join(nodes.select("node_id", "name", "space"), "node_id")
    names = chain.groupBy("of").agg(F.reverse(F.array_sort(F.collect_list(F.struct("height", "node_id", "name", "space")))).alias("steps"))
    prefix = F.lit(f"{root}/") if root else F.lit("")
    path = lambda i: F.concat(prefix, F.array_join(F.transform(F.slice("steps", 1, i + 1), lambda s: s["name"]), "/"))
    steps = names.select(F.explode(F.transform("steps", lambda s, i: F.struct(i.alias("step"), s["node_id"].alias("node_id"), s["space"].alias("space"), path(i).alias("folder")))).alias("s")).select("s.*")
    stop = F.raise_error(F.concat(F.lit("a page above is in space "), F.col("space"))).cast("string")
    checked = steps.withColumn("folder", F.when(F.col("space") != space, stop).otherwise(F.col("folder")))
    there = folders.select(F.col("path").alias("folder"), F.lit(True).alias("_dir")).distinct()
    flat = files.select(F.regexp_replace("path", r"\.md$", "").alias("folder"), F.lit(True).alias("_flat")).where(F.col("folder").isNotNull()).distinct()
    joined = checked.join(there, "folder", "left").join(flat, "folder", "left")
    return joined.select("step", "node_id", "folder", F.when(F.col("_dir"), "dir").when(F.col("_flat"), "flat").otherwise("absent").alias("state"))
