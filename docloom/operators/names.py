"""Names that must not collide within a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fn


def sibling_names(nodes: DataFrame, parent: str = "parent_id", key: str = "node_id", title: str = "title", position: str | None = None) -> DataFrame:
    """Add ``name``: the safe title, or the id without a title; all but the first of equal names of a folder get ``(id)``.

    First is by position (nulls last), title, id. The first of each name comes from an aggregate and a join, so that a
    folder of many equal names isn't sorted in one task. A null parent is a folder of its own.
    """
    named = nodes.withColumn("name", F.coalesce(fn.safe_name(F.when(F.col(title) != "", F.col(title))), F.col(key).cast("string")))
    place = F.col(position) if position else F.lit(0)
    first = named.groupBy(F.col(parent).alias("_parent"), F.col("name").alias("_name")).agg(F.min_by(key, F.struct(place.isNull(), place, title, key)).alias("_first"))
    joined = named.join(first, F.col(parent).eqNullSafe(F.col("_parent")) & (F.col("name") == F.col("_name")))
    other = F.concat("name", F.lit("("), F.col(key).cast("string"), F.lit(")"))
    return joined.withColumn("name", F.when(F.col(key) == F.col("_first"), F.col("name")).otherwise(other)).drop("_parent", "_name", "_first")


def collided_paths(pages: DataFrame, folder: str = "folder", name: str = "name", key: str = "page_id") -> DataFrame:
    """Add ``path``: ``folder/name.md``, or ``folder/name (id).md`` for each page whose name another page of the folder has."""
    counts = pages.groupBy(F.col(folder).alias("_folder"), F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    joined = pages.join(counts, F.col(folder).eqNullSafe(F.col("_folder")) & F.col(name).eqNullSafe(F.col("_name")))
    tail = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col(key).cast("string"), F.lit(")"))).otherwise("")
    return joined.withColumn("path", F.concat(F.col(folder), F.lit("/"), F.col(name), tail, F.lit(".md"))).drop("_folder", "_name", "_n")


def disambiguated(pages: DataFrame, taken: DataFrame, path: str = "path", key: str = "page_id", most: int = 10) -> DataFrame:
    """Paths of pages where ``taken`` (path, page_id) has files: ``Stem(id).ext``, then ``Stem(id)(2).ext`` up to ``most``, unless free or the page's own.

    A page that finds none free stops the job.
    """
    stem, ext = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    bare = F.concat(stem, F.lit("("), F.col(key).cast("string"), F.lit(")"))
    choices = F.array(F.col(path), F.concat(bare, ext), *[F.concat(bare, F.lit(f"({n})"), ext) for n in range(2, most + 1)])
    tried = pages.select(F.col(path).alias("_path"), F.col(key).alias("_key"), F.posexplode(choices).alias("_n", "_try"))
    own = taken.select(F.col("path").alias("_try"), F.col("page_id").alias("_owner"), F.lit(True).alias("_there"))
    joined = tried.join(own, "_try", "left")
    # Only the plain path and the first choice may be the page's own file.
    good = F.col("_there").isNull() | ((F.col("_n") < 2) & F.col("_owner").eqNullSafe(F.col("_key")))
    best = joined.groupBy("_path", "_key").agg(F.min(F.when(good, F.struct("_n", "_try")))["_try"].alias("_best"))
    out = pages.join(best, (F.col(path) == F.col("_path")) & F.col(key).eqNullSafe(F.col("_key")))
    stop = F.raise_error(F.concat(F.lit("too many files are named "), F.col(path))).cast("string")
    return out.withColumn(path, F.coalesce("_best", stop)).drop("_path", "_key", "_best")


def renamed_paths(pages: DataFrame, used: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``new_path`` to renamed or moved pages (current_path, title, folder, page_id): ``folder/Safe.md``, or ``folder/Safe (id).md``.

    The second if the first is another file's (of ``used``, column path) or an earlier page's of this run, by page id.
    A page without a title is ``page-id``.
    """
    title = F.when(F.col("title") != "", fn.safe_name(F.col("title")))
    name = F.coalesce(title, F.concat(F.lit("page-"), F.col(key).cast("string")))
    rows = pages.withColumns({"_name": name, "_path": F.concat("folder", F.lit("/"), name, F.lit(".md"))})
    first = rows.groupBy("_path").agg(F.min(key).alias("_first"))
    known = used.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    joined = rows.join(first, "_path").join(known, "_path", "left")
    clash = (F.col("_path") != F.col("current_path")) & (F.col("_there").isNotNull() | (F.col(key) != F.col("_first")))
    other = F.concat("folder", F.lit("/"), "_name", F.lit(" ("), F.col(key).cast("string"), F.lit(").md"))
    return joined.withColumn("new_path", F.when(clash, other).otherwise(F.col("_path"))).drop("_name", "_path", "_first", "_there")


def first_of_each(blobs: DataFrame, content: str = "content", order: str = "ord") -> DataFrame:
    """Stored images: of blobs of equal content the first, with ``hash``, the beginning of its SHA-1, for a name."""
    hashed = blobs.withColumn("hash", fn.short_hash(F.col(content)))
    return hashed.groupBy("hash").agg(F.min_by(F.struct(*blobs.columns), order).alias("_row")).select("_row.*", "hash")
