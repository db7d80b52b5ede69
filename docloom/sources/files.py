"""Folders of files as tables: Markdown documents, all visible files, page listings, and conversion by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import text as fn
from docloom.operators import ignore


def _relative(folder: str):
    root = folder.removeprefix("file:").rstrip("/") + "/"
    plain = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(plain, r"^[a-z]+:(?://[^/]*)?(?=/)", ""), "^" + "\\Q" + "/" + root.lstrip("/") + "\\E", "")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), text and frontmatter (JSON) of all Markdown files, in order of paths; unreadable files are left out.

    Spark's listing passes over names that begin with a dot or an underscore.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(folder, wholetext=True)
    rows = files.select(_relative(folder).alias("path"), F.col("value").alias("text"))
    return rows.withColumn("frontmatter", fm.frontmatter(F.col("text"))).orderBy("path")


def index_documents(spark: SparkSession, folder: str, name: str = "INDEX.md") -> DataFrame:
    """The documents that an index is made of: all but indexes themselves."""
    return documents(spark, folder).where(F.substring_index("path", "/", -1) != name)


def files(spark: SparkSession, folder: str, lines: list[str] | None = None, content: bool = False) -> DataFrame:
    """path, modified, size (and content) of all files of a folder, in order of paths, without hidden files, locks (``~$``) and what the ignore lines name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows.select(_relative(folder).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if content else []))
    rows = rows.where(~F.col("path").rlike(r"(^|/)(\.|~\$)"))
    return (rows.where(~ignore.is_ignored(F.col("path"), lines)) if lines else rows).orderBy("path")


def with_digest(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add sha256, the hex digest of a file's bytes."""
    return rows.withColumn("sha256", F.sha2(F.col(content), 256))


def desired_pages(listing: DataFrame, page: str = "page", head: int | None = None) -> DataFrame:
    """Wanted states (page_id, title, parent_id, status, version, space_id, labels) of a listing's JSON pages; ``head`` takes the first in order of ids."""
    of = lambda path: F.get_json_object(F.col(page), path)
    labels = F.coalesce(F.from_json(of("$.labels.results[*].name"), "array<string>"), F.array().cast("array<string>"))
    rows = listing.select(of("$.id").alias("page_id"), of("$.title").alias("title"), of("$.parentId").alias("parent_id"), F.coalesce(of("$.status"), F.lit("current")).alias("status"), F.coalesce(of("$.version.number").try_cast("long"), F.lit(0)).alias("version"), of("$.spaceId").alias("space_id"), labels.alias("labels"))
    rows = rows.where("page_id is not null")
    return rows if head is None else rows.orderBy(F.col("page_id").try_cast("long"), "page_id").limit(head)


def repo_names(sites: DataFrame, mapping: DataFrame, site: str = "site") -> DataFrame:
    """Add repo: the mapping's (site, repo), else the site's name in normal form."""
    known = mapping.where(F.col("repo").isNotNull()).groupBy(F.col("site").alias(site)).agg(F.first("repo").alias("_repo"))
    return sites.join(known, site, "left").withColumn("repo", F.coalesce("_repo", fn.repo_name(F.col(site)))).drop("_repo")


#: A converter: a file's bytes to Markdown.
Converter = Callable[[bytes], str]
_converters: dict[str, Converter] = {}


def register(*extensions: str):
    """Register a converter for extensions (with the dot, lower case); the last one registered holds."""

    def add(converter: Converter) -> Converter:
        _converters.update({e.lower(): converter for e in extensions})
        return converter

    return add


def converter_for(extension: str) -> Converter | None:
    """The converter of an extension, if there is one."""
    return _converters.get(extension.lower())


def convert(rows: DataFrame, converters: dict[str, Converter] | None = None) -> DataFrame:
    """path, output (the path and ``.md``), markdown and error of files (path, content) that a converter is registered for.

    A file that its converter fails on has a null text and the error; the others go on.
    """
    known = dict(_converters if converters is None else converters)
    extension = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    chosen = rows.where(extension.isin(*known)).select("path", "content", extension.alias("extension"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content, ext in zip(frame["path"], frame["content"], frame["extension"]):
                try:
                    out.append((path, f"{path}.md", known[ext](bytes(content)), None))
                except Exception as error:  # noqa: BLE001  one broken file must not stop the others
                    out.append((path, f"{path}.md", None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "output", "markdown", "error"])

    return chosen.mapInPandas(run, "path string, output string, markdown string, error string")
