"""What a user runs: search, review, index, rewrite, plans of a space's and a folder's sync, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import ignore, mirrors, reconcile, review, rules
from docloom.operators import search as lines
from docloom.operators.store import stored
from docloom.sources import files


def search(spark: SparkSession, query: str, roots: list[dict], patterns: dict[str, list[str] | None] | None = None, per_document: int = 50, limit: int = 200, include_frontmatter: bool = False, kind: str = "*.md") -> DataFrame:
    """Matches of a smart-case query in the roots (dicts of path, mirror_name, source_type, identifier), with titles, page ids and mirrors.

    A root may name another ``format`` (with ``options``) than a folder of files: any data source that is registered with
    the session (``spark.dataSource.register``) and gives path and text; paths are then relative to the root's.
    Roots that the blacklist names are left out; a cap for each document, then the first ``limit`` in order.
    """
    known = spark.createDataFrame([tuple(str(r[k]) for k in ("path", "mirror_name", "source_type", "identifier")) for r in roots], "path string, mirror_name string, source_type string, identifier string")
    kept = {r.path for r in rules.filter_listed(known, patterns or {}).collect()}  # as many as there are roots
    roots = [r for r in roots if str(r["path"]) in kept]
    found = None
    for root in roots:
        if root.get("format"):
            rows = spark.read.format(root["format"]).options(**root.get("options", {})).load()
            docs = rows.select(F.concat(F.lit(root["path"].rstrip("/") + "/"), "path").alias("path"), "text")
        else:
            rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", kind).text(root["path"], wholetext=True)
            docs = rows.select(F.concat(F.lit(root["path"].rstrip("/") + "/"), files._relative(root["path"])).alias("path"), F.col("value").alias("text"))
        own = lines.with_metadata(lines.search_lines(docs, query, "path", "text", per_document), docs, roots, include_frontmatter=include_frontmatter)
        found = own if found is None else found.unionByName(own)
    if found is None:
        shape = "path string, line_no int, line string, n_matches long, title string, page_id string, mirror string, display_path string"
        return spark.createDataFrame([], shape)
    return lines.total_limit(found, limit, "path")


def review_report(docs: DataFrame, model: review.Model, modes: list[str], scope: str, date: str, now: Column, days: int, instructions: dict[str, str], k: int = 5, cache: review.Cache = None) -> DataFrame:
    """One row with the report of the modes (duplicates, inconsistencies, stale) over documents (path, text), and the run's counts.

    With an ``AnswerStore`` as cache answers are kept as they come, and a second run asks nothing.
    """
    asked = {
        "duplicates": lambda: review.judged_duplicates(docs, model, instructions["duplicates"], k=k, cache=cache),
        "inconsistencies": lambda: review.judged_duplicates(docs, model, instructions["inconsistencies"], k=k, least=0.0, cache=cache),
        "stale": lambda: review.judged_stale(docs, model, instructions["stale"], now, days, cache=cache),
    }
    found = {"duplicates": review.duplicate_findings, "inconsistencies": review.inconsistency_findings, "stale": review.stale_findings}
    answers = {mode: stored(asked[mode](), "review-answers") for mode in modes}
    return review.report_text({mode: found[mode](rows) for mode, rows in answers.items()}, scope, date, review.ask_counts(list(answers.values())))


def index(docs: DataFrame, model: review.Model, instruction: str, clustered: bool = False, topics: str | None = None, cache: review.Cache = None) -> DataFrame:
    """One row with the index of documents (path, text): a summary each, in topics if asked for.

    ``topics`` is the instruction by which the model names them; without it all is one topic. With an ``AnswerStore``
    as cache, answers are kept, and a second index asks nothing that is known.
    """
    made = stored(review.summaries(docs, model, instruction, cache=cache), "summaries")
    if not clustered:
        return review.index_text(made)
    return review.index_text(made, review.topics(made, model, topics, cache=cache) if topics else review.one_cluster(made))


def rewrite(docs: DataFrame, model: review.Model, instruction: str) -> DataFrame:
    """path, rewritten, changed and error of documents (path, text)."""
    return review.rewrites(docs, model, instruction)


def plan_space(desired: DataFrame, mirror: DataFrame, everywhere: DataFrame, space: str, space_id: str, patterns: list[str] | None, ignored: list[str] | None = None) -> DataFrame:
    """Events of a space's sync, after its gate: a refused space stops the job.

    ``desired`` pages may have md_rel and child_rel, by which the ignore lines leave out untracked ones; ``mirror`` is
    of ``mirrors.mirror_state``, with exported_at and modified.
    """
    spark = desired.sparkSession
    refused = spark.range(1).select(rules.gate(F.lit(space), patterns).alias("r")).first().r
    if refused:
        raise ValueError(f"space {space!r} is refused: {refused}")
    tracked = mirror.where("bucket = 'tracked'")
    if ignored:
        desired, _ = ignore.filter_desired(desired, tracked, ignored)
    return reconcile.classify_events(desired, tracked, everywhere, space_id, mirror.where("bucket = 'untracked'").select("path"))


def plan_folder(sources: DataFrame, outputs: DataFrame, synced: DataFrame, read_only: bool = False, head: int | None = None) -> DataFrame:
    """office, markdown and action of each pair of files (path, sha256; locked), by office path; ``head`` takes the first.

    ``synced`` has a pair's state: markdown, office_sha256, md_sha256, update_office.
    """
    pairs = mirrors.file_pairs(sources, outputs)
    pairs = pairs.limit(head) if head is not None else pairs
    own = sources.select(F.col("path").alias("office"), F.col("sha256").alias("_o"), "locked")
    md = outputs.select(F.col("path").alias("markdown"), F.col("sha256").alias("_m"))
    rows = pairs.join(own, "office", "left").join(md, "markdown", "left").join(synced, "markdown", "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = reconcile.pair_action(there("has_office"), there("has_markdown"), there("locked"), F.col("office_sha256").isNotNull(), F.col("_o").eqNullSafe(F.col("office_sha256")), F.col("_m").eqNullSafe(F.col("md_sha256")), F.coalesce("update_office", F.lit(True)))
    return rows.select("office", "markdown", reconcile.planned_action(action, read_only).alias("action")).orderBy("office")


def list_sites(folders: DataFrame, mapping: DataFrame) -> DataFrame:
    """site and repo of local folders (name), by site."""
    return files.repo_names(folders.select(fn.site_name(F.col("name")).alias("site")).distinct(), mapping).orderBy("site")


def rename_page(state: DataFrame, page_id: str, title: str) -> DataFrame:
    """The state with a page's title, address and file name changed."""
    hit = F.col("page_id") == page_id
    changed = {"title": F.when(hit, title).otherwise(F.col("title"))}
    if "url" in state.columns:
        changed["url"] = F.when(hit, fn.url_with_title(F.col("url"), F.lit(title))).otherwise(F.col("url"))
    if "path" in state.columns:
        changed["path"] = F.when(hit, F.concat(F.regexp_extract("path", "^(.*/)?", 0), fn.safe_name(F.lit(title)), F.lit(".md"))).otherwise(F.col("path"))
    return state.withColumns(changed)


def move_page(state: DataFrame, page_id: str, parent_id: str) -> DataFrame:
    """The state with a page below another parent; a parent of another space stops the job."""
    parent = state.where(F.col("page_id") == parent_id).select(F.col("space_id").alias("_space")).limit(1)
    joined = state.join(F.broadcast(parent), how="left")  # one row
    stop = F.raise_error(F.lit("the new parent is in another space")).cast("string")
    new = F.when(F.col("_space") != F.col("space_id"), stop).otherwise(F.lit(parent_id))
    return joined.withColumn("parent_id", F.when(F.col("page_id") == page_id, new).otherwise(F.col("parent_id"))).drop("_space")


def archive_page(state: DataFrame, page_id: str, archived: bool = True) -> DataFrame:
    """The state with a page archived, or current again."""
    return state.withColumn("status", F.when(F.col("page_id") == page_id, "archived" if archived else "current").otherwise(F.col("status")))


def convert(spark: SparkSession, folder: str, lines: list[str] | None = None) -> DataFrame:
    """Markdown of all files of a folder that a converter is registered for."""
    return files.convert(files.files(spark, folder, lines, content=True))
