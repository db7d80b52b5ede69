"""Files of a mirror: what to do with each, which root holds it, what has to be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import text as fn

#: The action for each extension of an office file, and the extensions that are left out.
CONVERT = {"docx": "convert_docx", "doc": "convert_docx", "pptx": "convert_pptx", "pdf": "convert_pdf"}
LEFT_OUT = ["xlsx", "xls", "png", "jpg", "jpeg", "gif", "svg"]


def file_action(path: Column, has_markdown: Column, ignored: Column, left_out: list[str] = LEFT_OUT) -> Column:
    """Action for a file by its extension; ignored files first, and a Markdown file beside an office file is copied in its place."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    convert = F.create_map(*[F.lit(x) for pair in CONVERT.items() for x in pair])[ext]
    return (
        F.when(ignored, "skip_ignored")
        .when(ext == "md", "copy_markdown")
        .when(ext.isin(left_out), "ignore")
        .when(convert.isNotNull() & has_markdown, "copy_markdown")
        .when(convert.isNotNull(), convert)
        .otherwise("skip_with_warning")
    )


def first_root(path: Column, roots: list[str]) -> Column:
    """The first of the listed roots that is the path or a folder above it."""
    out = F.lit(None).cast("string")
    for root in reversed(roots):
        bare = root.rstrip("/")
        out = F.when((path == bare) | path.startswith(bare + "/"), root).otherwise(out)
    return out


def nearest_ancestor(files: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """Add ``ancestor``: the longest path of ``candidates`` that is a folder above the file; null without one.

    An equi-join on the folders above each path (as many as the path is deep), and a maximum for each path.
    """
    folders = files.select(path).distinct().withColumn("_parts", F.split(path, "/"))
    depth = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(1))))
    above = folders.select(path, "_parts", depth.alias("_k")).where(F.col("_k") < F.size("_parts"))
    above = above.select(path, "_k", F.array_join(F.slice("_parts", 1, F.col("_k")), "/").alias("_above"))
    hits = above.join(candidates.select(F.col(path).alias("_above")).distinct(), "_above")
    best = hits.groupBy(path).agg(F.max_by("_above", "_k").alias("ancestor"))
    return files.join(best, path, "left")


def conversions(files: DataFrame, manifest: DataFrame, version: str, key: str = "path", digest: str = "sha256", outputs: DataFrame | None = None) -> DataFrame:
    """Add ``needed``: whether a file has no manifest entry of the same digest and converter version (one entry a key) whose output exists.

    The entry's ``converted_to`` names its output; ``outputs`` has the files there are (path). Without ``outputs``
    every stated output is taken to exist.
    """
    stated = F.col("converted_to") if "converted_to" in manifest.columns else F.lit("-")
    known = manifest.select(F.col(key), F.col(digest).alias("_digest"), F.col("converter_version").alias("_version"), stated.alias("_output"))
    joined = files.join(known, key, "left")
    there = F.coalesce(F.col("_output") != "", F.lit(False))
    if outputs is not None:
        joined = joined.join(outputs.select(F.col("path").alias("_output"), F.lit(True).alias("_there")).distinct(), "_output", "left")
        there = there & F.coalesce(F.col("_there"), F.lit(False))
    same = F.col(digest).eqNullSafe(F.col("_digest")) & F.col("_version").eqNullSafe(F.lit(version)) & there
    return joined.withColumn("needed", ~same).drop("_digest", "_version", "_output", "_there")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last by the order columns (nulls first); partial maxima keep a hot key small."""
    value = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, F.struct(*order)).alias("_row")).select("_row.*")


def owner(space: Column, ancestors: Column, account: Column, body: Column, rules: list[dict]) -> Column:
    """Name of the first owner by layer: of the space, of a page above, of the account, then by a pattern in the body.

    A rule has a name and any of the lists spaces, subtrees, accounts and patterns.
    """
    lists = lambda part, test: [F.when(test(r[part]), r["name"]) for r in rules if r.get(part)]
    layers = [
        *lists("spaces", space.isin),
        *lists("subtrees", lambda x: F.arrays_overlap(ancestors, F.array(*map(F.lit, x)))),
        *lists("accounts", account.isin),
        *[F.when(body.rlike(p), r["name"]) for r in rules for p in r.get("patterns", [])],
    ]
    return F.coalesce(*layers) if layers else F.lit(None).cast("string")


def body_refused(local: Column, remote: Column, allow_empty: bool = False, allow_shrink: bool = False) -> Column:
    """Why a new body looks like lost content: ``empty`` (nothing but white space), or ``shrunk`` under a tenth of the remote length; else null."""
    whole = F.coalesce(local, F.lit(""))
    blank = ~whole.rlike(r"\S")
    empty = F.when(blank & F.lit(not allow_empty), "empty")
    return F.coalesce(empty, F.when(~blank & (F.length(whole) * 10 < F.length(remote)) & F.lit(not allow_shrink), "shrunk"))


def is_stale(made: Column, source: Column) -> Column:
    """Whether a file made from a source is missing (null time) or older than it."""
    return F.coalesce(made < source, made.isNull())


def remote_ahead(local_version: Column, remote_version: Column) -> Column:
    """Whether the remote page has moved on since the local copy was taken, so that an update must be refused."""
    return F.coalesce(remote_version > local_version, F.lit(False))


def resolve_roots(configured: DataFrame, extra: DataFrame, excluded: DataFrame, path: str = "path") -> DataFrame:
    """Paths of the configured and the extra roots, each once, without the excluded ones."""
    return configured.select(path).union(extra.select(path)).distinct().join(excluded.select(path).distinct(), path, "left_anti")


def filter_sources(roots: DataFrame, wanted: dict[str, list[str]], kind: str = "source_type", name: str = "source_id") -> DataFrame:
    """Roots whose identifier is listed for their source type, without case; no list at all keeps every root."""
    tests = [(F.col(kind) == k) & F.lower(name).isin([v.lower() for v in values]) for k, values in wanted.items() if values]
    out = F.lit(not tests)
    for test in tests:
        out = out | test
    return roots.where(out)


def stale_siblings(files: DataFrame, extension: str, target: str = ".pdf", path: str = "path", at: str = "modified") -> DataFrame:
    """Files of an extension whose copy (their path and ``target``) is missing or older; links and folders named templates are left out."""
    copies = files.select(F.col(path).alias("_copy"), F.col(at).alias("_made"))
    own = files.where(F.lower(path).endswith(extension.lower()) & ~F.col(path).rlike("(^|/)templates/[^/]*$"))
    own = own.where(~F.col("is_link")) if "is_link" in files.columns else own
    return own.join(copies, F.concat(F.col(path), F.lit(target)) == F.col("_copy"), "left").where(is_stale(F.col("_made"), F.col(at))).drop("_copy", "_made")


def file_pairs(sources: DataFrame, outputs: DataFrame, extensions: tuple[str, ...] = (".docx", ".pptx"), path: str = "path") -> DataFrame:
    """office and markdown paths of pairs, relative to their roots, by office path: each office file with its name and ``.md``, and such Markdown files whose office file is absent.

    has_office and has_markdown tell which side there is; hidden files and locks (``~$``) are left out.
    """
    visible = ~F.col(path).rlike(r"(^|/)(\.|~\$)")
    kind = lambda c: F.lower(F.regexp_extract(c, r"[^/](\.[^./]*)$", 1)).isin(*extensions)
    office = sources.where(visible & kind(F.col(path))).select(F.col(path).alias("office"), F.lit(True).alias("_o"))
    stem = F.regexp_replace(path, r"(?i)\.md$", "")
    markdown = outputs.where(visible & F.lower(path).endswith(".md") & kind(stem)).select(stem.alias("office"), F.col(path).alias("_md"), F.lit(True).alias("_m"))
    both = office.join(markdown, "office", "full_outer")
    return both.select("office", F.coalesce("_md", F.concat("office", F.lit(".md"))).alias("markdown"), F.coalesce("_o", F.lit(False)).alias("has_office"), F.coalesce("_m", F.lit(False)).alias("has_markdown")).orderBy("office")


def mirror_state(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of a mirror's Markdown files: path, bucket, page_id, title, parent_id, status, version, space_key, space_id, labels, attachments_skipped.

    Buckets: tracked with a page id; untracked without one but with a space key; attachment_derived for converted
    attachments that nothing else claims; manual for the rest. Two files of one page id stop the job.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("_text"), fm.frontmatter(F.col(text)).alias("_fm"))
    of = lambda k: fm.field(F.col("_fm"), "confluence", k)
    block = F.coalesce(of("page_id"), F.lit("")) != ""
    derived = is_attachment_derived(F.col("path"))
    bucket = F.when(block, "tracked").when(F.coalesce(of("space_key"), F.lit("")) != "", "untracked").when(derived, "attachment_derived").otherwise("manual")
    body = F.coalesce(fn.split_frontmatter(F.col("_text"))["body"], F.col("_text"))
    state = rows.select(
        "path",
        bucket.alias("bucket"),
        F.when(block, of("page_id")).alias("page_id"),
        F.when(block, fn.derived_title(body, F.col("path"))).alias("title"),
        F.nullif(of("parent_id"), F.lit("")).alias("parent_id"),
        F.upper(F.coalesce(F.nullif(of("status"), F.lit("")), F.lit("CURRENT"))).alias("status"),
        F.coalesce(of("version").try_cast("long"), F.lit(0)).alias("version"),
        of("space_key").alias("space_key"),
        of("space_id").alias("space_id"),
        F.coalesce(F.from_json(of("labels"), "array<string>"), F.array().cast("array<string>")).alias("labels"),
        F.coalesce(of("attachments_skipped") == "true", F.lit(False)).alias("attachments_skipped"),
    )
    twice = state.where("bucket = 'tracked'").groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1")
    checked = state.join(F.broadcast(twice.limit(1)), "page_id", "left")  # any such page stops the job
    stop = F.raise_error(F.concat(F.lit("several files have page id "), F.col("page_id"))).cast("string")
    return checked.withColumn("path", F.when(F.col("_n") > 1, stop).otherwise(F.col("path"))).select(state.columns)


def is_attachment_derived(path: Column) -> Column:
    """Whether a path is a converted attachment: by its name, and by a folder above that ends in ``-attachments``."""
    return path.rlike(r"\.(pdf|pptx|docx)\.md$") & path.rlike(r"(^|/)[^/]*-attachments/")


def exceeds(size: Column, most: int | None) -> Column:
    """Whether an attachment is over the size limit, if there is one."""
    return F.coalesce(size > most, F.lit(False)) if most is not None else F.lit(False)


def classify_owner(page_owner: Column, may_update: Column) -> Column:
    """Struct of managed, reason and unverified: an owner's page, else by whether the account may update it (null: unverified)."""
    shape = "struct<managed:boolean,reason:string,unverified:boolean>"
    row = lambda m, r, u: F.struct(F.lit(m).alias("managed"), F.lit(r).alias("reason"), F.lit(u).alias("unverified")).cast(shape)
    return F.when(page_owner.isNotNull(), row(True, "OWNER", False)).when(may_update.isNull(), row(False, None, True)).when(~may_update, row(True, "READ_ONLY", False)).otherwise(row(False, None, False))


def merge_owners(base: DataFrame, override: DataFrame) -> DataFrame:
    """Owner rules by name: lists united in order, a source_url or message of the override in place of the base's unless it is empty."""
    b, o = base.alias("b"), override.alias("o")
    both = b.join(o, F.col("b.name") == F.col("o.name"), "full_outer")
    none = F.array().cast("array<string>")
    lists = [F.array_union(F.coalesce(f"b.{c}", none), F.coalesce(f"o.{c}", none)).alias(c) for c in ("account_ids", "body_marker_patterns")]
    texts = [F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) for c in ("source_url", "message")]
    return both.select(F.coalesce("b.name", "o.name").alias("name"), *lists, *texts)


def attachment_plan(attachments: DataFrame, manifest: DataFrame, most: int | None = None) -> DataFrame:
    """Action of each page's attachment (page_id, filename, version, size): skip_size over the limit, keep if the manifest has its version, else download.

    Of attachments of one name on a page the last (by column ord) counts. The manifest's entry stays where one is skipped.
    """
    last = attachments.groupBy("page_id", "filename").agg(F.max_by(F.struct("version", "size"), "ord").alias("a")).select("page_id", "filename", "a.*")
    known = manifest.select("page_id", "filename", F.col("version").cast("string").alias("_version"))
    action = F.when(exceeds(F.col("size"), most), "skip_size").when(F.col("version").cast("string") == F.col("_version"), "keep").otherwise("download")
    return last.join(known, ["page_id", "filename"], "left").withColumn("action", action).drop("_version")


def wanted_attachments(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """The attachments that a page's references name, each once; references to absent files are left out."""
    return attachments.join(refs.select("page_id", "filename").distinct(), ["page_id", "filename"], "left_semi")
