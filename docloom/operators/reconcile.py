"""Reconciliation of remote and local page states into events, and of office and Markdown pairs into actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_events(desired: DataFrame, current: DataFrame, skip_attachments: bool = False, untracked: DataFrame | None = None) -> DataFrame:
    """Events (page_id, kind, current_path, current_version, note) from a full outer join on page_id.

    Both sides have page_id, title, parent_id, status, version, labels; current also attachments_skipped and may have
    path. A page on one side only is NEW or DELETED. Otherwise there is at most one event each of archive, structure
    and content; METADATA_ONLY only if there is none of these and sorted labels or the status differ. Every path of
    ``untracked`` is NEW, without a page id.
    """
    d, c = desired.alias("d"), current.alias("c")
    both = d.join(c, F.col("d.page_id") == F.col("c.page_id"), "full_outer")
    there, here = F.col("d.page_id").isNotNull(), F.col("c.page_id").isNotNull()
    remote, local = F.upper("d.status"), F.upper("c.status")
    drift = ~remote.eqNullSafe(local)
    archive = F.when(drift & (remote == "ARCHIVED"), "ARCHIVE").when(drift & (local == "ARCHIVED"), "UNARCHIVE")
    title, parent = (~F.col(f"d.{x}").eqNullSafe(F.col(f"c.{x}")) for x in ("title", "parent_id"))
    structure = F.when(title & parent, "RENAME_MOVE").when(title, "RENAME").when(parent, "MOVE")
    pull = F.col("d.version") > F.col("c.version")
    if not skip_attachments:
        pull = pull | F.col("c.attachments_skipped")
    content = F.when(pull, "CONTENT_EDIT")
    labels = ~F.sort_array("d.labels").eqNullSafe(F.sort_array("c.labels"))
    quiet = archive.isNull() & structure.isNull() & content.isNull()
    metadata = F.when(quiet & (labels | drift), "METADATA_ONLY")
    tracked = F.array_compact(F.array(archive, structure, content, metadata))
    kinds = F.when(there & ~here, F.array(F.lit("NEW"))).when(here & ~there, F.array(F.lit("DELETED"))).otherwise(tracked)
    path = F.col("c.path").cast("string") if "path" in current.columns else F.lit(None).cast("string")
    found = both.select(F.coalesce("d.page_id", "c.page_id").alias("page_id"), F.explode(kinds).alias("kind"), path.alias("current_path"), F.col("c.version").alias("current_version"), F.lit("").alias("note"))
    if untracked is None:
        return found
    kind = desired.schema["page_id"].dataType
    local = untracked.select(F.lit(None).cast(kind).alias("page_id"), F.lit("NEW").alias("kind"), F.col("path").alias("current_path"), F.lit(None).cast(current.schema["version"].dataType).alias("current_version"), F.lit("local-authored publish candidate").alias("note"))
    return found.unionByName(local)


def upgrade(events: DataFrame, ids: DataFrame, old: str, new: str) -> DataFrame:
    """Events of kind ``old`` become ``new`` for the page ids in ``ids``."""
    marked = ids.select("page_id").distinct().withColumn("_hit", F.lit(True))
    kind = F.when((F.col("kind") == old) & F.col("_hit"), new).otherwise(F.col("kind"))
    return events.join(marked, "page_id", "left").withColumn("kind", kind).select(events.columns)


def cross_space_moves(events: DataFrame, moved: DataFrame) -> DataFrame:
    """DELETED events of pages that are in another space (page_id, space_key) become CROSS_SPACE_MOVE, with a note of the space."""
    known = moved.groupBy("page_id").agg(F.min("space_key").alias("_space"), F.lit(True).alias("_hit"))
    hit = (F.col("kind") == "DELETED") & F.coalesce("_hit", F.lit(False))
    note = F.concat(F.lit("moved to space "), F.coalesce("_space", F.lit("unknown")))
    return events.join(known, "page_id", "left").withColumns({"note": F.when(hit, note).otherwise(F.col("note")), "kind": F.when(hit, "CROSS_SPACE_MOVE").otherwise(F.col("kind"))}).select(events.columns)


def moved_pages(gone: DataFrame, everywhere: DataFrame, space_id: str) -> DataFrame:
    """Of pages that are gone, those that another space has: page_id and its space_key."""
    return everywhere.where(F.col("space_id") != space_id).join(gone.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "space_key")


def locally_edited(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Ids of pages of equal versions on both sides whose file (modified) is newer than its export (exported_at, ISO text)."""
    both = current.alias("c").join(desired.alias("d"), "page_id")
    exported = F.col("c.exported_at").try_cast("timestamp")
    return both.where((F.col("c.version") == F.col("d.version")) & (F.col("c.modified") > exported)).select("page_id").distinct()


def classify_events(desired: DataFrame, current: DataFrame, everywhere: DataFrame, space_id: str, untracked: DataFrame | None = None, skip_attachments: bool = False) -> DataFrame:
    """All events of a space: those of ``page_events``, deletions that are moves, edits on both sides as CONFLICT, metadata of edited pages as LOCAL_PUSH.

    As edits are only looked for at equal versions, a conflict needs attachments that were skipped before.
    """
    events = page_events(desired, current, skip_attachments, untracked)
    events = cross_space_moves(events, moved_pages(events.where("kind = 'DELETED'"), everywhere, space_id))
    edited = locally_edited(current, desired)
    return upgrade(upgrade(events, edited, "CONTENT_EDIT", "CONFLICT"), edited, "METADATA_ONLY", "LOCAL_PUSH")


def event_summary(events: DataFrame) -> DataFrame:
    """One row with a column of counts for each kind of event."""
    kinds = ["NEW", "DELETED", "RENAME", "MOVE", "RENAME_MOVE", "ARCHIVE", "UNARCHIVE", "CONTENT_EDIT", "CONFLICT", "LOCAL_PUSH", "METADATA_ONLY", "CROSS_SPACE_MOVE"]
    counts = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds]
    both = lambda k: F.count_if(F.col("kind").isin(k, "RENAME_MOVE"))
    return events.agg(*counts, both("RENAME").alias("renamed"), both("MOVE").alias("moved"))


def next_state(current: DataFrame, events: DataFrame, desired: DataFrame, no_delete: bool = False) -> DataFrame:
    """The tracked pages after a run: without deleted and moved ones, status by archive events, labels and status by metadata events."""
    gone = events.where(F.col("kind").isin("DELETED", "CROSS_SPACE_MOVE")).select("page_id").distinct()
    left = current if no_delete else current.join(gone, "page_id", "left_anti")
    kinds = events.groupBy("page_id").agg(F.collect_set("kind").alias("_kinds"))
    fresh = desired.select("page_id", F.col("labels").alias("_labels"), F.col("status").alias("_status"))
    rows = left.join(kinds, "page_id", "left").join(fresh, "page_id", "left")
    has = lambda k: F.coalesce(F.array_contains("_kinds", k), F.lit(False))
    status = F.when(has("ARCHIVE"), "archived").when(has("UNARCHIVE"), "current").when(has("METADATA_ONLY"), F.col("_status")).otherwise(F.col("status"))
    return rows.withColumns({"status": status, "labels": F.when(has("METADATA_ONLY"), F.col("_labels")).otherwise(F.col("labels"))}).select(current.columns)


def pair_action(office: Column, markdown: Column, locked: Column, synced: Column, office_same: Column, markdown_same: Column, update_office: Column) -> Column:
    """What to do with an office file and its Markdown: a decision table over flags."""
    return (
        F.when(locked & office, "word_locked")
        .when(~markdown, "first_sync_docx_authoritative")
        .when(~office, "first_sync_md_authoritative")
        .when(~synced, "first_sync_both_docx_wins")
        .when(office_same & markdown_same, "no_op")
        .when(~office_same & markdown_same, "docx_to_md")
        .when(~update_office, "skip_md_update")
        .when(office_same, "md_to_docx")
        .otherwise("diverged")
    )


def writes_office(action: Column) -> Column:
    """Whether an action writes to the office side; a diverged pair counts as one."""
    return action.isin("md_to_docx", "first_sync_md_authoritative", "md_only", "diverged")


def planned_action(action: Column, read_only: bool = False) -> Column:
    """What a run does for a pair: ``skip_read_only`` for writes that it must not make, and the first sync for Markdown alone."""
    return F.when(writes_office(action) & F.lit(read_only), "skip_read_only").when(action == "md_only", "first_sync_md_authoritative").otherwise(action)


def pair_summary(pairs: DataFrame, action: str = "action", name: str = "name") -> DataFrame:
    """Number and sorted names of pairs for each action."""
    return pairs.groupBy(action).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names"))
