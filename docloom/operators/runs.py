"""State between runs: a versioned table in a folder, and runs that plan, apply and keep what they did."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reconcile
from .store import stored

#: What is done with events in tasks: takes their rows and adds ``error``, null where an event took effect.
Apply = Callable[[DataFrame], DataFrame]


#: A version's file that is still empty after so many seconds belongs to a run that died.
GIVEN_UP_S = 600


class LostRace(RuntimeError):
    """Another run kept the same version first; nothing of this one counts."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: jvm.org.apache.hadoop.fs.Path(p)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a state that are kept, ascending. A folder that isn't there has none."""
    fs, at = _file_system(spark, folder)
    log = at(f"{folder}/versions")
    found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n.removesuffix(".json")) for n, size in found if n.endswith(".json") and size)


def details(spark: SparkSession, folder: str, version: int) -> dict:
    """What a version's run said of itself: its table's name, run id and counts."""
    rows = spark.read.text(f"{folder}/versions/{version:012d}.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def load(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> tuple[int, DataFrame]:
    """The newest version (or the one asked for) and its table; version 0 is empty."""
    known = versions(spark, folder)
    version = (known[-1] if known else 0) if version is None else version
    if version == 0:
        return 0, spark.createDataFrame([], schema)
    return version, spark.read.schema(schema).parquet(f"{folder}/{details(spark, folder, version)['table']}")


def keep(state: DataFrame, folder: str, after: int, run_id: str, counts: dict[str, int] | None = None) -> int:
    """Write a table, then make it the version that follows ``after``; raises ``LostRace`` if there is one already.

    The table is whole before its version's file is made, which only one writer can do: a run that dies before has
    changed nothing (its table is never read), and no reader sees half a table. The file is one small write; one that
    a run left empty by dying in it is passed over by ``versions`` and written over here.
    """
    spark = state.sparkSession
    table = f"table-{after + 1:012d}-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{table}")
    fs, at = _file_system(spark, folder)
    text = json.dumps({"table": table, "run": run_id, "counts": counts or {}}, sort_keys=True)
    name = at(f"{folder}/versions/{after + 1:012d}.json")
    if fs.exists(name) and not fs.getFileStatus(name).getLen() and time.time() - fs.getFileStatus(name).getModificationTime() / 1000 > GIVEN_UP_S:
        fs.delete(name, False)
    try:
        stream = fs.create(name, False)  # fails if it is there
    except Exception as error:
        raise LostRace(f"version {after + 1} of {folder} is there already") from error
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return after + 1


@dataclass
class Run:
    """A run's version (that before, if nothing changed), its events with ``error``, and their numbers by kind."""

    version: int
    events: DataFrame
    changed: bool
    counts: dict[str, int] = field(default_factory=dict)

    def listed(self, kind: str, column: str = "page_id") -> DataFrame:
        """The pages of one kind of event, in order."""
        return self.events.where((F.col("kind") == kind) & F.col("error").isNull()).select(column).orderBy(column)

    def message(self, subject: str) -> str:
        """A text for the change: the subject, then a line for each kind, and one for what failed."""
        lines = [f"{k}: {n}" for k, n in sorted(self.counts.items()) if n]
        return "\n".join([subject, "", *lines]) if lines else subject


def _run(spark: SparkSession, folder: str, version: int, events: DataFrame, apply: Apply, state_after: Callable[[DataFrame], DataFrame], run_id: str | None) -> Run:
    done = stored(apply(events), "run-events")
    kind = F.when(F.col("error").isNull(), F.col("kind")).otherwise("failed")
    counts = {r["k"]: r["n"] for r in done.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()}  # as many as kinds
    if not sum(n for k, n in counts.items() if k != "failed"):
        return Run(version, done, False, counts)
    new = keep(state_after(done.where("error is null")), folder, version, run_id or uuid.uuid4().hex, counts)
    return Run(new, done, True, counts)


def nothing_fails(events: DataFrame) -> DataFrame:
    """An ``Apply`` that has nothing to do outside the state."""
    return events.withColumn("error", F.lit(None).cast("string"))


STATE = "page_id string, title string, parent_id string, status string, version long, labels array<string>, attachments_skipped boolean, path string, exported_at string, modified timestamp"
#: Kinds of events that bring a page to what the remote side has, those that end it here, and those that only tell something.
PULLED = ("NEW", "RENAME", "MOVE", "RENAME_MOVE", "CONTENT_EDIT", "ARCHIVE", "UNARCHIVE", "METADATA_ONLY", "LOCAL_PUSH")
ENDED = ("DELETED", "CROSS_SPACE_MOVE")


def sync_space(spark: SparkSession, folder: str, desired: DataFrame, everywhere: DataFrame, space_id: str, apply: Apply = nothing_fails, paths: DataFrame | None = None, now: str | None = None, skip_attachments: bool = False, no_delete: bool = False, run_id: str | None = None) -> Run:
    """One run of a space's sync against the state kept in ``folder``: events, their application, the next version.

    ``desired`` pages have page_id, title, parent_id, status, version, labels; ``paths`` (page_id, path) gives new files.
    ``apply`` gets the events (page_id, kind, current_path, current_version, note) and says what failed, row by row: a
    page with an event that failed keeps its old state and comes up again in the next run; CONFLICT changes nothing.
    A run that finds nothing to do keeps no version. A run that dies keeps none either, and is simply run again; of
    two at once, one raises ``LostRace``.
    """
    version, state = load(spark, folder, STATE)
    desired = desired.withColumn("page_id", F.col("page_id").cast("string"))
    events = reconcile.classify_events(desired, state, everywhere, space_id, skip_attachments=skip_attachments)
    events = events.where(~F.col("kind").isin(*ENDED)) if no_delete else events

    def after(done: DataFrame) -> DataFrame:
        kinds = done.groupBy("page_id").agg(F.collect_set("kind").alias("kinds"))
        failed = whole.where("error is not null").select("page_id").distinct()
        kinds = kinds.join(failed, "page_id", "left_anti")
        ended = kinds.where(F.arrays_overlap("kinds", F.array(*map(F.lit, ENDED)))).select("page_id")
        pulled = kinds.where(F.arrays_overlap("kinds", F.array(*map(F.lit, PULLED))) & ~F.array_contains("kinds", "CONFLICT")).select("page_id")
        fresh = desired.join(pulled, "page_id", "left_semi")
        fresh = fresh.join(paths.select("page_id", F.col("path").alias("_new")), "page_id", "left") if paths is not None else fresh.withColumn("_new", F.lit(None).cast("string"))
        old = state.select("page_id", F.col("path").alias("_old"), F.col("modified").alias("_modified"))
        fresh = fresh.join(old, "page_id", "left").select(
            "page_id", "title", F.col("parent_id").cast("string").alias("parent_id"), "status", F.col("version").cast("long").alias("version"), "labels",
            F.lit(skip_attachments).alias("attachments_skipped"), F.coalesce("_new", "_old").alias("path"), F.lit(now).cast("string").alias("exported_at"), F.lit(now).cast("timestamp").alias("modified"),
        )
        rest = state.join(pulled, "page_id", "left_anti").join(ended, "page_id", "left_anti")
        return rest.unionByName(fresh)

    whole = stored(apply(events), "run-applied")
    return _run(spark, folder, version, whole, lambda e: e, after, run_id)


PAIRS = "markdown string, office_sha256 string, md_sha256 string, update_office boolean"


def sync_folder(spark: SparkSession, folder: str, plan: Callable[[DataFrame], DataFrame], digests: Callable[[DataFrame], DataFrame], apply: Apply = nothing_fails, quiet: tuple[str, ...] = ("no_op", "skip_md_update", "skip_read_only", "word_locked", "diverged"), run_id: str | None = None) -> Run:
    """One run of a folder's sync of office files and Markdown against the pairs' state kept in ``folder``.

    ``plan`` gets the state and gives the actions (office, markdown, action), as ``api.plan_folder`` does; ``apply`` makes
    them and says what failed; ``digests`` gives (markdown, office_sha256, md_sha256) of pairs after that. Pairs of
    ``quiet`` actions and failed ones keep their state.
    """
    version, state = load(spark, folder, PAIRS)
    events = plan(state).withColumnRenamed("action", "kind").where(~F.col("kind").isin(*quiet))

    def after(done: DataFrame) -> DataFrame:
        fresh = digests(done.select("office", "markdown", "kind")).select("markdown", "office_sha256", "md_sha256")
        old = state.select("markdown", "update_office")
        fresh = fresh.join(old, "markdown", "left").select("markdown", "office_sha256", "md_sha256", F.coalesce("update_office", F.lit(True)).alias("update_office"))
        return state.join(fresh.select("markdown"), "markdown", "left_anti").unionByName(fresh)

    return _run(spark, folder, version, events, apply, after, run_id)
