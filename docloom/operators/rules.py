"""Rule evaluation: name patterns and the gates that they guard, cache validity, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(name: Column, patterns: list[str]) -> Column:
    """The first pattern that a name equals without case, or begins with if the pattern ends in its only ``*``; a lone ``*`` is a name."""
    out = None
    for p in patterns:
        low = p.lower()
        fits = F.lower(name).startswith(low[:-1]) if len(low) > 1 and low.endswith("*") and low.count("*") == 1 else F.lower(name) == low
        out = F.when(fits, p) if out is None else out.when(fits, p)
    return out if out is not None else F.lit(None).cast("string")


def age_days(now: Column, then: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)


def gate(name: Column, patterns: list[str] | None, named: bool = True) -> Column:
    """Why a name is refused: ``no_list`` without any list, ``unknown`` for an empty name while there are patterns, ``listed``; else null.

    ``named=False`` has no rule for empty names.
    """
    if patterns is None:
        return F.lit("no_list")
    empty = F.coalesce(name, F.lit("")) == ""
    unknown = F.when(empty & F.lit(named and bool(patterns)), "unknown")
    return F.coalesce(unknown, F.when(~empty & first_match(name, patterns).isNotNull(), "listed"))


def source_system(segments: Column, declared: Column, marker: str) -> Column:
    """Struct of system and id: what the remote's path segments say, else a declared system (with ``none`` for no mirror), else other."""
    at = F.array_position(segments, marker).cast("int")
    found = F.when((at > 0) & F.get(segments, at).isin("confluence", "sharepoint"), F.struct(F.get(segments, at).alias("system"), F.get(segments, at + 1).alias("id")))
    own = F.when(declared.isNotNull(), F.struct(F.lower(declared).alias("system"), F.lit(None).cast("string").alias("id")))
    return F.coalesce(found, own, F.struct(F.lit("other").alias("system"), F.lit(None).cast("string").alias("id")))


def push_gate(source: Column, spaces: list[str] | None, sites: list[str] | None) -> Column:
    """Why a push is refused: an unknown system, a mirror without its id, or the gate of its system; null lets it through."""
    system, known = source["system"], source["id"].isNotNull()
    return (
        F.when(system == "none", None)
        .when(~system.isin("confluence", "sharepoint"), "unidentified")
        .when(~known, "no_id")
        .when(system == "confluence", gate(source["id"], spaces))
        .otherwise(gate(source["id"], sites, named=False))
    )


def filter_listed(roots: DataFrame, patterns: dict[str, list[str] | None], kind: str = "source_type", name: str = "identifier") -> DataFrame:
    """Roots that no pattern of their source type matches; types without a list stay, and so does everything if a list can't be had."""
    refused = F.lit(False)
    for system, own in patterns.items():
        refused = refused | ((F.col(kind) == system) & first_match(F.col(name), own or []).isNotNull())
    return roots.where(~F.coalesce(refused, F.lit(False)))


def can_update(restrictions: Column, account: Column) -> Column:
    """Whether an account may update a page by its restrictions (JSON): true if none are stated; null if they can't be read.

    Groups aren't looked into: a page that only groups may update is closed.
    """
    users = F.get_json_object(restrictions, "$.update.restrictions.user.results[*].accountId")
    count = lambda who: F.coalesce(F.json_array_length(F.get_json_object(restrictions, f"$.update.restrictions.{who}.results")), F.lit(0))
    listed = F.coalesce(F.array_contains(F.from_json(F.when(users.startswith("["), users).otherwise(F.concat(F.lit("["), users, F.lit("]"))), "array<string>"), account), F.lit(False))
    read = F.try_parse_json(restrictions).isNotNull()
    return F.when(read, ((count("user") == 0) & (count("group") == 0)) | listed)


def valid_entries(cache: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Cache entries that have not expired; a ttl of 0 keeps all; an entry without a time is broken and goes."""
    known = cache.where(F.col(at).isNotNull())
    return known if ttl_seconds == 0 else known.where(F.unix_timestamp(now) - F.unix_timestamp(at) <= ttl_seconds)


def expired_entries(cache: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The entries that a clean-up deletes: those that ``valid_entries`` leaves out."""
    if ttl_seconds == 0:
        return cache.where(F.col(at).isNull())
    return cache.where(F.col(at).isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) > ttl_seconds))


def cache_key(model: Column, task: Column, messages: Column, version: int, extra: Column) -> Column:
    """SHA-256 of a request's JSON (keys in order of names, no blanks) and of extra bytes; messages are an array of content and role."""
    ordered = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    blob = F.to_json(F.struct(ordered.alias("messages"), model.alias("model"), task.alias("task"), F.lit(version).alias("v")))
    return F.sha2(F.concat(blob.cast("binary"), F.coalesce(extra.cast("binary"), F.lit("").cast("binary"))), 256)


def cache_hits(wanted: DataFrame, stored: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Add ``hit``: whether the stored row of a key has equal strings in all columns ``same``; anything null is a miss."""
    known = stored.select(key, *[F.col(c).alias(f"_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return wanted.join(known, key, "left").withColumn("hit", equal).drop(*[f"_{c}" for c in same])


def partition_stale(docs: DataFrame, updated: Column, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Documents older than ``days`` whole days, and the pool of newer ones, which undated ones belong to."""
    stale = F.coalesce(age_days(now, updated.cast("timestamp")) > days, F.lit(False))
    return docs.where(stale), docs.where(~stale)
