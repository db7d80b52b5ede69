"""Frontmatter of documents: reading, line ranges, merging, and the body after it."""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import date_in, split_frontmatter

# Fixed value: phrases before a date in a body that say when it was last brought up to date.
AGE = r"(?i)(?:as of|last reviewed|updated)[^\d]*(\d{4}[-/]\d{2}[-/]\d{2})"


def _plain(value: object) -> object:
    """A value that JSON lacks: dates as an object with one key, so that they aren't taken for strings."""
    return {"@date": value.isoformat()} if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def _mapping(text: str | None) -> dict | None:
    import yaml

    try:
        value = yaml.safe_load(text) if text else None
    except yaml.YAMLError:
        return None
    return value if isinstance(value, dict) else None


def _dump(mapping: dict) -> str:
    import yaml

    return yaml.safe_dump(mapping, default_flow_style=False, sort_keys=False, allow_unicode=True)


@F.pandas_udf(T.StringType())
def yaml_mapping(text: pd.Series) -> pd.Series:
    """JSON of a YAML mapping, keys in their order; null for empty or broken YAML and for anything but a mapping."""
    found = [_mapping(t) for t in text]
    return pd.Series([None if m is None else json.dumps({str(k): v for k, v in m.items()}, default=_plain, ensure_ascii=False) for m in found], dtype=object)


def json_mapping(text: Column) -> Column:
    """The JSON object that a text is, as it stands; null for anything else."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), text)


def field(mapping: Column, *keys: str) -> Column:
    """The value below some keys of a JSON mapping, as a string; null if it isn't there."""
    return F.get_json_object(mapping, "$" + "".join(f"['{k}']" for k in keys))


def frontmatter(text: Column) -> Column:
    """JSON of a document's frontmatter; null without a mapping there."""
    return yaml_mapping(split_frontmatter(text)["yaml"])


def page_id(mapping: Column) -> Column:
    """The page id at the top of a mapping, else below its ``confluence`` key."""
    return F.coalesce(field(mapping, "page_id"), field(mapping, "confluence", "page_id"))


def body(text: Column) -> Column:
    """The text after its frontmatter. What a CRLF opener leaves over stays outside; an unclosed block is body."""
    opens = text.startswith("---\n") | text.startswith("---\r\n")
    rest = F.substring(text, F.lit(5), F.length(text))
    at = F.locate("\n---\n", rest)
    after = F.when(at > 0, F.substring(rest, at + 5, F.length(rest))).when(rest.endswith("\n---"), "").otherwise(text)
    return F.when(opens, after).otherwise(text)


def line_range(text: Column, most: int = 200) -> Column:
    """Struct of the first and last line of the frontmatter, within the first ``most`` lines; null without one."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, most), lambda x: F.regexp_replace(x, r"[\r\n]+$", ""))
    close = F.array_position(F.slice(lines, 2, most - 1), "---").cast("int")
    return F.when((F.get(lines, F.lit(0)) == "---") & (close > 0), F.struct(F.lit(1).alias("start"), (close + 1).alias("end")))


def in_range(line_no: Column, lines: Column) -> Column:
    """Whether a line lies in the frontmatter; false without one."""
    return F.coalesce(line_no.between(lines["start"], lines["end"]), F.lit(False))


def updated_at(text: Column, mapping: Column) -> Column:
    """When a document was brought up to date: a date string in the mapping, else the first valid date after a phrase."""
    stated = [F.when(~field(mapping, k).startswith("{"), date_in(field(mapping, k))) for k in ("updated_at", "last_modified", "date")]
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(AGE), F.lit(1)), date_in), lambda d: d.isNotNull())
    return F.coalesce(*stated, F.get(phrases, F.lit(0)))


def is_managed(mapping: Column) -> Column:
    """Whether ``managed_by`` below the mapping's ``confluence`` key has a value that isn't empty, zero or false."""
    value = field(mapping, "confluence", "managed_by")
    return F.coalesce(~value.isin("", "0", "false", "null", "[]", "{}", "0.0"), F.lit(False))


def without_source_block(text: Column, key: str = "sharepoint") -> Column:
    """The body alone if a line of the frontmatter begins with the key; any other frontmatter stays."""
    parts = split_frontmatter(text)
    return F.when(parts["yaml"].rlike(rf"(?m)^{key}:"), parts["body"]).otherwise(text)


def with_frontmatter(yaml: Column, text: Column) -> Column:
    """A document of a frontmatter block (YAML with a newline at its end) and a body."""
    return F.concat(F.lit("---\n"), yaml, F.lit("---\n"), text)


def export_callout(place: Column, exported_at: Column, title: str, master: str) -> Column:
    """The quoted note over an exported document: what it was exported from, on which day, where its master copy lives."""
    return F.concat(F.lit(f"> **{title}**\n>\n> This page was exported from `"), place, F.lit("` on\n> "), F.substring(exported_at, 1, 10), F.lit(f". The master copy lives in {master}.\n"))


def _upsert(path: list[str]):
    @F.pandas_udf(T.StringType())
    def put(text: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for block, own in zip(text, value):
            mapping = _mapping(block) or {}
            inner = mapping
            for key in path[:-1]:
                inner[key] = inner[key] if isinstance(inner.get(key), dict) else {}
                inner = inner[key]
            inner[path[-1]] = json.loads(own)
            out.append(_dump(mapping))
        return pd.Series(out, dtype=object)

    return put


def put_key(yaml: Column, value: Column, *path: str) -> Column:
    """A YAML mapping with a value (JSON) at a path of keys; all other keys stay in their order."""
    return _upsert(list(path))(yaml, value)


def merge_source(text: Column, value: Column, callout: Column, key: str = "sharepoint") -> Column:
    """A document with a source's mapping (JSON) in its own frontmatter and the callout before its body; unchanged without frontmatter."""
    parts = split_frontmatter(text)
    merged = with_frontmatter(put_key(parts["yaml"], value, key), F.concat(callout, F.lit("\n"), parts["body"]))
    return F.when(parts.isNotNull(), merged).otherwise(text)


def put_sync(text: Column, state: Column, key: str = "sharepoint") -> Column:
    """A document with a sync state (JSON) below ``key.sync``; without frontmatter a block is put before it."""
    parts = split_frontmatter(text)
    yaml = put_key(F.coalesce(parts["yaml"], F.lit("")), state, key, "sync")
    return with_frontmatter(yaml, F.when(parts.isNotNull(), parts["body"]).otherwise(text))


@F.pandas_udf(T.StringType())
def _without_sync(text: pd.Series, key: pd.Series) -> pd.Series:
    out = []
    for block, name in zip(text, key):
        mapping = _mapping(block)
        if mapping is not None and isinstance(mapping.get(name), dict):
            mapping[name] = {k: v for k, v in mapping[name].items() if k != "sync"}
        out.append(None if mapping is None else _dump(mapping))
    return pd.Series(out, dtype=object)


def content_hash(text: Column, key: str = "sharepoint") -> Column:
    """SHA-256 of a document whose sync state is left out and whose frontmatter is written anew, so that syncing changes no hash."""
    parts = split_frontmatter(text)
    plain = with_frontmatter(_without_sync(parts["yaml"], F.lit(key)), parts["body"])
    return F.sha2(F.coalesce(plain, text).cast("binary"), 256)


def keep_other_keys(converted: Column, existing: Column, key: str = "sharepoint") -> Column:
    """A converted body below the frontmatter of the existing document without the source's key; bare if nothing is left of it."""

    @F.pandas_udf(T.StringType())
    def others(text: pd.Series) -> pd.Series:
        left = [{k: v for k, v in (_mapping(t) or {}).items() if k != key} for t in text]
        return pd.Series([_dump(m) if m else None for m in left], dtype=object)

    return F.coalesce(with_frontmatter(others(split_frontmatter(existing)["yaml"]), converted), converted)
