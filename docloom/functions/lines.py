"""Cleaning of converted bodies by lines, and protected regions of a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a table of contents looks like, and the placeholder of a dropped image.
TOC_HEADING = r"(?i)^(?:#{7,}\s.*|#{1,6}\s+(?:table\s+of\s+contents|contents))\s*$"
TOC_LINE = r"^(?:\s*(?:\d+\.|\*|-)\s+.+\d+\s*|\d+(?:\.\d+)*\t.+\t\d+\s*)$"
IMAGE, DROPPED = "<!-- image -->", "<!-- image dropped -->"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def without_toc(text: Column, heading: str = TOC_HEADING, line: str = TOC_LINE) -> Column:
    """A text without its tables of contents: a heading, if one of the next three lines with text (of nine) is an entry, and what follows of entries and blank lines."""
    lines = _lines(text)
    state = "struct<in:boolean,out:array<string>>"

    def step(have: Column, x: Column) -> Column:
        near = F.slice(F.filter(F.slice(lines, x["i"] + 2, 9), lambda s: s.rlike(r"\S")), 1, 3)
        opens = x["line"].rlike(heading) & F.exists(near, lambda s: s.rlike(line))
        skips = have["in"] & (~x["line"].rlike(r"\S") | x["line"].rlike(line))
        return F.struct((opens | skips).alias("in"), F.when(opens | skips, have["out"]).otherwise(F.concat(have["out"], F.array(x["line"]))).alias("out")).cast(state)

    numbered = F.transform(lines, lambda s, i: F.struct(i.alias("i"), s.alias("line")))
    start = F.struct(F.lit(False).alias("in"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.array_join(F.aggregate(numbered, start, step, lambda s: s["out"]), "\n")


def without_sections(text: Column, title: str) -> Column:
    """A text without the sections whose heading's title matches: up to the next heading of the same or a higher level."""
    state = "struct<level:int,out:array<string>>"

    def step(have: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
        ends = (have["level"] > 0) & (level > 0) & (level <= have["level"])
        held = F.when(ends, 0).otherwise(have["level"])
        now = F.when((held == 0) & line.rlike(rf"(?i)^#{{1,6}}\s+(?:{title})"), level).otherwise(held)
        return F.struct(now.alias("level"), F.when(now > 0, have["out"]).otherwise(F.concat(have["out"], F.array(line))).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.array_join(F.aggregate(_lines(text), start, step, lambda s: s["out"]), "\n")


def without_lines(text: Column, patterns: tuple[str, ...]) -> Column:
    """A text without the lines that begin with a match of any pattern."""
    return F.array_join(F.filter(_lines(text), lambda x: ~F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(x, F.concat(F.lit("^(?:"), p, F.lit(")"))))), "\n")


def without_leading_table(text: Column) -> Column:
    """A text without the pipe table that it opens with and the blank lines after it; without a newline at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:\|[^\n]*(?:\n|\z))+(?:[^\S\n]*(?:\n|\z))*", ""), r"\n\z", "")


def with_images(text: Column, links: Column) -> Column:
    """A text whose placeholders of images are the links, in order; an empty link marks a dropped image, links left over follow at the end."""
    pieces = F.split(text, f"\\Q{IMAGE}\\E", -1)
    places = F.size(pieces) - 1
    filled = F.transform(F.sequence(F.lit(0), places), lambda i: F.when(i == places, "").when(i >= F.size(links), IMAGE).otherwise(F.coalesce(F.when(F.get(links, i) != "", F.get(links, i)), F.lit(DROPPED))))
    out = F.array_join(F.zip_with(pieces, filled, lambda a, b: F.concat(a, b)), "")
    rest = F.filter(F.slice(links, places + 1, F.greatest(F.size(links) - places, F.lit(0))), lambda x: x != "")
    return F.when(F.size(rest) > 0, F.concat(F.regexp_replace(out, r"\s+\z", ""), F.lit("\n\n"), F.array_join(rest, "\n\n"), F.lit("\n"))).otherwise(out)


# What a rewrite must not touch, the first that begins in a text wins, of equal ones the first here.
PROTECTED = (
    r"\A---\n(?s:.*?)\n---\n?",
    r"(?m:^)(`{3,}|~{3,})[^\n]*\n(?s:.*?)\n\{fence}[ \t]*(?m:$)",
    r"(?m:^)> \*\*Confluence export[^\n]*\n(?:>[^\n]*\n)*",
    r"(?m:^)> \*Generated by [^\n]*\n?(?m:$)",
    r"(?:(?m:^)\|[^\n]*\n)+",
)
MARK = "⟦%d⟧"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("regions", T.ArrayType(T.StringType()))]))
def protect(text: pd.Series) -> pd.DataFrame:
    """A text with marks in place of its protected regions, and these in order (one alternation, matched from left to right)."""
    any_of = re.compile("|".join(p.replace("{fence}", "1") for p in PROTECTED))
    out = []
    for t in text:
        regions: list[str] = []

        def mark(m: re.Match, regions: list[str] = regions) -> str:
            regions.append(m[0])
            return MARK % (len(regions) - 1)

        out.append((None if t is None else any_of.sub(mark, t), regions))
    return pd.DataFrame(out, columns=["text", "regions"])


def restore(text: Column, regions: Column) -> Column:
    """A text with its regions back in place of their marks; null if a mark is missing, which makes a rewrite unsafe."""
    marks = F.transform(regions, lambda r, i: F.concat(F.lit(MARK[0]), i.cast("string"), F.lit(MARK[-1])))
    whole = F.forall(marks, lambda m: F.contains(text, m))
    filled = F.aggregate(F.zip_with(marks, regions, lambda m, r: F.struct(m.alias("m"), r.alias("r"))), text, lambda t, x: F.replace(t, x["m"], x["r"]))
    return F.when(whole, filled)


_named: dict[str, str] = {}


def _decode(text: str, kept: frozenset[str], numbers: bool) -> str:
    import html.entities

    _named.update(_named or html.entities.html5)

    def named(m: re.Match) -> str:
        return m[0] if m[1] in kept else _named.get(m[1] + ";", m[0])

    def number(base: int):
        def char(m: re.Match) -> str:
            try:
                return chr(int(m[1], base))
            except (ValueError, OverflowError):
                return m[0]

        return char

    if numbers:
        text = re.sub(r"&#x([0-9a-fA-F]+);", number(16), text)
        text = re.sub(r"&#([0-9]+);", number(10), text)
    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", named, text)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named character references as characters, in one pass; numbers stay."""
    return text.map(lambda t: _decode(t, frozenset(), False), na_action="ignore")


@F.pandas_udf(T.StringType())
def decode_safe_entities(text: pd.Series) -> pd.Series:
    """Numbered and named references as characters, but for those of ``&``, ``<`` and ``>`` by name."""
    return text.map(lambda t: _decode(t, frozenset(("amp", "lt", "gt")), True), na_action="ignore")


def normal_lines(xhtml: Column) -> Column:
    """Lines of a storage body to be compared: references decoded, blanks collapsed and trimmed, blank lines left out."""
    lines = F.transform(F.split(decode_safe_entities(xhtml), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


@F.pandas_udf(T.StringType())
def _unified(remote: pd.Series, local: pd.Series) -> pd.Series:
    import difflib

    return pd.Series(["".join(difflib.unified_diff(list(a), list(b), fromfile="remote", tofile="local")) for a, b in zip(remote, local)], dtype=object)


# Fixed value: the line over a diff of bodies that differ only in blanks where code macros may need them.
CODE_HINT = "# Note: whitespace-only differences detected inside a code macro (indentation may be load-bearing)\n"


def storage_diff(local: Column, remote: Column) -> Column:
    """Unified diff of two storage bodies' normal lines, remote first; of the bodies as they are, under a hint, if only blanks differ and one has a code macro."""
    ended = lambda x: F.transform(normal_lines(x), lambda s: F.concat(s, F.lit("\n")))
    whole = lambda x: F.regexp_extract_all(x, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))
    diff, raw = _unified(ended(remote), ended(local)), _unified(whole(remote), whole(local))
    macro = r"""(?i)<ac:structured-macro[^>]*\bac:name=["']code["']"""
    code = local.rlike(macro) | remote.rlike(macro)
    return F.when(diff != "", diff).when((local != remote) & code & (raw != ""), F.concat(F.lit(CODE_HINT), raw)).otherwise("")
