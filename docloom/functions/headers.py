"""Headers, footers and callouts that exports put around a body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a quoted export header begins, and the sentence that marks a callout of office files.
EXPORT = "**Confluence export**"
GENERATED = "(this attachment is generated from the markdown source)"


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def strip_export_header(body: Column) -> Column:
    """A body without the quote that it opens with, if the quote's first words mark an export; with the blank line after it."""
    block = r"\A((?:[ \t]*\n)*)((?:>[^\n]*\n)+)\n?"
    quoted = F.filter(F.split(F.regexp_extract(body, block, 2), "\n"), lambda x: x.rlike(r"^\s*>\s*\S"))
    first = F.regexp_replace(F.get(quoted, F.lit(0)), r"^\s*>\s*", "")
    return F.when(first.startswith(EXPORT), F.regexp_replace(body, block, "")).otherwise(body)


def strip_title_heading(body: Column, title: Column) -> Column:
    """A body without the level-one heading that it opens with, if this is the title; an empty title strips nothing."""
    line = r"\A(?:[ \t]*\n)*#[ \t]+([^\n]*?)[ \t]*#*[ \t]*\n(?:[ \t]*\n)?"
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    same = body.rlike(line) & (bare(F.regexp_extract(body, line, 1)) == bare(title)) & (title != "")
    return F.when(same, F.regexp_replace(body, line, "")).otherwise(body)


def _replaced(body: Column, pattern: str, new: Column, added: Column) -> Column:
    safe = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(body.rlike(pattern), F.regexp_replace(body, F.lit(pattern), safe)).otherwise(added)


def put_footer(body: Column, url: Column, label: str) -> Column:
    """A storage body with a footer that links to its mirror: in place of the one it has, else at the end; null url: unchanged."""
    pattern = rf"(?s)<p><sub><em>{_quote(label)} .*?</em></sub></p>"
    link = F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    footer = F.concat(F.lit(f'<p><sub><em>{label} <a href="'), link, F.lit('">'), link, F.lit("</a></em></sub></p>"))
    return F.when(url.isNull(), body).otherwise(_replaced(body, pattern, footer, F.concat(body, F.lit("\n"), footer)))


_CALLOUT = rf"(?s)<p><sub><em>Download as .*?{_quote(GENERATED)}.*?</em></sub></p>\n?"


def strip_callout(body: Column) -> Column:
    """A storage body without its callout of office files."""
    return F.regexp_replace(body, _CALLOUT, "")


def put_callout(body: Column, links: Column) -> Column:
    """A storage body with a callout of office files (array of url and name): in place of the one it has, else first."""
    url = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    name = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    each = F.transform(links, lambda s: F.concat(F.lit('<a href="'), url(s["url"]), F.lit('">'), name(s["name"]), F.lit("</a>")))
    callout = F.concat(F.lit("<p><sub><em>Download as "), F.array_join(each, ", "), F.lit(f" {GENERATED}</em></sub></p>"))
    return _replaced(body, _CALLOUT, callout, F.concat(callout, F.lit("\n"), body))
