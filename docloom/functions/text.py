"""Scalar functions on names, paths, URLs and bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repo_name(name: Column) -> Column:
    """Trimmed; runs of blanks and of characters that paths forbid become one dash; no dash at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r'[\s/\\:*?"<>|]+', "-"), "^-+|-+$", "")


def path_title(path: Column) -> Column:
    """The file's stem with dashes and underscores as spaces."""
    return F.translate(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1"), "-_", "  ")


def first_heading(text: Column) -> Column:
    """Text of the first line after the frontmatter that begins with ``# ``; null without one. An unclosed block has no body."""
    opened = text.rlike(r"\A---[\r\n]*(?:\n|\z)")
    body = F.when(opened, F.regexp_extract(text, r"(?s)\A---[\r]*\n(?:.*?\n)?---\r*\n(.*)\z", 1)).otherwise(text)
    return F.when(body.rlike("(?m)^# "), F.regexp_replace(F.regexp_extract(body, r"(?m)^# ([^\n]*)", 1), r"^\s+|\s+$", ""))


def derived_title(text: Column, path: Column) -> Column:
    """The first heading, else the file's stem."""
    return F.coalesce(first_heading(text), F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1"))


def with_first_heading(text: Column, title: Column) -> Column:
    """The text with another title in its first line that begins with ``# ``; unchanged without one."""
    line = r"(?m)^# [^\n]*"
    at = F.regexp_instr(text, F.lit(line))
    after = at + F.length(F.regexp_extract(text, line, 0))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("# "), title, F.substring(text, after, F.length(text)))).otherwise(text)


def keep_outer_blanks(original: Column, new: Column) -> Column:
    """A new body between the blanks at the start and the end of the original one (all of these first if it is blank)."""
    tail = F.when(original.rlike(r"\S"), F.regexp_extract(original, r"\s*\z", 0)).otherwise("")
    return F.concat(F.regexp_extract(original, r"^\s*", 0), F.regexp_replace(new, r"^\s+|\s+\z", ""), tail)


def split_frontmatter(text: Column) -> Column:
    """Struct of yaml and body if the text opens with a frontmatter block, else null; a block may close at the end of the text."""
    pattern = r"(?s)\A---\r?\n(.*?)\n---(?:\n|\z)(.*)\z"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("yaml"), F.regexp_extract(text, pattern, 2).alias("body")))


def body_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def content_digest(text: Column) -> Column:
    """The 32 bytes of the whole text's SHA-256."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def escape_markdown(text: Column) -> Column:
    """A backslash before each ASCII punctuation character."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which no built-in function gives; for titles that may hold decomposed letters."""
    return text.str.normalize("NFC")


def safe_name(title: Column) -> Column:
    """A title (in normal form C) as a file name: no forbidden characters, no blanks, dots, dashes or ``..`` that could climb folders.

    At most 200 characters; what leaves nothing becomes ``untitled``; null stays null.
    """

    def named(x: Column) -> Column:
        return F.regexp_replace(x, r"^\z", "untitled")  # a CASE would hold x twice at each level

    def dashed(x: Column) -> Column:
        return named(F.regexp_replace(F.regexp_replace(x, "-+", "-"), r"^-|-\z", ""))

    spaced = F.regexp_replace(title, r"[\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " ")
    bare = F.regexp_replace(F.regexp_replace(spaced, r'[<>:"/\\|?*\n\t\r]', "-"), r"^[. ]+|[. ]+\z", "")
    short = named(F.substring(F.regexp_replace(bare, "-+", "-"), 1, 200))
    return dashed(F.replace(dashed(named(F.regexp_replace(short, "^~+", ""))), F.lit(".."), F.lit("-")))


def slug(title: Column) -> Column:
    """A title percent-encoded for a URL's last segment, blanks as plus signs."""
    return F.replace(F.replace(F.url_encode(title), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def page_url(base: Column, space: Column, page_id: Column, title: Column) -> Column:
    """Address of a page: base, space, id and slug."""
    return F.concat(base, F.lit("/wiki/spaces/"), space, F.lit("/pages/"), page_id.cast("string"), F.lit("/"), slug(title))


def url_with_title(url: Column, title: Column) -> Column:
    """An address with a title's slug for its last segment; unchanged if nothing stands before the last slash."""
    return F.when(url.rlike("^.+/"), F.concat(F.regexp_extract(url, "^(.+/)", 1), slug(title))).otherwise(url)


def url_segments(address: Column) -> Column:
    """The path segments of a URL or of ``user@host:path``, without empty ones."""
    path = F.regexp_replace(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*|[^@/]+@[^:/]+:)", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def source_of(segments: Column, marker: str) -> Column:
    """Struct of system and id, the two segments after the first ``marker``; null if there are not two."""
    at = F.array_position(segments, marker).cast("int")
    return F.when((at > 0) & (F.size(segments) >= at + 2), F.struct(F.get(segments, at).alias("system"), F.get(segments, at + 1).alias("id")))


def page_ref(text: Column, host: str) -> Column:
    """Struct of space and page_id from a bare id (no space) or a page's address at ``host``; null for anything else."""
    address = r"^https?://([^/:?#]+)(?::\d+)?/wiki/spaces/([^/?#]+)/pages/(\d+)(?:[/?#].*)?$"
    shape = "struct<space:string,page_id:string>"
    here = text.rlike(address) & (F.lower(F.regexp_extract(text, address, 1)) == host.lower())
    of_address = F.struct(F.regexp_extract(text, address, 2).alias("space"), F.regexp_extract(text, address, 3).alias("page_id"))
    bare = F.struct(F.lit(None).cast("string").alias("space"), F.trim(text).alias("page_id"))
    return F.when(text.rlike(r"^\s*\d+\s*$"), bare).when(here, of_address).cast(shape)


def date_in(text: Column) -> Column:
    """The first YYYY-MM-DD or YYYY/MM/DD in a text as a date; null without one or if there is no such day."""
    day = r"\b(\d{4})[-/](\d{2})[-/](\d{2})\b"
    return F.regexp_replace(F.regexp_extract(text, day, 0), "/", "-").try_cast("date")


def short_hash(content: Column) -> Column:
    """The first 16 hex digits of SHA-1, as names of stored images have them."""
    return F.substring(F.sha1(content.cast("binary")), 1, 16)


def attributes(info: Column) -> Column:
    """Map of the ``key="value"`` pairs in the first braces of a text; the last of equal keys holds; backslash escapes are undone."""
    return bare_attributes(F.regexp_extract(info, r"\{([^}]*)\}", 1))


def bare_attributes(inside: Column) -> Column:
    """The same pairs of a text without braces."""
    pair = r'([A-Za-z_][\w:-]*)="((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all(inside, F.lit(pair), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    at = F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1)))
    last = F.filter(at, lambda i: (i <= F.size(keys)) & ~F.array_contains(F.slice(keys, i + 1, F.greatest(F.size(keys) - i, F.lit(0))), F.get(keys, i - 1)))
    return F.map_from_arrays(F.transform(last, lambda i: F.get(keys, i - 1)), F.transform(last, lambda i: F.get(plain, i - 1)))


def without_empty_headings(text: Column) -> Column:
    """A text without lines that are only a heading's marks, and without headings deeper than six."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^(#{1,6}\s*$|#{7,})"))
    return F.array_join(lines, "\n")


def site_name(folder: Column, suffix: str = " - Documents") -> Column:
    """A folder's name without one such suffix."""
    return F.when(folder.endswith(suffix), F.substring(folder, F.lit(1), F.length(folder) - len(suffix))).otherwise(folder)


_CLONE = "struct<host:string,path:string,namespace:string,repo:string,port:int>"


def clone_parts(url: Column) -> Column:
    """Host, path, namespace, repo and port of ``git@host:path`` and http(s) clone addresses; null for others.

    The host is in lower case, the path has no outer slashes and no ``.git``; ssh addresses aren't known.
    """
    bare = F.trim(url)
    scp, web = r"^git@([^:]+):(.+)$", r"^https?://(?:[^/@]*@)?([^/:?#]+)(?::(\d+))?(/[^?#]*)?"
    is_scp = bare.rlike(scp)
    raw = F.when(is_scp, F.regexp_extract(bare, scp, 2)).otherwise(F.regexp_extract(bare, web, 3))
    path = F.regexp_replace(F.regexp_replace(raw, "^/+|/+$", ""), r"\.git$", "")
    host = F.when(is_scp, F.regexp_extract(bare, scp, 1)).otherwise(F.regexp_extract(bare, web, 1))
    port = F.when(~is_scp, F.regexp_extract(bare, web, 2)).try_cast("int")
    repo = F.substring_index(path, "/", -1)
    parts = F.struct(F.lower(host).alias("host"), path.alias("path"), F.regexp_extract(path, "^(.*)/", 1).alias("namespace"), repo.alias("repo"), port.alias("port"))
    return F.when((is_scp | bare.rlike(web)) & (path != ""), parts).cast(_CLONE)


def blob_url(clone: Column, path: Column, branch: Column, host: str, infix: str = "/-/blob/") -> Column:
    """Address at which a mirrored file can be read: of the clone's host, if that is ``host``; else null. A null branch is main."""
    parts = clone_parts(clone)
    port = F.coalesce(F.concat(F.lit(":"), parts["port"].cast("string")), F.lit(""))
    encoded = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    file = F.array_join(F.transform(F.split(path, "/"), encoded), "/")
    url = F.concat(F.lit("https://"), parts["host"], port, F.lit("/"), parts["path"], F.lit(infix), encoded(F.coalesce(branch, F.lit("main"))), F.lit("/"), file)
    return F.when(parts["host"] == host.strip().lower(), url)


def svg_size(svg: Column) -> Column:
    """Width and height of an SVG: of its attributes, else of its view box, else 100 each."""
    tag = F.regexp_extract(svg, r"(?s)<svg\b[^>]*>", 0)
    length = lambda k: F.regexp_replace(F.regexp_extract(tag, rf"""\s{k}\s*=\s*["']([^"']*)["']""", 1), r"\s|(?:px|pt|em|rem|mm|cm|in|%)\s*$", "").try_cast("double")
    box = F.transform(F.regexp_extract_all(F.regexp_extract(tag, r"""\sviewBox\s*=\s*["']([^"']*)["']""", 1), F.lit(r"\S+"), F.lit(0)), lambda x: x.try_cast("double"))
    size = lambda w, h: F.struct(w.cast("double").alias("width"), h.cast("double").alias("height"))
    stated = F.when(length("width").isNotNull() & length("height").isNotNull(), size(length("width"), length("height")))
    boxed = F.when((F.size(box) == 4) & F.get(box, F.lit(2)).isNotNull() & F.get(box, F.lit(3)).isNotNull(), size(F.get(box, F.lit(2)), F.get(box, F.lit(3))))
    return F.coalesce(stated, boxed, size(F.lit(100), F.lit(100)))


def capped_scale(width: Column, height: Column, scale: Column, most: float = 4096.0) -> Column:
    """A scale at which neither side of an image passes ``most``; the wanted one if it does."""
    return F.when((width * scale > most) | (height * scale > most), F.least(F.lit(most) / width, F.lit(most) / height)).otherwise(scale)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or the time until an HTTP date (0 if past); null for others."""
    bare = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(bare, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.lit(0.0), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(bare == "", None).otherwise(F.coalesce(bare.try_cast("double"), F.when(date.isNotNull(), wait)))


def union_in_order(a: Column, b: Column) -> Column:
    """The items of two arrays, each once, in order of their first place."""
    return F.array_union(a, b)


def fill_attributes(fresh: Column, cached: Column, skip: Column) -> Column:
    """Key and value structs: the fresh ones, then the cached ones whose keys are neither fresh nor to be skipped."""
    keys = F.transform(fresh, lambda s: s["k"])
    return F.concat(fresh, F.filter(cached, lambda s: ~F.array_contains(keys, s["k"]) & ~F.array_contains(skip, s["k"])))


def char_offset(text: Column, offset: Column) -> Column:
    """Number of characters that begin before a byte offset of the text in UTF-8."""
    head = F.hex(F.substring(text.cast("binary"), F.lit(1), offset))
    return (F.length(F.regexp_replace(F.regexp_replace(head, "(..)", "$1 "), "[89AB][0-9A-F] ", "")).cast("int") / F.lit(3)).cast("int")
