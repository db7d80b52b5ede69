"""Links and images of Markdown bodies, and the addresses that stand for pages, users and attachments there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The schemes of link and image addresses, and the kind of target of each.
LINKS = {"confluence-page": "page", "confluence-attachment": "attachment", "confluence-blogpost": "blogpost", "confluence-anchor": "anchor", "confluence-user": "user", "confluence-shortcut": "shortcut"}
IMAGES = {"confluence-attachment": "attachment", "confluence-image-url": "url"}
EXTRAS = ("space-key", "version-at-save", "posting-day", "page-title", "page-space-key", "ri-local-id")

_DEFINITION = r"""(?m)^ {0,3}\[([^\]]+)\]:\s*<?([^\s<>]+)>?(?:\s+["'(].*?["')])?\s*$"""
_INLINE = r"!\[[^\]]*\]\(([^)]+)\)"
_ATTACHMENT = r"(?<!!)\[[^\]]*\]\(confluence-attachment:([^)]+)\)"
_FULL = r"!\[([^\]]*)\]\[([^\]]*)\]"
_SHORTCUT = r"!\[([^\]]+)\](?![\[(:])"


def unquote(text: Column) -> Column:
    """Percent-decoded; a plus sign stays, and what isn't valid stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def quote(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~`` (and slashes, if asked)."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def _label(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""))


def reference_definitions(body: Column) -> Column:
    """Map of label (lower case, single blanks) to address; the first definition of a label holds."""
    labels = F.transform(F.regexp_extract_all(body, F.lit(_DEFINITION), F.lit(1)), _label)
    urls = F.regexp_extract_all(body, F.lit(_DEFINITION), F.lit(2))
    at = F.transform(F.array_distinct(F.filter(labels, lambda x: x != "")), lambda x: F.struct(x.alias("key"), F.get(urls, F.array_position(labels, x).cast("int") - 1).alias("value")))
    return F.map_from_entries(at)


def blank_code(body: Column) -> Column:
    """A body with blanks in place of fenced code, fences included, and of inline code: offsets stay.

    A fence closes at a line of the same marks alone; a fence that isn't closed runs to the end.
    """
    lines = F.split(body, "\n", -1)
    state = "struct<fence:string,out:array<string>>"

    def step(have: Column, line: Column) -> Column:
        opened = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        inside = have["fence"] != ""
        closes = inside & (F.regexp_replace(line, r"^ +|\s+$", "") == have["fence"])
        fence = F.when(closes, "").when(inside, have["fence"]).otherwise(opened)
        code = inside | (opened != "")
        return F.struct(fence.alias("fence"), F.concat(have["out"], F.array(F.when(code, F.repeat(F.lit(" "), F.length(line))).otherwise(line))).alias("out")).cast(state)

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out")).cast(state)
    text = F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), "\n")
    for n in (3, 2, 1):
        text = _blanked(text, rf"(?s)`{{{n}}}(?!`)(.+?)(?<!`)`{{{n}}}(?!`)")
    return text


def _blanked(text: Column, pattern: str) -> Column:
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spaces = F.concat(F.transform(matches, lambda m: F.repeat(F.lit(" "), F.length(m))), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, spaces, lambda a, b: F.concat(a, b)), "")


def without_title(inside: Column) -> Column:
    """The address in a link's parentheses, without a quoted title after it."""
    bare = F.regexp_replace(inside, r"^\s+|\s+$", "")
    found = F.regexp_extract(bare, r"""^(\S+?)(?:\s+["'(].*)?$""", 1)
    return F.when(found != "", found).otherwise(bare)


def attachment_name(uri: Column) -> Column:
    """File name of an attachment's address: without scheme and extras, percent-decoded."""
    return unquote(F.substring_index(F.regexp_replace(uri, "^confluence-attachment:", ""), ";", 1))


def local_images(body: Column) -> Column:
    """Sources of images and attachment links that aren't http(s): inline images, attachment links, then references.

    Code is left out. References go by the body's own definitions; repeated sources stay.
    """
    text = blank_code(body)
    known = reference_definitions(text)
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    inline = F.transform(every(_INLINE, 1), lambda x: attachment_name(without_title(x)))
    attached = F.transform(every(_ATTACHMENT, 1), lambda x: unquote(F.substring_index(without_title(x), ";", 1)))
    full = F.zip_with(every(_FULL, 1), every(_FULL, 2), lambda alt, label: _label(F.when(label != "", label).otherwise(alt)))
    named = F.concat(full, F.transform(every(_SHORTCUT, 1), _label))
    resolved = F.transform(F.filter(F.transform(named, lambda x: F.try_element_at(known, x)), lambda u: u.isNotNull()), attachment_name)
    sources = F.transform(F.concat(inline, attached, resolved), lambda s: F.regexp_replace(s, "^[<>]+|[<>]+$", ""))
    return F.filter(sources, lambda s: (s != "") & ~s.startswith("http://") & ~s.startswith("https://"))


def svg_as_png(body: Column, names: Column) -> Column:
    """A body whose image sources that end in a key of ``names`` (map of SVG to PNG file names) name the PNG instead."""
    pieces, matches = F.split(body, _INLINE, -1), F.regexp_extract_all(body, F.lit(_INLINE), F.lit(0))

    def changed(image: Column) -> Column:
        inside = F.regexp_extract(image, r"\]\(([^)]+)\)$", 1)
        url = without_title(inside)
        png = F.try_element_at(names, F.substring_index(attachment_name(url), "/", -1))
        folder = F.regexp_extract(url, r"^(.*/|confluence-attachment:)", 1)
        return F.when(png.isNull(), image).otherwise(F.concat(F.regexp_extract(image, r"^(!\[[^\]]*\]\()", 1), F.replace(inside, url, F.concat(folder, png)), F.lit(")")))

    new = F.concat(F.transform(matches, changed), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, b)), "")


_URI = "struct<kind:string,target:string,space_key:string,anchor:string,image:boolean,extras:map<string,string>>"


def parse_uri(uri: Column) -> Column:
    """Struct of a page, attachment, user or image address: kind, target, space_key, anchor, image, extras; null for others.

    In pages and blog posts a plain ``/`` parts space and title and the last plain ``#`` title and anchor, unless extras
    state these; encoded ones belong to the title. Extras are ``;key=value`` pairs. An address that can be an image is one.
    """
    scheme, rest = F.substring_index(uri, ":", 1), F.regexp_extract(uri, r"(?s)^[^:]*:(.*)$", 1)
    parts = F.split(rest, ";", -1)
    raw = F.get(parts, F.lit(0))
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1))), lambda i: (i <= F.size(pairs)) & ~F.array_contains(F.slice(keys, i + 1, F.greatest(F.size(keys) - i, F.lit(0))), F.get(keys, i - 1)))
    extras = F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(keys, i - 1).alias("k"), unquote(F.regexp_extract(F.get(pairs, i - 1), "^[^=]*=(.*)$", 1)).alias("v"))))
    links, images = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (LINKS, IMAGES))
    image = images[scheme].isNotNull()
    kind = F.coalesce(images[scheme], links[scheme])
    stated = lambda k: F.try_element_at(extras, F.lit(k))
    unpacked = kind.isin("page", "blogpost") & ~image
    hashed = unpacked & raw.contains("#") & stated("anchor").isNull()
    before = F.when(hashed, F.regexp_extract(raw, "(?s)^(.*)#", 1)).otherwise(raw)
    after = F.when(hashed, unquote(F.substring_index(raw, "#", -1)))
    parted = unpacked & before.rlike("(?s)^[^/]+/.") & stated("space-key").isNull()
    space = F.when(parted, unquote(F.substring_index(before, "/", 1)))
    title = unquote(F.when(parted, F.regexp_extract(before, "(?s)^[^/]+/(.*)$", 1)).otherwise(before))
    out = F.struct(
        kind.alias("kind"),
        F.when(unpacked, title).otherwise(unquote(raw)).alias("target"),
        F.when(image, "").otherwise(F.coalesce(space, stated("space-key"), F.lit(""))).alias("space_key"),
        F.when(image, "").otherwise(F.coalesce(after, stated("anchor"), F.lit(""))).alias("anchor"),
        image.alias("image"),
        extras.alias("extras"),
    )
    return F.when((rest != "") & kind.isNotNull(), out).cast(_URI)


def render_uri(ref: Column) -> Column:
    """The address of a struct of ``parse_uri``."""
    links, images = (F.create_map(*[F.lit(x) for k, v in m.items() for x in (v, k)]) for m in (LINKS, IMAGES))
    pair = lambda k, v: F.when(v != "", F.concat(F.lit(f";{k}="), quote(v, keep_slash=True))).otherwise("")
    extra = lambda k: pair(k, F.coalesce(F.try_element_at(ref["extras"], F.lit(k)), F.lit("")))
    named = F.concat(pair("space-key", ref["space_key"]), pair("anchor", ref["anchor"]), *[extra(k) for k in EXTRAS[1:]])
    target = F.when(ref["kind"].isin("page", "blogpost"), quote(ref["target"])).otherwise(quote(ref["target"], keep_slash=True))
    others = F.array_join(F.transform(F.map_entries(ref["extras"]), lambda e: F.concat(F.lit(";"), e["key"], F.lit("="), quote(e["value"], keep_slash=True))), "")
    image = F.concat(images[ref["kind"]], F.lit(":"), quote(ref["target"], keep_slash=True), others)
    return F.when(ref["image"], image).otherwise(F.concat(links[ref["kind"]], F.lit(":"), target, named))
