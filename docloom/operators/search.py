"""Full-text line search: smart-case patterns, caps per document, grouping with metadata, truncation, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import text as fn

SPANS = "array<struct<start:int,end:int>>"


def smart_case(query: str) -> str:
    """A pattern that ignores case unless the query has an upper-case letter."""
    return query if any(c.isupper() for c in query) else f"(?i){query}"


def spans(line: Column, pattern: str) -> Column:
    """Start and end (characters, end exclusive) of each match of a pattern in a line, but for empty ones."""
    matches = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))

    def add(have: Column, match: Column) -> Column:
        start = F.instr(F.substring(line, have["at"] + 1, F.length(line)), match) - 1 + have["at"]
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(have["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(F.filter(matches, lambda m: m != ""), zero, add, lambda have: have["out"])


def search_lines(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", per_document: int | None = 50) -> DataFrame:
    """Matching lines: key, line_no (from 1), line, n_matches; at most ``per_document`` lines of a document.

    Lines are filtered in the array before they are exploded, so lines that don't match never become rows; the cap
    is a slice of that array and needs no window. Null texts have no lines. Anchors are those of a line: the whole
    text is only tested first if the query can mean the same there.
    """
    pattern = smart_case(query)
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hits = F.filter(lines, lambda s: s["line"].rlike(pattern))
    if per_document is not None:
        hits = F.slice(hits, 1, per_document)
    if not any(x in query for x in ("^", "$", "\\", "(?")):
        docs = docs.where(F.col(text).rlike(pattern))
    found = docs.select(key, F.explode(hits).alias("s"))
    return found.select(key, F.col("s.line_no").alias("line_no"), F.col("s.line").alias("line"), F.regexp_count("s.line", F.lit(pattern)).cast("long").alias("n_matches"))


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Matches (path, line_no, line, spans in bytes) of a line search's JSON records; other and broken records are left out."""
    shape = "type string, data struct<path:struct<text:string>,line_number:long,lines:struct<text:string>,submatches:array<struct<start:int,end:int>>>"
    parsed = lines.select(F.from_json(value, shape).alias("r")).where("r.type = 'match' and r.data.path.text is not null and r.data.line_number is not null")
    return parsed.select(F.col("r.data.path.text").alias("path"), F.col("r.data.line_number").alias("line_no"), F.regexp_replace("r.data.lines.text", r"[\r\n]+\z", "").alias("line"), F.col("r.data.submatches").alias("spans"))


def group_matches(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: number of lines and of matches, and the first line."""
    return matches.groupBy(key).agg(F.count("*").alias("n_lines"), F.sum("n_matches").alias("n_matches"), F.min("line_no").alias("first_line"))


def metadata(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, title (of the frontmatter, else the first heading), page_id and fm (first and last frontmatter line) of documents."""
    rows = docs.select(key, F.col(text).alias("_text"), fm.frontmatter(F.col(text)).alias("_fm"))
    title = F.coalesce(fm.field(F.col("_fm"), "title"), fn.first_heading(F.col("_text")))
    return rows.select(key, title.alias("title"), fm.page_id(F.col("_fm")).alias("page_id"), fm.line_range(F.col("_text")).alias("fm"))


def with_metadata(matches: DataFrame, docs: DataFrame, roots: list[dict], key: str = "path", text: str = "text", include_frontmatter: bool = False) -> DataFrame:
    """Matches with title, page_id, mirror and display_path of their documents, without those in frontmatter.

    Frontmatter lines go after the cap per document, so they use it up. Only documents with a match are read for
    their metadata. ``roots``: dicts of path and mirror_name; the first that holds the path is its mirror.
    """
    found = matches.join(metadata(docs.join(matches.select(key).distinct(), key, "left_semi"), key, text), key)
    if not include_frontmatter:
        found = found.where(~fm.in_range(F.col("line_no"), F.col("fm")))
    mirror, display = F.lit(None).cast("string"), F.col(key)
    for root in reversed(roots):
        bare = root["path"].rstrip("/")
        inside = (F.col(key) == bare) | F.col(key).startswith(bare + "/")
        mirror = F.when(inside, root["mirror_name"]).otherwise(mirror)
        display = F.when(inside, F.concat(F.lit(root["mirror_name"] + "/"), F.substring(F.col(key), F.lit(len(bare) + 2), F.length(key)))).otherwise(display)
    return found.drop("fm").withColumns({"mirror": mirror, "display_path": display})


def grouped(found: DataFrame, key: str = "path") -> DataFrame:
    """One row per document: its title, page_id, mirror, display_path and matches (line_no and line, in order)."""
    first = [F.first(c).alias(c) for c in ("title", "page_id", "mirror", "display_path")]
    return found.groupBy(key).agg(*first, F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("matches"))


def json_records(found: DataFrame, key: str = "path") -> DataFrame:
    """A JSON record (column record) for each match, without title and page id where there is none; write it as text."""
    fields = F.struct(F.col(key).alias("path"), "mirror", F.col("line_no").alias("line"), F.col("line").alias("snippet"), "title", "page_id", "display_path")
    mirrorless = F.to_json(F.struct(F.col(key).alias("path"), F.col("line_no").alias("line"), F.col("line").alias("snippet"), "title", "page_id", "display_path"))
    empty = F.regexp_replace(mirrorless, r'^(\{"path":"(?:[^"\\]|\\.)*")', '$1,"mirror":null')
    return found.select(key, "line_no", F.when(F.col("mirror").isNull(), empty).otherwise(F.to_json(fields)).alias("record"))


def total_limit(matches: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The first matches over all documents in their order (a report limit)."""
    return matches.orderBy(key, "line_no").limit(limit)


def truncate(line: Column, start: Column, end: Column, most: int = 500) -> Column:
    """A window of ``most`` characters around a span, with an ellipsis at each cut end."""
    return truncated(line, F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))), most)["text"]


def truncated(line: Column, found: Column, most: int = 500) -> Column:
    """Struct of text, a window of ``most`` characters around a line's spans with an ellipsis at each cut end, and the spans in it.

    Spans are shifted and clipped; those outside the window go. Without a span, the line's beginning stays.
    """
    size, first, last = F.length(line), F.get(found, F.lit(0))["start"], F.element_at(found, -1)["end"]
    wide = (last - first) >= most
    low = F.when(wide, first).otherwise(F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), first - F.floor((F.lit(most) - (last - first)) / 2)), size - most))).cast("int")
    high = F.least(low + most, size)
    head = F.when(low > 0, "…").otherwise("")
    text = F.concat(head, F.substring(line, low + 1, high - low), F.when(high < size, "…").otherwise(""))
    begin = F.length(head)
    stop = begin + high - low
    moved = F.transform(found, lambda s: F.struct((s["start"] + begin - low).alias("start"), (s["end"] + begin - low).alias("end")))
    kept = F.filter(moved, lambda s: (s["end"] > begin) & (s["start"] < stop))
    clipped = F.transform(kept, lambda s: F.struct(F.greatest(s["start"], begin).alias("start"), F.least(s["end"], stop).alias("end"))).cast(SPANS)
    none = F.struct(F.concat(F.substring(line, 1, most - 1), F.lit("…")).alias("text"), F.array().cast(SPANS).alias("spans"))
    shape = f"struct<text:string,spans:{SPANS}>"
    cut = F.when(F.size(found) == 0, none.cast(shape)).otherwise(F.struct(text.alias("text"), clipped.alias("spans")).cast(shape))
    return F.when(size <= most, F.struct(line.alias("text"), found.cast(SPANS).alias("spans")).cast(shape)).otherwise(cut)


def highlighted(line: Column, found: Column, before: str = "\x1b[1;31m", after: str = "\x1b[0m") -> Column:
    """A line with marks around its spans; spans that overlap an earlier one are passed over."""
    shape = "struct<at:int,out:string>"

    def add(have: Column, s: Column) -> Column:
        good = (s["start"] >= have["at"]) & (s["end"] >= s["start"])
        marked = F.concat(have["out"], F.substring(line, have["at"] + 1, s["start"] - have["at"]), F.lit(before), F.substring(line, s["start"] + 1, s["end"] - s["start"]), F.lit(after))
        return F.struct(F.when(good, s["end"]).otherwise(have["at"]).alias("at"), F.when(good, marked).otherwise(have["out"]).alias("out")).cast(shape)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(shape)
    return F.aggregate(found, zero, add, lambda have: F.concat(have["out"], F.substring(line, have["at"] + 1, F.length(line))))


def human_text(found: DataFrame, key: str = "path") -> DataFrame:
    """key and text: a document's display path with its page id, its title, and a line for each match, in order."""
    one = grouped(found, key)
    head = F.concat("display_path", F.coalesce(F.concat(F.lit("  (page "), "page_id", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit("\n  Title: "), F.nullif("title", F.lit(""))), F.lit("")))
    rows = F.transform("matches", lambda m: F.concat(F.lit("  L"), m["line_no"].cast("string"), F.lit(":  "), truncated(m["line"], F.array().cast(SPANS))["text"]))
    return one.select(key, F.concat(head, F.lit("\n\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
