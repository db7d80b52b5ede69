"""Functions on headers, links, lines and frontmatter, value by value."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import headers, links
from docloom.functions import lines as ln
from docloom.functions import text as fn

X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def each(spark, column, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").select("k", column.alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_headers(spark):
    assert each(spark, headers.strip_export_header(X), "\n> \n> **Confluence export** a\n> b\n\nBody\n", "> other\n\nB", "B") == ["Body\n", "> other\n\nB", "B"]
    assert each(spark, headers.strip_title_heading(X, F.lit("T $1")), "\n# T $1 ##\n\nb", "# U\nb") == ["b", "# U\nb"]
    assert each(spark, headers.strip_title_heading(X, F.lit("")), "# \nb") == ["# \nb"]
    foot = '<p>a</p>\n<p><sub><em>At <a href="http://a?b&amp;c$1">http://a?b&amp;c$1</a></em></sub></p>'
    once = headers.put_footer(X, F.lit("http://z"), "At")
    assert each(spark, headers.put_footer(once, F.lit("http://a?b&c$1"), "At"), "<p>a</p>") == [foot]
    assert each(spark, headers.put_footer(X, F.lit(None).cast("string"), "At"), "a") == ["a"]
    link = F.array(F.struct(F.lit("u&").alias("url"), F.lit("n<").alias("name")))
    assert each(spark, headers.put_callout(X, link), "b")[0].startswith('<p><sub><em>Download as <a href="u&amp;">n&lt;</a> (')
    assert each(spark, headers.strip_callout(headers.put_callout(headers.put_callout(X, link), link)), "b") == ["b"]


def test_references_and_images(spark):
    assert each(spark, links.reference_definitions(X), '[A  b]: <u1> "t"\n[a b]: u2\n  [c]: u3') == [{"a b": "u1", "c": "u3"}]
    assert each(spark, links.blank_code(X), "a\n```py\ncode\n```\nb `x` ``y`z`` c", "~~~\nopen") == ["a\n     \n    \n   \nb             c", "   \n    "]
    body = '![a](b%20c.png "t") [l](confluence-attachment:f%2Bg.pdf;v=1) ![alt][Ref] ![ref][] ![sc] `![no](no.png)` ![h](https://x/y.png)\n\n[ref]: confluence-attachment:r.png;x=1\n[sc]: s.png\n'
    assert each(spark, links.local_images(X), body, "none") == [["b c.png", "f+g.pdf", "r.png", "r.png", "s.png"], []]
    names = F.create_map(F.lit("a.svg"), F.lit("a.png"))
    assert each(spark, links.svg_as_png(X, names), '![k](dir/a.svg "t") ![z](b.svg) ![q](confluence-attachment:a.svg)') == ['![k](dir/a.png "t") ![z](b.svg) ![q](confluence-attachment:a.png)']


def test_addresses_round_trip(spark):
    uris = ["confluence-page:S/Home%2FX#in%20tro;version-at-save=3", "confluence-page:A;space-key=S", "confluence-attachment:f+a%20b.png;width=3", "confluence-user:12", "confluence-anchor:a/b", "http://x", "confluence-page:"]
    parsed = each(spark, links.parse_uri(X), *uris)
    assert [(p.kind, p.target, p.space_key, p.anchor, p.image) if p else None for p in parsed] == [("page", "Home/X", "S", "in tro", False), ("page", "A", "S", "", False), ("attachment", "f+a b.png", "", "", True), ("user", "12", "", "", False), ("anchor", "a/b", "", "", False), None, None]
    back = each(spark, links.render_uri(links.parse_uri(X)), *uris)
    assert back == ["confluence-page:Home%2FX;space-key=S;anchor=in%20tro;version-at-save=3", "confluence-page:A;space-key=S", "confluence-attachment:f%2Ba%20b.png;width=3", "confluence-user:12", "confluence-anchor:a/b", None, None]


def test_lines(spark):
    assert each(spark, ln.without_toc(X), "a\n# Contents\n\n1. Intro 3\n* More 4\n\nText\n## contents\nplain") == ["a\nText\n## contents\nplain"]
    assert each(spark, ln.without_sections(X, r"(?:\d+\.?\s+)?meeting\s+logistics\s*$"), "# A\nx\n## 1. Meeting Logistics\ny\n### z\nw\n## B\nq") == ["# A\nx\n## B\nq"]
    assert each(spark, ln.without_lines(X, (r"\s*[-*]\s+(?i:actions are on the \[)",)), "a\n - Actions are on the [x]\nb") == ["a\nb"]
    assert each(spark, ln.without_leading_table(X), "|a|\n|b|\n\n \nrest\n|c|\n", "x\n|a|") == ["rest\n|c|", "x\n|a|"]
    image = "<!-- image -->"
    assert each(spark, ln.with_images(X, F.array(*map(F.lit, ["L1", "", "L3"]))), f"a{image}b{image}c \n") == ["aL1b<!-- image dropped -->c\n\nL3\n"]
    assert each(spark, ln.with_images(X, F.array(F.lit("L1"))), f"a{image}b{image}") == [f"aL1b{image}"]
    assert each(spark, ln.decode_entities(X), "&nbsp;&amp;lt; &#65; &foo;", None) == ["\xa0&lt; &#65; &foo;", None]
    assert each(spark, ln.decode_safe_entities(X), "&hellip;&amp;lt; &#65;&#x42;") == ["…&amp;lt; AB"]


def test_protected_regions(spark):
    docs = ["---\na: 1\n---\nText\n```py\nx\n```\n|a|\n|b|\nend\n", "plain", "> **Confluence export** x\n> y\nz"]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, x string").withColumn("p", ln.protect("x"))
    got = {r.k: r for r in rows.select("k", "p", ln.restore(F.col("p.text"), F.col("p.regions")).alias("back"), ln.restore(F.lit("lost"), F.col("p.regions")).alias("lost")).collect()}
    assert [got[k].back for k in range(3)] == docs
    assert got[0].p.regions == ["---\na: 1\n---\n", "```py\nx\n```", "|a|\n|b|\n"] and got[0].lost is None and got[1].lost == "lost"


def test_storage_diff(spark):
    assert each(spark, ln.storage_diff(X, F.lit("<p>a</p>\n\n  b &hellip;")), "<p>a</p>\nb …", "<p>a</p>\nb") == ["", "--- remote\n+++ local\n@@ -1,2 +1,2 @@\n <p>a</p>\n-b …\n+b\n"]
    code = '<ac:structured-macro ac:name="code">\n'
    assert each(spark, ln.storage_diff(X, F.lit(code + " a\n")), code + "  a\n")[0].startswith(ln.CODE_HINT)


def test_frontmatter(spark):
    assert each(spark, fm.yaml_mapping(X), "a: 1\nd: 2024-01-02\nl: [x]", "- a", "", None, "a: [") == ['{"a": 1, "d": {"@date": "2024-01-02"}, "l": ["x"]}', None, None, None, None]
    assert each(spark, fm.json_mapping(X), '{"a":1}', "[1]", "null", "{") == ['{"a":1}', None, None, None]
    assert each(spark, fm.body(X), "---\na\n---\nb", "---\r\na\n---\nb", "---\na\n---", "---\na", "x") == ["b", "b", "", "---\na", "x"]
    assert each(spark, fm.line_range(X), "---\na\n---\r\nb", "x", "---\n" + "a\n" * 300 + "---\n")[0].asDict() == {"start": 1, "end": 3}
    dates = each(spark, fm.updated_at(X, fm.frontmatter(X)), "---\nupdated_at: '2024-01-02'\n---\n", "---\nupdated_at: 2025-01-10\n---\n", "as of 2023-99-01 updated: 2022/02/03", "x")
    assert list(map(str, dates)) == ["2024-01-02", "2025-01-10", "2022-02-03", "None"]
    assert each(spark, fm.is_managed(fm.yaml_mapping(X)), "confluence: {managed_by: a}", "confluence: {managed_by: ''}", "a: 1") == [True, False, False]
    doc = "---\nsharepoint:\n  site: s\nz: 1\n---\nbody"
    synced = fm.put_sync(X, F.lit('{"h": 1}'))
    assert each(spark, synced, doc, "body") == ["---\nsharepoint:\n  site: s\n  sync:\n    h: 1\nz: 1\n---\nbody", "---\nsharepoint:\n  sync:\n    h: 1\n---\nbody"]
    assert each(spark, fm.content_hash(synced), doc) == each(spark, fm.content_hash(X), doc)
    assert each(spark, fm.keep_other_keys(F.lit("new"), X), doc, "plain") == ["---\nz: 1\n---\nnew", "new"]
    assert each(spark, fm.without_source_block(X), doc, "---\nz: 1\n---\nb") == ["body", "---\nz: 1\n---\nb"]
    merged = fm.merge_source(X, F.lit('{"site":"s"}'), fm.export_callout(F.lit("s/p"), F.lit("2024-01-02T"), "Export", "Drive"))
    assert each(spark, merged, "---\nz: 1\n---\nbody")[0].startswith("---\nz: 1\nsharepoint:\n  site: s\n---\n> **Export**\n>\n> This page was exported from `s/p` on\n> 2024-01-02.")


def test_scalars(spark):
    cases = [
        (fn.first_heading(X), {"---\n# no\n---\n# yes ": "yes", "---\n# no\n": None, "a\n# h": "h", "#no": None}),
        (fn.blob_url(X, F.lit("A b/c+.md"), F.lit(None).cast("string"), "h.x"), {"git@H.x:a/b/c.git": "https://h.x/a/b/c/-/blob/main/A%20b/c%2B.md", "git@other:a/b.git": None}),
        (fn.site_name(X), {"A - Documents": "A", "A": "A"}),
        (fn.retry_after(X, F.lit("1994-11-06 08:49:30").cast("timestamp")), {"30": 30.0, "Sun, 06 Nov 1994 08:49:37 GMT": 7.0, "": None, "x": None}),
        (fn.char_offset(X, F.lit(3)), {"aé漢b": 2, "abcd": 3}),
    ]
    for column, values in cases:
        assert each(spark, column, *values) == list(values.values())


def test_clone_and_svg(spark):
    got = each(spark, fn.clone_parts(X), "git@H.x:a/b/c.git", "https://u@H.x:80/a/b.git/", "ssh://git@h/a", "https://h/")
    assert [tuple(g) if g else None for g in got] == [("h.x", "a/b/c", "a/b", "c", None), ("h.x", "a/b", "a", "b", 80), None, None]
    assert [tuple(g) for g in each(spark, fn.svg_size(X), '<svg width="30px" height="10.5">', '<svg viewBox="0 0 5 6">', "x")] == [(30.0, 10.5), (5.0, 6.0), (100.0, 100.0)]
    assert each(spark, fn.capped_scale(X.cast("double"), F.lit(10.0), F.lit(2.0)), "5000", "10") == [0.8192, 2.0]
