from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import bm25, mirrors, names, reconcile, rules, search
from docloom.streaming import windows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_smart_case_and_cap(spark):
    docs = spark.createDataFrame([(1, "Foo\nbar foo foo\nFOO"), (2, None), (3, "")], "doc_id long, text string")
    rows = search.search_lines(docs, "foo", per_document=2).orderBy("line_no").collect()
    assert [(r.doc_id, r.line_no, r.n_matches) for r in rows] == [(1, 1, 1), (1, 2, 2)]
    assert [r.line_no for r in search.search_lines(docs, "FOO").collect()] == [3]


def test_truncate(spark):
    line = "a" * 300 + "needle" + "b" * 400
    cut = one(spark, search.truncate(F.col("x"), F.lit(300), F.lit(306)), x=line)
    assert "needle" in cut and len(cut) == 502 and cut[0] == cut[-1] == "…"
    assert one(spark, search.truncate(F.col("x"), F.lit(0), F.lit(1)), x="abc") == "abc"


def test_tokens_leave_out_frontmatter_and_fences(spark):
    body = "---\ntitle: x\n---\nOne Two\n```py\ncode\n```\nthree_4"
    assert one(spark, bm25.tokens(F.col("x")), x=body) == ["one", "two", "three_4"]


def test_events(spark):
    shape = "page_id string, title string, parent_id string, status string, version long, labels array<string>"
    desired = [("new", "t", None, "current", 1, []), ("same", "t", None, "Current", 1, ["b", "a"]), ("label", "t", None, "current", 1, ["a", "a"]), ("move", "u", "p", "archived", 2, [])]
    current = [("gone", "t", None, "current", 1, [], False), ("same", "t", None, "current", 1, ["a", "b"], False), ("label", "t", None, "current", 1, ["a"], False), ("move", "t", None, "current", 1, [], False)]
    events = reconcile.page_events(spark.createDataFrame(desired, shape), spark.createDataFrame(current, shape + ", attachments_skipped boolean"))
    assert sorted(map(tuple, events.select("page_id", "kind").collect())) == [("gone", "DELETED"), ("label", "METADATA_ONLY"), ("move", "ARCHIVE"), ("move", "CONTENT_EDIT"), ("move", "RENAME_MOVE"), ("new", "NEW")]


def test_functions(spark):
    assert one(spark, fn.repo_name(F.col("x")), x="  a / b:c ") == "a-b-c"
    assert one(spark, fn.path_title(F.col("x")), x="a/b/my-long_name.md") == "my long name"
    assert one(spark, fn.first_heading(F.col("x")), x="x\n# Head \n# Two") == "Head"
    assert one(spark, fn.escape_markdown(F.col("x")), x="a*b") == "a\\*b"
    assert one(spark, fn.split_frontmatter(F.col("x")), x="---\na: 1\n---\nbody").asDict() == {"yaml": "a: 1", "body": "body"}
    assert one(spark, rules.first_match(F.col("x"), ["AB*", "abc"]), x="abc") == "AB*"


def test_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:10:00'), (1, timestamp'2024-01-01 01:00:00') AS t(user_id, ts)")
    assert sorted(r.n_events for r in windows.sessions(rows).collect()) == [1, 2]


def test_names(spark):
    made = [one(spark, fn.safe_name(F.col("x")), x=t) for t in ("a/b: c?", "..a..b..", "...", "", "~~", "a\u00a0 b", "x" * 300)]
    assert made == ["a-b- c", "a-b", "untitled", "untitled", "untitled", "a b", "x" * 200]
    nodes = spark.createDataFrame([(1, None, "A"), (2, None, "A"), (3, 1, "A"), (4, 1, "")], "node_id long, parent_id long, title string")
    assert {r.node_id: r.name for r in names.sibling_names(nodes).collect()} == {1: "A", 2: "A(2)", 3: "A", 4: "4"}
    pages = spark.createDataFrame([(1, "d", "A"), (2, "d", "A"), (3, "e", "A")], "page_id long, folder string, name string")
    assert {r.page_id: r.path for r in names.collided_paths(pages).collect()} == {1: "d/A (1).md", 2: "d/A (2).md", 3: "e/A.md"}


def test_scalars(spark):
    assert one(spark, fn.nfc(F.col("x")), x="e\u0301") == "\u00e9"
    assert one(spark, fn.page_ref(F.col("x"), "h.test"), x=" 12 ").page_id == "12"
    assert one(spark, fn.page_ref(F.col("x"), "h.test"), x="https://other.test/wiki/spaces/A/pages/1/x") is None
    assert one(spark, fn.date_in(F.col("x")), x="on 2024/02/31") is None
    assert one(spark, fn.attributes(F.col("x")), x='note {a="1" b="x\\"y" a="2"} c="3"') == {"a": "2", "b": 'x"y'}
    assert one(spark, fn.attributes(F.col("x")), x="note") == {}
    assert one(spark, fn.without_empty_headings(F.col("x")), x="# \nA\n## B\n####### C") == "A\n## B"
    assert one(spark, fn.short_hash(F.col("x")), x="abc") == "a9993e364706816a"


def test_mirrors(spark):
    roots = ["/m/a", "/m/ab/", "/m"]
    assert [one(spark, mirrors.first_root(F.col("x"), roots), x=p) for p in ("/m/a/x", "/m/ab/x", "/m/abc", "/n")] == ["/m/a", "/m/ab/", "/m", None]
    act = lambda p, md=False, ig=False: one(spark, mirrors.file_action(F.col("x"), F.lit(md), F.lit(ig)), x=p)
    assert [act("a.PDF"), act("a.pdf", True), act("a.md", ig=True), act(".pdf"), act("a")] == ["convert_pdf", "copy_markdown", "skip_ignored", "skip_with_warning", "skip_with_warning"]
    files = spark.createDataFrame([("a/b/c.md",), ("a/x.md",), ("z.md",), (None,)], "path string")
    tops = spark.createDataFrame([("a",), ("a/b",), (None,)], "path string")
    assert {r.path: r.ancestor for r in mirrors.nearest_ancestor(files, tops).collect()} == {"a/b/c.md": "a/b", "a/x.md": "a", "z.md": None, None: None}
    refused = lambda a, b: one(spark, mirrors.body_refused(F.col("a"), F.col("b")), a=a, b=b)
    assert [refused(" ", "x"), refused("ab", "x" * 21), refused("ab", "x" * 20)] == ["empty", "shrunk", None]


def test_deduplicated_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:01') AS t(event_id, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["event_id"], "ts", "1 hour")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_titles_and_addresses(spark):
    assert one(spark, fn.split_frontmatter(F.col("x")), x="---\na: 1\n---").asDict() == {"yaml": "a: 1", "body": ""}
    assert one(spark, fn.split_frontmatter(F.col("x")), x="---\n---\nbody") is None
    assert one(spark, fn.derived_title(F.col("x"), F.lit("a/b.c.md")), x="text") == "b.c"
    assert one(spark, fn.with_first_heading(F.col("x"), F.lit("$1")), x="a\n# b\n# c") == "a\n# $1\n# c"
    assert one(spark, fn.keep_outer_blanks(F.col("x"), F.lit(" n ")), x=" \n") == " \nn"
    assert [one(spark, fn.url_with_title(F.col("x"), F.lit("t t")), x=x) for x in ("/a", "a", "h/b/c")] == ["/a", "a", "h/b/t+t"]
    parts = [one(spark, fn.url_segments(F.col("x")), x=x) for x in ("git@h.test:m/wiki/7", "https://h.test//m/wiki", "ssh://g@h.test/m")]
    assert parts == [["m", "wiki", "7"], ["m", "wiki"], ["m"]]
    found = [one(spark, fn.source_of(fn.url_segments(F.col("x")), "m"), x=x) for x in ("git@h.test:m/wiki/7", "https://h.test/m/wiki")]
    assert found[0].asDict() == {"system": "wiki", "id": "7"} and found[1] is None
    assert one(spark, fn.bare_attributes(F.col("x")), x='a="1" b="}"') == {"a": "1", "b": "}"}


def test_source_filters(spark):
    roots = spark.createDataFrame([("wiki", "A"), ("wiki", "b"), ("drive", "A"), (None, None)], "source_type string, source_id string")
    assert sorted(map(tuple, mirrors.filter_sources(roots, {"wiki": ["a"], "drive": []}).collect())) == [("wiki", "A")]
    assert mirrors.filter_sources(roots, {}).count() == 4
