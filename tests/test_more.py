"""Operators on files, ignore lines, gates, searches, states, reviews and node tables, on small inputs."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from docloom import api
from docloom.functions import frontmatter as fm
from docloom.operators import bm25, ignore, mirrors, names, nodes, reconcile, review, rules, search, trees
from docloom.sources import files

from pyspark import cloudpickle

from test_text import each

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder

X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_ignore_lines(spark):
    lines = ["# c", "*.tmp", "build/", "/root.md", "docs/**/old", "!keep.tmp", "a/b", "[ab]?.txt", "\\#x"]
    paths = ["x.tmp", "d/x.tmp", "keep.tmp", "build/a", "d/build/a", "build", "root.md", "d/root.md", "docs/old", "docs/x/y/old/z", "a/b", "x/a/b", "a1.txt", "c1.txt", "#x", None]
    want = [True, True, False, True, True, False, True, False, True, True, True, False, True, False, True, False]
    assert each(spark, ignore.is_ignored(X, lines), *paths) == want
    assert each(spark, ignore.is_ignored(X, ["build/"], is_dir=True), "build", "x") == [True, False]
    assert each(spark, ignore.prunes(X, ["Archive/", "t/**", "*.tmp"]), "Archive", "x/Archive", "t", "u") == [True, True, True, False]
    assert each(spark, ignore.is_ignored(X, []), "a") == [False]
    rows = spark.createDataFrame([(".mddignore",), (".git/a.tmp",), ("a.tmp",), ("b",)], "path string")
    assert [r.path for r in ignore.prunable(rows, ["*"]).collect()] == ["a.tmp", "b"]


def test_ignored_pages(spark):
    pages = [("1", "A.md", "A"), ("2", "Archive.md", "Archive"), ("3", "Archive/x.md", "Archive/x"), ("4", "b.md", "b"), ("5", None, None), ("6", "Archive/y.md", "Archive/y")]
    table = spark.createDataFrame(pages, "page_id string, md_rel string, child_rel string")
    kept, skipped = ignore.filter_desired(table, spark.createDataFrame([("3",)], "page_id string"), ["Archive/", "b.md"])
    assert sorted(r.page_id for r in kept.collect()) == ["1", "3", "5"]
    assert sorted(r.skip_path for r in skipped.collect()) == ["Archive/", "Archive/y/", "b.md"]


def test_gates(spark):
    assert each(spark, rules.first_match(X, ["*", "Ab*"]), "abc", "*", "x") == ["Ab*", "*", None]
    assert each(spark, rules.gate(X, ["A*"]), "ab", "", "b", None) == ["listed", "unknown", None, "unknown"]
    assert each(spark, rules.gate(X, []), "") == [None] and each(spark, rules.gate(X, None), "a") == ["no_list"]
    split = F.split(X, "/")
    source = rules.source_system(split, F.when(X == "n", "none"), "m")
    assert each(spark, rules.push_gate(source, ["S*"], []), "m/confluence/S1", "m/confluence", "m/sharepoint/S1", "n", "z") == ["listed", "no_id", None, None, "unidentified"]
    answers = ['{"update":{"restrictions":{"user":{"results":[]},"group":{"results":[]}}}}', '{"update":{"restrictions":{"user":{"results":[{"accountId":"me"}]}}}}', '{"update":{"restrictions":{"user":{"results":[{"accountId":"a"},{"accountId":"b"}]}}}}', '{"update":{"restrictions":{"group":{"results":[{"name":"g"}]}}}}', "broken"]
    assert each(spark, rules.can_update(X, F.lit("me")), *answers) == [True, True, False, False, None]
    roots = spark.createDataFrame([("confluence", "A1"), ("sharepoint", "A1"), ("docs", "A1")], "source_type string, identifier string")
    assert sorted(r.source_type for r in rules.filter_listed(roots, {"confluence": ["a*"], "sharepoint": None}).collect()) == ["docs", "sharepoint"]
    bodies = [mirrors.body_refused(X, F.lit("r" * 30)), mirrors.body_refused(X, F.lit("r" * 30), allow_empty=True)]
    assert each(spark, bodies[0], "\n\n", "ab", "abcd") == ["empty", "shrunk", None] and each(spark, bodies[1], "\n") == [None]


def test_anchored_search_and_spans(spark):
    docs = spark.createDataFrame([("m/a.md", "Foo\nbar x"), ("m/b.md", "---\ntitle: bar t\n---\n# H\nbar bar"), ("z.md", "bar")], "path string, text string")
    rows = search.search_lines(docs, "^bar", "path").collect()
    assert sorted((r.path, r.line_no) for r in rows) == [("m/a.md", 2), ("m/b.md", 5), ("z.md", 1)]
    assert [r.path for r in search.search_lines(docs, "x$", "path").collect()] == ["m/a.md"]
    found = search.with_metadata(search.search_lines(docs, "bar", "path"), docs, [{"path": "m/", "mirror_name": "M"}])
    got = {(r.path, r.line_no): r for r in found.collect()}
    assert set(got) == {("m/a.md", 2), ("m/b.md", 5), ("z.md", 1)}
    assert (got["m/b.md", 5].title, got["m/b.md", 5].display_path, got["z.md", 1].mirror) == ("bar t", "M/b.md", None)
    assert [m.line_no for m in search.grouped(found).where("path = 'm/b.md'").first().matches] == [5]
    records = {r.path: r.record for r in search.json_records(found).collect()}
    assert records["z.md"] == '{"path":"z.md","mirror":null,"line":1,"snippet":"bar","display_path":"z.md"}'
    assert records["m/b.md"].startswith('{"path":"m/b.md","mirror":"M","line":5,"snippet":"bar bar","title":"bar t"')
    assert {r.path: r.text for r in search.human_text(found).collect()}["m/b.md"] == "M/b.md\n  Title: bar t\n\n  L5:  bar bar\n"
    assert [[tuple(s) for s in y] for y in each(spark, search.spans(X, "a+"), "baab a", "x")] == [[(1, 3), (5, 6)], []]
    cut = each(spark, search.truncated(X, search.spans(X, "needle"), 100), "a" * 300 + "needle" + "b" * 300, "short needle", "c" * 200)
    assert cut[0].text[cut[0].spans[0].start : cut[0].spans[0].end] == "needle" and len(cut[0].text) == 102
    assert cut[1].text == "short needle" and tuple(cut[1].spans[0]) == (6, 12) and cut[2].text == "c" * 99 + "…"
    assert each(spark, search.highlighted(X, search.spans(X, "a+"), "<", ">"), "baab a") == ["b<aa>b <a>"]
    lines = spark.createDataFrame([('{"type":"match","data":{"path":{"text":"p"},"line_number":3,"lines":{"text":"x\\n"},"submatches":[{"match":{"text":"x"},"start":0,"end":1}]}}',), ('{"type":"end"}',), ("broken",)], "value string")
    assert [(r.path, r.line_no, r.line, tuple(r.spans[0])) for r in search.parse_records(lines).collect()] == [("p", 3, "x", (0, 1))]


def test_bm25_against_plain_python(spark):
    import math
    from collections import Counter

    texts = ["red green blue red", "green blue yellow", "", "red", "other words here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").split() for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)
    df = Counter(w for own in words for w in set(own))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}

    def score(q, d):
        count = Counter(words[d])
        return round(sum(idf[w] * count[w] * 2.5 / (count[w] + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) for w in words[q]), 6)

    got = bm25.top_k(docs, docs, 2, "doc_id", "text", itself=True).collect()
    for q in range(n):
        want = sorted(((-score(q, d), d) for d in range(n) if d != q))[:2]
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.doc_id_query == q] == [(d, -s) for s, d in want]
    assert bm25.top_k_pairs(docs, 2, 100.0).count() == 0 and bm25.top_k(docs.limit(0), docs, 2, "doc_id", "text").count() == 0
    pool = docs.where("doc_id in (2, 3)")
    assert {r.doc_id for r in bm25.top_k(docs, docs, 2, "doc_id", "text", pool=pool).collect()} == {2, 3}


def test_bm25_keeps_no_table_of_pairs(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("red green blue yellow one two three four five six".split()) for _ in range(8)) + f" w{i % 90} v{i}" for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [(r.doc_id_query, r.rank, r.doc_id, r.score) for r in bm25.top_k(docs, docs, 3, "doc_id", "text", itself=True).collect()]
    kept, rows = bm25.stored, []

    def counted(df, name):
        out = kept(df, name)
        rows.append((out.count(), name))
        return out

    monkeypatch.setattr(bm25, "stored", counted)
    # Many small blocks of either side, and of what is scored at once, give the same.
    for name, value in (("ASKED", 300), ("QUERIES", 50), ("WORDS", 200), ("PAIRS", 500), ("MATRIX", 300)):
        monkeypatch.setattr(bm25, name, value, raising=False)
    assert sorted((r.doc_id_query, r.rank, r.doc_id, r.score) for r in bm25.top_k(docs, docs, 3, "doc_id", "text", itself=True).collect()) == sorted(plain)
    # All 57,360 pairs share words; what is stored is no longer than the documents' words.
    assert max(rows)[0] <= 240 * 10


@pytest.fixture
def mirror(tmp_path):
    made = {
        "a.md": "---\nconfluence:\n  page_id: '7'\n  version: 3\n  labels: [x]\n---\n# Title A\n",
        "sub/new.md": "---\nconfluence:\n  space_key: S\n---\n# New\n",
        "note.md": "plain",
        "p-attachments/f.pdf.md": "converted",
        "f.pdf.md": "mine",
        "INDEX.md": "index",
        ".hidden/x.md": "# h",
        "d/Foo.docx": "office",
        "d/~$Foo.docx": "lock",
    }
    for path, text in made.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_files_and_mirror_state(spark, mirror):
    docs = files.documents(spark, mirror)
    assert [r.path for r in docs.collect()] == sorted(["INDEX.md", "a.md", "f.pdf.md", "note.md", "p-attachments/f.pdf.md", "sub/new.md"])
    assert "INDEX.md" not in [r.path for r in files.index_documents(spark, mirror).collect()]
    seen = [r.path for r in files.files(spark, mirror, ["*.pdf.md"]).collect()]
    assert seen == ["INDEX.md", "a.md", "d/Foo.docx", "note.md", "sub/new.md"]
    state = {r.path: r for r in mirrors.mirror_state(docs).collect()}
    assert {p: r.bucket for p, r in state.items()} == {"a.md": "tracked", "sub/new.md": "untracked", "note.md": "manual", "f.pdf.md": "manual", "p-attachments/f.pdf.md": "attachment_derived", "INDEX.md": "manual"}
    assert (state["a.md"].page_id, state["a.md"].title, state["a.md"].version, state["a.md"].labels, state["a.md"].status) == ("7", "Title A", 3, ["x"], "CURRENT")
    twice = docs.where("path = 'a.md'").unionByName(docs.where("path = 'a.md'").withColumn("path", F.lit("b.md")))
    with pytest.raises(Exception, match="several files"):
        mirrors.mirror_state(twice).collect()
    found = api.search(spark, "title", [{"path": mirror, "mirror_name": "M", "source_type": "confluence", "identifier": "S"}])
    assert [(r.display_path, r.page_id, r.title) for r in found.collect()] == [("M/a.md", "7", "Title A")]
    assert api.search(spark, "title", [{"path": mirror, "mirror_name": "M", "source_type": "confluence", "identifier": "S"}], {"confluence": ["s"]}).count() == 0
    done = files.convert(files.files(spark, mirror, content=True), {".docx": lambda b: b.decode().upper(), ".md": lambda b: 1 / 0}).collect()
    assert {(r.path, r.markdown) for r in done if r.error is None} == {("d/Foo.docx", "OFFICE")} and all(r.markdown is None for r in done if r.error)
    digest = files.with_digest(files.files(spark, mirror, content=True)).where("path = 'note.md'").first().sha256
    assert digest == "".join(f"{b:02x}" for b in __import__("hashlib").sha256(b"plain").digest())


def test_listing_and_names(spark):
    pages = ['{"id":"10","title":"B","version":{"number":2},"labels":{"results":[{"name":"x"},{"name":"y"}]}}', '{"id":"9","title":"A","parentId":"10","status":"archived"}', "broken"]
    got = files.desired_pages(spark.createDataFrame([(p,) for p in pages], "page string"), head=1).collect()
    assert [(r.page_id, r.title, r.status, r.version) for r in got] == [("9", "A", "archived", 0)]
    both = {r.page_id: r.labels for r in files.desired_pages(spark.createDataFrame([(p,) for p in pages], "page string")).collect()}
    assert both == {"10": ["x", "y"], "9": []}
    sites = spark.createDataFrame([("A b - Documents",), ("C",)], "name string")
    mapping = spark.createDataFrame([("C", "see")], "site string, repo string")
    assert [tuple(r) for r in api.list_sites(sites, mapping).collect()] == [("A b", "A-b"), ("C", "see")]
    blobs = spark.createDataFrame([(2, bytearray(b"x")), (1, bytearray(b"x")), (3, bytearray(b"y"))], "ord int, content binary")
    assert sorted(r.ord for r in names.first_of_each(blobs).collect()) == [1, 3]


def test_pairs_and_plans(spark):
    sources = spark.createDataFrame([("d/A.docx", "1", False), ("B.pptx", "2", True), ("~$B.pptx", "", False), ("c.txt", "", False)], "path string, sha256 string, locked boolean")
    outputs = spark.createDataFrame([("d/A.docx.md", "m"), ("E.docx.md", "n"), ("notes.md", "")], "path string, sha256 string")
    synced = spark.createDataFrame([("d/A.docx.md", "1", "old", True)], "markdown string, office_sha256 string, md_sha256 string, update_office boolean")
    plan = [tuple(r) for r in api.plan_folder(sources, outputs, synced).collect()]
    assert plan == [("B.pptx", "B.pptx.md", "word_locked"), ("E.docx", "E.docx.md", "first_sync_md_authoritative"), ("d/A.docx", "d/A.docx.md", "md_to_docx")]
    assert [r.action for r in api.plan_folder(sources, outputs, synced, read_only=True, head=2).collect()] == ["word_locked", "skip_read_only"]
    times = spark.createDataFrame([("a.docx", 5, False), ("a.docx.pdf", 4, False), ("b.docx", 1, False), ("b.docx.pdf", 2, False), ("templates/c.docx", 1, False), ("l.docx", 1, True)], "path string, modified int, is_link boolean")
    assert [r.path for r in mirrors.stale_siblings(times, ".docx").collect()] == ["a.docx"]


def test_whole_sync(spark):
    shape = "page_id string, title string, parent_id string, status string, version long, labels array<string>"
    desired = spark.createDataFrame([("1", "t", None, "current", 2, []), ("2", "t", None, "current", 1, ["n"])], shape)
    current = [("1", "t", None, "current", 2, [], True, "a.md", "2024-01-01T00:00:00+00:00", "2024-01-02"), ("2", "t", None, "current", 1, [], False, "b.md", "2024-01-01T00:00:00+00:00", "2024-01-02"), ("3", "t", None, "current", 1, [], False, "c.md", None, None), ("4", "t", None, "current", 1, [], False, "d.md", None, None)]
    state = spark.createDataFrame(current, shape + ", attachments_skipped boolean, path string, exported_at string, m string").withColumn("modified", F.col("m").cast("timestamp")).drop("m")
    everywhere = spark.createDataFrame([("3", "other", "OTH")], "page_id string, space_id string, space_key string")
    events = reconcile.classify_events(desired, state, everywhere, "here", spark.createDataFrame([("new.md",)], "path string"))
    got = sorted((str(r.page_id), r.kind, str(r.current_path), r.note) for r in events.collect())
    assert got == [("1", "CONFLICT", "a.md", ""), ("2", "LOCAL_PUSH", "b.md", ""), ("3", "CROSS_SPACE_MOVE", "c.md", "moved to space OTH"), ("4", "DELETED", "d.md", ""), ("None", "NEW", "new.md", "local-authored publish candidate")]
    counts = reconcile.event_summary(events).first()
    assert (counts.conflict, counts.deleted, counts.cross_space_move, counts.new) == (1, 1, 1, 1)
    assert sorted(r.page_id for r in reconcile.next_state(state, events, desired).collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="listed"):
        api.plan_space(desired, state.withColumn("bucket", F.lit("tracked")), everywhere, "SEC", "here", ["sec"])
    pages = spark.createDataFrame([("1", "t", None, "s", "x/t.md"), ("2", "u", None, "s2", "u.md")], "page_id string, title string, parent_id string, space_id string, path string").withColumn("status", F.lit("current"))
    assert api.rename_page(pages, "1", "N w").where("page_id = '1'").first().path == "x/N w.md"
    assert api.archive_page(pages, "2").where("status = 'archived'").count() == 1
    with pytest.raises(Exception, match="another space"):
        api.move_page(pages, "1", "2").collect()


def test_deep_trees(spark):
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(300)] + [(900, 901, "x"), (901, 900, "y")]
    table = spark.createDataFrame(rows, "node_id long, parent_id long, title string")
    got = {r.node_id: r.depth for r in trees.page_paths(spark, table).collect()}
    assert got == {k: k for k in range(300)}
    small = spark.createDataFrame([(1, None, "b", "S"), (2, 1, "c", "S"), (3, 2, "d", "S")], "node_id long, parent_id long, name string, space string")
    folders, flat = spark.createDataFrame([("b",)], "path string"), spark.createDataFrame([("b/c.md",)], "path string")
    steps = trees.move_chain(small, small.where("node_id = 3").select("node_id"), folders, flat, "S").orderBy("step").collect()
    assert [(r.folder, r.state) for r in steps] == [("b", "dir"), ("b/c", "flat"), ("b/c/d", "absent")]


DOCS = [("y.md", "one two"), ("z.md", "three four"), ("a.md", "alpha beta gamma delta"), ("b.md", "alpha beta gamma delta"), ("c.md", "---\nupdated_at: '2020-01-01'\n---\nzeta eta theta"), ("d.md", "zeta eta theta iota")]


def model(prompts):
    out = []
    for p in prompts:
        if p.startswith("dup"):
            out.append('{"overlap":"high","summary":"same","shared_sections":["s"],"suggested_action":"merge"}' if "a.md" in p and "b.md" in p else "null")
        elif p.startswith("inc"):
            out.append('{"contradictions":[{"issue":"i","page_a_quote":"q"},3]}' if "a.md" in p and "b.md" in p else '{"contradictions":[]}')
        elif p.startswith("old"):
            out.append('{"confidence":"high","replacement":"x/d.md","evidence":"e"}')
        elif p.startswith("sum"):
            out.append("S " + p.split("\n")[-1][:5])
        else:
            out.append(p.split("\n\n", 1)[1].replace("beta", "BETA"))
    return out


def test_review(spark):
    docs = spark.createDataFrame(DOCS, "path string, text string")
    dup = review.duplicates(docs, model, "dup", least=0.1).collect()
    assert [(r.a, r.b, r.summary, r.shared_sections) for r in dup] == [("a.md", "b.md", "same", ["s"])]
    inc = review.inconsistencies(docs, model, "inc").collect()
    assert [(r.a, r.b, len(r.contradictions), r.contradictions[0].issue) for r in inc if r.a == "a.md"][0][3] == "i"
    now = F.lit("2024-01-01").cast("timestamp")
    old = review.stale_pages(docs, model, "old", now, 365).collect()
    assert [(r.path, r.replacement, r.last_updated) for r in old] == [("c.md", "d.md", "2020-01-01")]
    text = api.review_report(docs, model, ["duplicates", "stale"], "all", "2024-01-01", now, 365, {"duplicates": "dup", "stale": "old"}).first().text
    assert "### `a.md` and `b.md`" in text and "- **Likely superseded by:** `d.md`" in text and "**Modes:** duplicates, stale" in text
    cached = spark.createDataFrame([(__import__("hashlib").sha256(b"p1").hexdigest(), "known")], "prompt_hash string, answer string")
    asked = review.ask(spark.createDataFrame([("p1",), ("sum\nxyz",)], "prompt string"), model, cache=cached).collect()
    assert {(r.answer, r.cached) for r in asked} == {("known", True), ("S xyz", False)}
    broken = review.ask(spark.createDataFrame([("p",)], "prompt string"), lambda p: 1 / 0).first()
    assert broken.answer is None


def test_index_and_rewrite(spark):
    body = "zeta"
    known = __import__("hashlib").sha256(body.encode()).hexdigest()
    docs = spark.createDataFrame([("x-y.md", f"---\nai:\n  summary: kept\n  summary_input_hash: {known}\n---\n{body}"), ("z.md", "hello")], "path string, text string")
    made = {r.path: (r.summary, r.cached) for r in review.summaries(docs, model, "sum").collect()}
    assert made == {"x-y.md": ("kept", True), "z.md": ("S hello", False)}
    summary = spark.createDataFrame([("x-y.md", "kept"), ("z.md", "S")], "path string, summary string")
    assert review.index_text(summary).first().text == "# Index\n\n- **[x y](x-y.md)** — kept\n- **[z](z.md)** — S\n"
    clusters = spark.createDataFrame([(0, "T", ["z.md", "gone.md"]), (1, "None", [])], "ord int, topic string, paths array<string>")
    assert review.index_text(summary, clusters).first().text == "# Index\n\n## T\n\n- **[z](z.md)** — S\n- **[gone](gone.md)** — \n\n## Other\n\n- **[x y](x-y.md)** — kept\n"
    assert "## Pages" in api.index(docs, model, "sum", clustered=True).first().text
    texts = spark.createDataFrame([("k", "\nalpha beta\n```\nbeta\n```\nbeta\n"), ("l", "plain")], "path string, text string")
    got = {r.path: r for r in api.rewrite(texts, model, "rewrite").collect()}
    assert got["k"].rewritten == "\nalpha BETA\n```\nbeta\n```\nBETA\n" and got["k"].changed and not got["l"].changed
    lost = review.rewrites(texts.limit(1), lambda p: ["nothing"] * len(p), "r").first()
    assert lost.rewritten is None and lost.error == "a protected region is missing"


NODE = "doc_id long, path array<int>, tier string, slot string, kind string, node_id string, text string, attrs array<struct<k:string,v:string>>, tight boolean"


def tree(spark, rows):
    return spark.createDataFrame([(1, path, tier, "children", kind, "", text, attrs, False) for path, tier, kind, text, attrs in rows], NODE)


def test_node_passes(spark):
    rows = [
        ([0], "block", "BlockQuote", None, []),
        ([0, 0], "block", "Paragraph", None, []),
        ([0, 0, 0], "inline", "Text", "[!NOTE] ", []),
        ([0, 1], "block", "Paragraph", None, []),
        ([0, 1, 0], "inline", "Text", "  a \t b&eacute; ", []),
        ([0, 1, 1], "inline", "SoftBreak", None, []),
        ([0, 1, 2], "inline", "Strong", None, []),
        ([0, 1, 2, 0], "inline", "Text", "c", []),
        ([1], "block", "Paragraph", None, []),
        ([1, 0], "inline", "Text", " ", []),
        ([2], "block", "Paragraph", None, [("local-id", "x")]),
        ([3], "block", "BulletList", None, [("b", "1"), ("a", "2"), ("colspan", "1")]),
        ([3, 0], "struct", "ListItem", None, []),
        ([3, 0, 0], "block", "Paragraph", None, []),
        ([3, 0, 0, 0], "inline", "Text", "item", []),
        ([4], "block", "BulletList", None, [("ri:z", "1"), ("a", "2")]),
        ([4, 0], "struct", "ListItem", None, []),
        ([4, 0, 0], "block", "Paragraph", None, []),
        ([4, 0, 0, 0], "inline", "Text", "item", []),
        ([4, 0, 1], "block", "CodeBlock", "x", []),
    ]
    done = {tuple(r.path): r for r in nodes.normalise(tree(spark, rows)).collect()}
    assert (done[0,].kind, done[0,].text) == ("Callout", "note")
    assert (0, 0) not in done and (0, 0, 0) not in done and (1,) not in done and (2,) in done
    assert done[0, 1, 0].text == "a bé " and (done[0, 1, 1].kind, done[0, 1, 1].text) == ("Text", " ")
    assert done[3,].tight and not done[4,].tight
    assert [a.k for a in done[3,].attrs] == ["a", "b"] and [a.k for a in done[4,].attrs] == ["ri:z", "a"]
    again = {tuple(r.path): r for r in nodes.normalise(spark.createDataFrame(list(done.values()), NODE)).collect()}
    assert again == done


def test_node_ids_and_texts(spark):
    rows = [
        ([0], "block", "Paragraph", None, [("ac:local-id", "L")]),
        ([0, 0], "inline", "Text", "a ", []),
        ([0, 1], "inline", "Link", None, []),
        ([0, 1, 0], "inline", "Text", " b", []),
        ([0, 2], "inline", "ConfluenceImage", "f.png", [("target-kind", "attachment")]),
        ([1], "block", "Heading", None, []),
    ]
    table = tree(spark, rows)
    ids = {tuple(r.path): r.node_id for r in nodes.assign_ids(table).collect()}
    assert (ids[0,], ids[1,], ids[0, 0]) == ("b00001", "b00002", "")
    assert {tuple(r.path): r.flat_text for r in nodes.flat_texts(table).collect()} == {(0,): "a b", (1,): ""}
    assert [r.ids for r in nodes.identities(table).collect()] == [["L"]]
    assert [r.filename for r in nodes.attachment_refs(table).collect()] == ["f.png"]
    kept = nodes.filter_blocks(table, F.col("kind") != "Paragraph")
    assert [tuple(r.path) for r in kept.collect()] == [(1,)]
    fresh = tree(spark, [([0], "block", "Paragraph", None, [("x", "1")]), ([1], "block", "Paragraph", None, [])])
    joined = {tuple(r.path): r for r in nodes.reattach(fresh, nodes.assign_ids(table)).collect()}
    assert joined[0,].node_id == "b00001" and [a.k for a in joined[0,].attrs] == ["x", "ac:local-id"] and joined[1,].node_id == ""
    assert nodes.same_inlines(table, table).count() == 2


def test_caches(spark):
    cache = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:50'), (3, null) AS t(k, at)")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert [r.k for r in rules.valid_entries(cache, "at", now, 30).collect()] == [2]
    assert sorted(r.k for r in rules.expired_entries(cache, "at", now, 30).collect()) == [1, 3]
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    blob = b'{"messages":[{"content":"hi","role":"user"}],"model":"m","task":"t","v":1}x'
    assert spark.range(1).select(rules.cache_key(F.lit("m"), F.lit("t"), messages, 1, F.lit("x"))).first()[0] == __import__("hashlib").sha256(blob).hexdigest()
    owner = spark.createDataFrame([("o", None), (None, None), (None, False), (None, True)], "o string, u boolean").select(mirrors.classify_owner(F.col("o"), F.col("u")).alias("c")).collect()
    assert [(r.c.managed, r.c.reason, r.c.unverified) for r in owner] == [(True, "OWNER", False), (False, None, True), (True, "READ_ONLY", False), (False, None, False)]
    assert each(spark, fm.field(X, "a", "b"), '{"a":{"b":1}}', '{"a":1}') == ["1", None]
