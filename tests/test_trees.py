"""Trees as JSON and what a fresh tree takes over from a cached one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import identity, nodes, tree_json


def made(rng, depth):
    out = {"type": rng.choice(["Paragraph", "BulletList", 'odd "é']), "level": rng.randint(1, 5), "attributes": {"b": "x\n", "a": "ü"}, "flag": True, "none": None, "num": 1.25, "list": [], "mixed": [1, {"type": "Text"}]}
    for slot in rng.sample(["alpha", "children", "zeta", "aa", "typed"], rng.randint(0, 3)) if depth else []:
        out[slot] = [made(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return out


def test_trees_of_any_depth_come_back(spark):
    rng = random.Random(1)
    trees = {i: {"version": 2, "root": {**made(rng, 3), "type": "Document"}} for i in range(12)}
    deep = {"type": "Text", "content": "end"}
    for _ in range(50):
        deep = {"type": "BlockQuote", "children": [deep]}
    trees[50] = {"version": 2, "root": {"type": "Document", "children": [deep], "title": "t"}}
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in trees.items()], "doc_id long, json string").withColumn("path", F.lit("clash"))
    rows = tree_json.read(docs)
    assert rows.where("doc_id = 50").agg(F.max(F.size("path"))).first()[0] == 51
    canonical = {i: json.dumps(t, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, t in trees.items()}
    assert {r.doc_id: r.json for r in tree_json.write(rows).collect()} == canonical
    assert tree_json.unknown_kinds(rows).where("kind <> 'odd \"é'").count() == 0
    assert tree_json.read(docs.limit(0)).count() == 0 and tree_json.write(rows.limit(0)).count() == 0


def test_what_cannot_be_read_says_why(spark):
    texts = {
        "nope": "not JSON", "[1]": "not an object", '{"root":{"type":"Document"}}': "no version", '{"version":3,"root":{"type":"Document"}}': "unsupported version 3",
        '{"version":2}': "no root", '{"version":2,"root":{"type":"Text"}}': "the root is a Text", '{"version":null,"root":{}}': "unsupported version null", '{"version":2,"root":[]}': "the root is a value",
    }
    docs = spark.createDataFrame([*texts.items(), (None, None)], "json string, want string").withColumn("doc_id", F.lit(1))
    assert all(r.p == (r.want or "not JSON") for r in docs.select("want", tree_json.problem(F.col("json")).alias("p")).collect())
    assert tree_json.read(docs).count() == 0
    assert docs.limit(1).select(tree_json.problem(F.lit('{"v":1,"root":{"type":"Document"}}'), 1, "v")).first()[0] is None


def node(type, /, **members):
    return {"type": type, **members}


def text(content, **members):
    return node("Text", content=content, **members)


def rows_of(spark, docs):
    frame = spark.createDataFrame([(i, json.dumps({"version": 2, "root": node("Document", children=c)})) for i, c in docs.items()], "doc_id string, json string")
    return tree_json.table_of(tree_json.read(frame))


def back(table):
    return {r.doc_id: json.loads(r.json)["root"].get("children", []) for r in tree_json.write(tree_json.fields_of(table)).collect()}


def test_node_tables_and_defaults(spark):
    tree = [node("OrderedList", items=[node("ListItem", children=[node("Paragraph", inlines=[text("a"), node("Strong", tokens=[text("b")])])])], start=1, tight=True, node_id="n1", attributes={"x": "1"}), node("CodeBlock", content="c", language=None)]
    table = rows_of(spark, {"d": tree})
    assert [(tuple(r.path), r.tier, r.kind, r.text) for r in table.orderBy("path").collect()][:4] == [((0,), "block", "OrderedList", None), ((0, 0), "struct", "ListItem", None), ((0, 0, 0), "block", "Paragraph", None), ((0, 0, 0, 0), "inline", "Text", "a")]
    plain = [dict(tree[0]), node("CodeBlock", content="c")]
    del plain[0]["start"]  # a default is not written
    assert back(table) == {"d": plain}


P = lambda *inlines, **members: node("Paragraph", inlines=list(inlines), **members)
LINK = lambda href, label: node("Link", href=href, tokens=[text(label)])


@pytest.fixture(scope="module")
def grafted(spark):
    fresh, cached, want = {}, {}, {}

    def case(name, new, old, out):
        fresh[name], cached[name], want[name] = new, old, out

    soft = [P(text("a"), node("SoftBreak"), text("b", origin=node("Origin", source_format="markdown")), node_id="old")]
    case("softbreak", [P(text("a b"))], soft, soft)
    case("text edit", [P(text("a c"))], [P(text("a b"), node_id="old")], [P(text("a c"), node_id="old")])
    case("emphasis edit", [P(node("Emph", tokens=[text("a")]))], [P(node("Strong", tokens=[text("a")]))], [P(node("Emph", tokens=[text("a")]))])
    case("link edit", [P(LINK("http://new", "a"))], [P(LINK("http://old", "a"))], [P(LINK("http://new", "a"))])
    case("nested edit", [P(node("Strong", tokens=[text("a"), node("Emph", tokens=[text("b")])]))], [P(node("Strong", tokens=[node("Emph", tokens=[text("a")]), text("b")]))], [P(node("Strong", tokens=[text("a"), node("Emph", tokens=[text("b")])]))])
    case("autolink", [P(LINK("https://x.test", "x.test"))], [P(text("x.test"))], [P(text("x.test"))])
    opaque = [P(text("see "), node("Emoticon", name="smile"))]
    case("opaque kinds are one mark", [P(text("see "), node("InlineMacro", name="emoticon"))], opaque, opaque)
    case("opaque gone", [P(text("see "))], opaque, [P(text("see "))])
    entity = node("Origin", source_format="confluence-storage", entity_form=[[1, "&mdash;"]], leading_ws=" ")
    case("entities of another text", [P(text("x y"), node("Emph", tokens=[text("q")]))], [P(text(" - z", origin=entity))], [P(text("x y", origin=node("Origin", source_format="confluence-storage", leading_ws=" ")), node("Emph", tokens=[text("q")]))])
    link = node("ConfluenceLink", target_kind="page", target="T", attributes={"ac:local-id": "L"})
    case("inline attributes", [P(text("new "), node("ConfluenceLink", target_kind="page", target="T"))], [P(text("old "), link)], [P(text("new "), link)])
    case("kind differs", [P(text("a"))], [node("Heading", level=1, inlines=[text("a")], node_id="old")], [P(text("a"))])
    case("level differs", [node("Heading", level=2, inlines=[text("a b")])], [node("Heading", level=1, inlines=[text("a"), node("SoftBreak"), text("b")], node_id="h")], [node("Heading", level=2, inlines=[text("a b")], node_id="h")])
    case("extra block", [P(text("a")), P(text("b"))], [P(text("a"), node_id="one")], [P(text("a"), node_id="one"), P(text("b"))])
    case("below another kind", [node("BlockQuote", children=[P(text("a"))])], [node("Callout", kind="tip", body=[P(text("a"), node_id="deep")])], [node("BlockQuote", children=[P(text("a"))])])
    cell = lambda **m: node("Table", rows=[node("TableRow", cells=[node("TableCell", children=[P(text("c"))], **m)])])
    case("cells keep their spans", [cell()], [cell(attributes={"colspan": "3", "class": "k"})], [cell(attributes={"class": "k"})])
    macro = lambda **m: node("ConfluenceMacro", **m)
    case("macro", [macro(name="", rich_body=True)], [macro(name="toc", params={"a": "1"}, plain_body="x")], [macro(name="toc", params={"a": "1"}, plain_body="x")])
    case("fresh wins", [macro(name="n", params={"b": "2"}, trailing_ws="")], [macro(name="m", params={"a": "1"}, trailing_ws="\n", rich_body=True)], [macro(name="n", params={"b": "2"}, trailing_ws="", rich_body=True)])
    case("no cached tree", [P(text("a"))], [], [P(text("a"))])
    return back(identity.graft(rows_of(spark, fresh), rows_of(spark, cached))), want


def test_graft(grafted):
    got, want = grafted
    for name, tree in want.items():
        assert got[name] == tree, name


def test_graft_of_nothing(spark):
    table = rows_of(spark, {"d": [P(text("a"))]})
    assert identity.graft(table.limit(0), table).count() == 0
    assert back(identity.graft(table, table.limit(0))) == {"d": [P(text("a"))]}
    assert nodes.flat_texts(table).first().flat_text == "a"


def test_events_of_dropped_and_opaque_nodes(spark):
    tree = [P(), P(text(" ")), node("RawBlock", content="<x/>"), node("BlockQuote", children=[P(text("[!NOTE]")), P(text("a"))]), P(text("b"), node("RawInline", content="<y/>"))]
    done, events = nodes.normalise_with_events(rows_of(spark, {"d": tree}))
    assert sorted((tuple(r.path), r.kind, r.reason) for r in events.collect()) == [
        ((0,), "Paragraph", "drop_empty_paragraphs"), ((1,), "Paragraph", "drop_empty_paragraphs"), ((1, 0), "Text", "drop_empty_paragraphs"), ((2,), "RawBlock", "opaque"),
        ((3, 0), "Paragraph", "attach_callout_kind"), ((3, 0, 0), "Text", "attach_callout_kind"), ((4, 1), "RawInline", "opaque"),
    ]
    assert sorted(tuple(r.path) for r in done.collect()) == [(2,), (3,), (3, 1), (3, 1, 0), (4,), (4, 0), (4, 1)]
    table = rows_of(spark, {"d": [node("BlockQuote", children=[node("BlockQuote", children=[P(text("a"))])]), P(text("b"))]})
    left, events = nodes.to_opaque(table, F.col("kind") == "BlockQuote", F.concat(F.lit("<q>"), F.size("path").cast("string")), F.lit("not known"))
    assert [(tuple(r.path), r.kind, r.reason) for r in events.collect()] == [((0,), "BlockQuote", "not known")]
    assert sorted((tuple(r.path), r.kind, r.text) for r in left.collect()) == [((0,), "RawBlock", "<q>1"), ((1,), "Paragraph", None), ((1, 0), "Text", "b")]
