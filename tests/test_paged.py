"""Paged listings by a client over local page files."""

import json

import pytest

from docloom.sources import paged

PAGE = lambda i, **more: {"id": str(i), "title": f"t{i}", "parentId": "0", "version": {"number": 1}, "spaceId": "S", **more}


@pytest.fixture(scope="module")
def client(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    files = {
        "current": {"results": [PAGE(1), PAGE(2, labels={"results": [{"name": "a"}, {"name": "b"}]})], "_links": {"next": "c2"}},
        "c2": {"results": [], "_links": {"next": "c3"}},
        "c3": {"results": [PAGE(10), PAGE(1, version={"number": 3}, labels={"results": [{"name": "x"}]})], "_links": {}},
        "archived": {"results": [PAGE(4, status="archived", parentId=None)], "_links": {"next": ""}},
        "loop": {"results": [PAGE(5)], "next": "loop2"},
        "loop2": {"results": [], "next": "loop2"},
        "7": {"results": [{"title": "f.png", "version": {"number": 2}, "fileSize": 9, "mediaType": "image/png"}, {"title": "g.pdf"}], "_links": {}},
        "8": {"results": []},
    }
    for name, page in files.items():
        (folder / name).write_text(json.dumps(page))
    where = str(folder)

    def read(what, cursor):
        with open(f"{where}/{cursor or what}") as f:
            return json.load(f)

    return read


def test_a_listing_is_read_to_its_end(spark, client):
    paged.register_listing(spark, "test_listing", client)
    listing = spark.read.format("test_listing").option("statuses", "current, archived").load()
    assert listing.rdd.getNumPartitions() == 2
    assert sorted((r.status, r.page, json.loads(r.item)["id"]) for r in listing.collect()) == [("archived", 0, "4"), ("current", 0, "1"), ("current", 0, "2"), ("current", 2, "1"), ("current", 2, "10")]
    pages = {r.page_id: r for r in paged.listed_pages(listing).collect()}
    assert {(k, r.status, r.version, tuple(r.labels)) for k, r in pages.items()} == {("1", "current", 3, ("x",)), ("2", "current", 1, ("a", "b")), ("10", "current", 1, ()), ("4", "archived", 1, ())}
    assert pages["4"].parent_id is None
    assert [r.page_id for r in paged.listed_pages(listing, head=2).orderBy("page_id").collect()] == ["1", "2"]


def test_too_many_pages_and_cursors_that_come_back_are_errors(spark, client):
    paged.register_listing(spark, "test_listing", client)
    for options in ({"statuses": "current", "most_pages": "2"}, {"statuses": "loop"}):
        with pytest.raises(Exception, match="TooManyPages"):
            spark.read.format("test_listing").options(**options).load().collect()
    assert spark.read.format("test_listing").option("statuses", "").load().count() == 0


def test_requests_that_are_rows(spark, client):
    pages = spark.createDataFrame([("7",), ("8",), ("gone",), (None,), ("loop",)], "page_id string")
    found = {(r.page_id, r.filename, r.version, r.size, r.ord): r.error for r in paged.attachments(pages, client).collect()}
    assert found.pop(("7", "f.png", 2, 9, 0)) is None and found.pop(("7", "g.pdf", None, None, 1)) is None
    assert found[("gone", None, None, None, None)].startswith("FileNotFoundError") and found[("loop", None, None, None, None)].startswith("TooManyPages")
    assert found[(None, None, None, None, None)] == "ValueError: no request" and len(found) == 3
    assert paged.attachments(pages.limit(0), client).count() == 0
    one = {r.page_id: (r.item, r.error is None) for r in paged.fetched(pages.where("page_id in ('7', 'gone')"), lambda page_id: {"id": page_id} if page_id == "7" else 1 / 0).collect()}
    assert one == {"7": ('{"id":"7"}', True), "gone": (None, False)}
