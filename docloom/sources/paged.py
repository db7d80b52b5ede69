"""Listings that come in pages: a Spark data source by an injected client, and requests that are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A client: what is listed (a status, or any request) and a cursor (None at first) to a page, a dict as ``page_items`` reads it.
Client = Callable[[str, str | None], dict]


class TooManyPages(RuntimeError):
    """A listing went on after as many pages as it may have; nothing of it is used."""


def page_items(page: dict) -> tuple[list[dict], str | None]:
    """The items of a page and the cursor of the next: ``results`` and ``_links.next`` (or ``next``), which is empty on the last."""
    follow = (page.get("_links") or {}).get("next") or page.get("next")
    return list(page.get("results") or []), follow or None


def every_page(client: Client, what: str, most_pages: int) -> Iterator[tuple[int, dict]]:
    """Number of the page and item, page by page, to the end; a cursor that comes back, or too many pages, is an error."""
    cursor, seen = None, set()
    for number in range(most_pages):
        items, follow = page_items(client(what, cursor))
        yield from ((number, item) for item in items)
        if follow is None:
            return
        if follow in seen:
            raise TooManyPages(f"listing of {what!r} comes back to {follow!r}")
        seen.add(follow)
        cursor = follow
    raise TooManyPages(f"listing of {what!r} has more than {most_pages} pages")


def _text(item: dict) -> str:
    import json

    return json.dumps(item, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def register_listing(spark: SparkSession, name: str, client: Client) -> None:
    """Make ``spark.read.format(name)`` a listing by ``client``: status, page (number from 0) and item (a JSON text).

    Options: ``statuses`` (comma-separated, default current), each read by a task of its own in the order of its pages,
    and ``most_pages`` of one (default 1000), beyond which the job fails instead of giving a part. A task that is
    run again reads its listing anew, from the first page. The client runs in tasks and must be picklable.
    """

    class Status(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.statuses = [s.strip() for s in options.get("statuses", "current").split(",") if s.strip()]
            self.most_pages = int(options.get("most_pages", "1000"))

        def partitions(self) -> list[InputPartition]:
            return [Status(s) for s in self.statuses]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition is None:  # no status at all
                return
            for number, item in every_page(client, partition.value, self.most_pages):
                yield partition.value, number, _text(item)

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "status string, page int, item string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Listing)


def listed_pages(listing: DataFrame, head: int | None = None) -> DataFrame:
    """page_id, title, parent_id, status, version, space_id and labels of listed items; of a page listed twice, its highest version.

    ``head`` keeps the first so many by page id (as a number where it is one).
    """
    get = lambda path: F.get_json_object("item", path)
    labels = F.from_json(get("$.labels.results[*].name"), "array<string>")
    one = get("$.labels.results[0].name")
    rows = listing.select(
        get("$.id").alias("page_id"), get("$.title").alias("title"), get("$.parentId").alias("parent_id"), F.coalesce(get("$.status"), "status").alias("status"),
        F.coalesce(get("$.version.number").try_cast("long"), F.lit(0)).alias("version"), get("$.spaceId").alias("space_id"),
        F.coalesce(labels, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")).alias("labels"),
    ).where("page_id is not null")
    newest = rows.groupBy("page_id").agg(F.max_by(F.struct("title", "parent_id", "status", "version", "space_id", "labels"), F.struct("version", "status")).alias("r")).select("page_id", "r.*")
    return newest if head is None else newest.orderBy(F.expr("try_cast(page_id as bigint)").asc_nulls_last(), "page_id").limit(head)


def follow(requests: DataFrame, client: Client, request: str = "request", most_pages: int = 1000) -> DataFrame:
    """For each row of requests (text), its items in order: the row's columns, page, at (number of the item), item and error.

    A request that fails has one row with its error and no items, those that it had come to aside: a listing is whole or it
    isn't there. A request without items has one row of nulls. Requests are dealt like any rows; null ones have an error.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema.fields)}, page int, at int, item string, error string"
    place = requests.columns.index(request)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, what in enumerate(batch.column(place).to_pylist()):
                try:
                    if what is None:
                        raise ValueError("no request")
                    found = [(n, k, _text(item), None) for k, (n, item) in enumerate(every_page(client, what, most_pages))]
                except Exception as error:  # noqa: BLE001  what goes wrong with one request is that row's
                    found = [(None, None, None, f"{type(error).__name__}: {error}")]
                rows = list(zip(*(found or [(None, None, None, None)])))
                own = batch.take(pa.array([i] * len(rows[0])))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(x, t) for x, t in zip(rows, kinds)]], [*own.schema.names, "page", "at", "item", "error"])

    return requests.mapInArrow(run, schema)


def attachments(pages: DataFrame, client: Client, most_pages: int = 1000) -> DataFrame:
    """page_id, filename, version, size, media_type, ord and error of the attachments of pages (page_id), one listing each."""
    get = lambda path: F.get_json_object("item", path)
    found = follow(pages.select(F.col("page_id").cast("string").alias("page_id")), client, "page_id", most_pages).where("item is not null or error is not null")
    return found.select("page_id", get("$.title").alias("filename"), get("$.version.number").try_cast("int").alias("version"), get("$.fileSize").try_cast("long").alias("size"), get("$.mediaType").alias("media_type"), F.col("at").alias("ord"), "error")


def fetched(pages: DataFrame, client: Callable[[str], dict]) -> DataFrame:
    """page_id, item (a JSON text) and error of single pages, one call each."""
    found = follow(pages.select(F.col("page_id").cast("string").alias("page_id")), lambda what, cursor: {"results": [client(what)]}, "page_id", 1)
    return found.select("page_id", "item", "error")
