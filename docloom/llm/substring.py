"""Substring dedup by seed and extend: winnowed anchors, joined, extended both ways to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, slices, stored, without
from .words import NOT_BLANK, grams, joined, lists, runs, spans_hash, strings, words

_ROW = ("_id", "_hash")


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least of each ``width`` consecutive values."""
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        have += step
    return best


def _anchors(column: pa.Array, length: int, gram: int) -> dict[str, np.ndarray]:
    w = words(column, NOT_BLANK)
    n = len(w.start) - length + 1
    if n <= 0:
        return {}
    hashes = w.hashes()
    seeds = grams(hashes, gram)
    anchor = least_of(seeds, length - gram + 1)[:n]
    valid = np.flatnonzero(w.row[:n] == w.row[length - 1 :])
    if not len(valid):
        return {}
    chosen = anchor[valid]
    new = np.append(True, chosen[1:] != chosen[:-1])
    low = valid[new]
    count = np.diff(np.append(np.flatnonzero(new), len(valid)))
    return {
        "anchor": seeds[chosen[new]].view(np.int64),
        "extent": spans_hash(hashes, low, low + count - 1 + length).view(np.int64),
        "row": w.row[low],
        "start": (low - w.first[w.row[low]]).astype(np.int32),
        "n": count.astype(np.int32),
    }


def anchors(keyed: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """A row for each winnowed anchor: its hash, that of its whole extent, the document's key, first window, windows.

    Of the grams of each window the first with the least hash is the window's anchor: equal windows have equal
    anchors, wherever they stand. The extent is all words of the consecutive windows that share the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(batch, text):
                if found := _anchors(column.slice(a, b - a), length, gram):
                    row = pa.array(found["row"] + a)
                    keys = [batch.column(batch.schema.get_field_index(k)).take(row) for k in _ROW]
                    yield pa.RecordBatch.from_arrays([pa.array(found[k]) for k in ("anchor", "extent")] + keys + [pa.array(found[k]) for k in ("start", "n")], ["anchor", "extent", *_ROW, "start", "n"])

    return keyed.select(*_ROW, text).mapInArrow(run, "anchor long, extent long, _id long, _hash long, start int, n int")


def _expand(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each list item and the items (null lists have none)."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _windows(edges: DataFrame, text: str, length: int) -> DataFrame:
    """Each window of the extents that are to be compared window by window: hash, document's key, start, open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            spans = batch.column(batch.schema.get_field_index("spans"))
            for a, b in slices(batch, text):
                w = words(column.slice(a, b - a), NOT_BLANK)
                row, items = _expand(spans.slice(a, b - a))
                if not len(row):
                    continue
                start, n, single = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                hashes = grams(w.hashes(), length)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at, row = np.repeat(start, n) + step, np.repeat(row, n)
                keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row + a)) for k in _ROW]
                window = hashes[w.first[row] + at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(window), *keys, pa.array(at.astype(np.int32)), pa.array(np.repeat(single.astype(bool), n))], ["window", *_ROW, "start", "open"])

    return edges.select(*_ROW, text, "spans").mapInArrow(run, "window long, _id long, _hash long, start int, open boolean")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    # Ids of any kind; rows of one id and text are one document here, whose copies have the same spans.
    return docs.withColumns({"_id": F.xxhash64(F.col(doc_id).cast("string")), "_hash": F.xxhash64(text)})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """Runs of windows of ``length`` words that also start elsewhere: _id, _hash (the document's key), start, n.

    Seeds: anchors that stand at one place only are dropped by a join with the repeated ones (pre-aggregated, so a
    hot passage is one row; the join's hot keys are split). Extension: an anchor's whole extent both ways, compared
    by hash, settles all its windows at once; where extents of one anchor differ, at a repeat's edge, one
    representative of each extent is compared window by window. No pairs of occurrences are formed.
    """
    gram = max(1, length // 4)
    keyed = _keyed(docs, doc_id, text).select(*_ROW, text)
    found = anchors(keyed, text, length, gram)
    twice = stored(anchors(keyed, text, length, gram).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    seeds = stored(found.join(twice, "anchor"), "seeds")
    extents = stored(seeds.groupBy("anchor", "extent").agg(F.count("*").alias("m"), F.min(F.struct(*_ROW, "start", "n")).alias("one")), "extents")
    whole = seeds.join(extents.where("m > 1").select("anchor", "extent"), ["anchor", "extent"]).select(*_ROW, "start", "n")
    mixed = stored(extents.groupBy("anchor").agg(F.count("*").alias("k"), F.max(F.col("m") == 1).alias("open")).where("k > 1 and open").select("anchor"), "mixed")
    edges = extents.join(mixed, "anchor").select("one.*", (F.col("m") == 1).alias("open"))
    edges = edges.groupBy(*_ROW).agg(F.collect_set(F.struct("start", "n", "open")).alias("spans"))
    windows = stored(_windows(keyed.join(edges, [*_ROW]), text, length), "windows")
    again = stored(windows.groupBy("window").agg(F.count("*").alias("c"), F.max("open").alias("open")).where("c > 1 and open").select("window"), "again")
    single = windows.where("open").join(again, "window").select(*_ROW, "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """Append n_words, n_removed, removed (maximal repeats, as array of first and last word) and kept_text.

    Words are runs of anything but blanks, unchanged. A word is removed if it lies in a window of ``length`` words
    whose sequence also starts anywhere else in the whole input, the same document included; windows are judged on
    the input. kept_text has the other words, one space between. Null texts have no words (kept_text is empty), a
    text of fewer than ``length`` words loses none; repeated rows repeat each other; null ids are as good as others, and ids may be of any kind.
    Columns of the results' names are replaced.
    """
    docs = without(docs, "_id", "_hash", "spans")
    found = repeats(docs, doc_id, text, length).groupBy(*_ROW).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    fields = T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept_text string").fields

    def make():
        def part(column: pa.Array, spans: pa.Array) -> list[pa.Array]:
            w = words(column, NOT_BLANK)
            row, items = _expand(spans)
            cover = np.zeros(len(w.start) + 1, dtype=np.int64)
            if len(row):
                start, n = (items.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                np.add.at(cover, w.first[row] + start, 1)
                np.add.at(cover, w.first[row] + start + n + length - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            first, last = runs(gone, w.row)
            base = w.first[w.row[first]]
            maximal = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (first, last)], ["first", "last"])
            data, _, _, offsets = joined(w, ~gone)
            total = np.bincount(w.row[gone], minlength=len(column))
            return [pa.array(np.diff(w.first)), pa.array(total.astype(np.int64)), lists(maximal, w.row[first], len(column)), strings(data, offsets)]

        def work(batch: pa.RecordBatch) -> dict:
            column, spans = (batch.column(batch.schema.get_field_index(c)) for c in (text, "spans"))
            parts = [part(column.slice(a, b - a), spans.slice(a, b - a)) for a, b in slices(batch, text)]
            return {f.name: pa.concat_arrays([p[k] for p in parts]) for k, f in enumerate(fields)}

        return work

    keyed = _keyed(docs, doc_id, text).join(found, [*_ROW], "left")
    return map_rows(keyed, fields, make).drop("_id", "_hash", "spans")
