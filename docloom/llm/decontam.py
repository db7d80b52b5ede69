"""Benchmark decontamination: an FM-index of each training shard, searched for the benchmark's windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, slices, without
from .words import ALNUM, Words, cut_out, lists, runs, text_bytes, words


class WaveletMatrix:
    """Ranks of any symbol in a sequence, by one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + before, at - before)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Backward search and location in runs of symbols (1 and up), which 0s end.

    Suffixes are compared up to the end of their run only, so sorting takes as many doublings as the longest run
    has bits. Positions are sampled at each ``sample``-th symbol of a run, from its first on.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            rank[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            if n < 2 or rank[order[-1]] == n - 1:
                break
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            rank, width = key, 2 * width
            order = np.argsort(rank)
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, symbols)
        self.less = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        self.n = n
        begin = np.append(0, ends[:-1] + 1)
        offset = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        marked = (offset % sample == 0)[order]
        self.marks = np.append(0, np.cumsum(marked))
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (a row of ``patterns``, ``length`` symbols)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((step < length) & (low < high))
            symbol = patterns[on, length[on] - 1 - step]
            low[on] = self.less[symbol] + self.wavelet.rank(symbol, low[on])
            high[on] = self.less[symbol] + self.wavelet.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left := left[self.marks[rows[left] + 1] == self.marks[rows[left]]]):
            symbol, before = self.wavelet.access(rows[left])
            rows[left] = self.less[symbol] + before
            steps[left] += 1
        return self.sampled[self.marks[rows]] + steps


@dataclass
class Phrases:
    """The benchmark's distinct windows: word hashes to symbols, windows as symbols, and the items of each."""

    vocabulary: np.ndarray
    filter: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    window: np.ndarray
    item: np.ndarray
    ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]], width: int) -> Phrases:
        ids = sorted({i for i, _ in items})
        w = words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        hashes = w.hashes()
        vocabulary, symbol = np.unique(hashes, return_inverse=True)
        position = {x: k for k, x in enumerate(ids)}
        seen: dict[tuple[int, ...], int] = {}
        links = set()
        for k, (i, _) in enumerate(items):
            own = (symbol[w.first[k] : w.first[k + 1]] + 1).tolist()
            for s in range(max(1, len(own) - width + 1) if own else 0):
                links.add((seen.setdefault(tuple(own[s : s + width]), len(seen)), position[i]))
        windows = np.zeros((len(seen), width), dtype=np.int64)
        length = np.zeros(len(seen), dtype=np.int64)
        for x, k in seen.items():
            windows[k, : len(x)], length[k] = x, len(x)
        both = np.array(sorted(links), dtype=np.int64).reshape(-1, 2)
        rough = np.zeros(1 << 20, dtype=bool)
        rough[vocabulary >> np.uint64(44)] = True
        return cls(vocabulary, rough, windows, length, both[:, 0], both[:, 1], ids)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's symbol; 0 for a word that no window has."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _search(column: pa.Array, phrases: Phrases):
    """The words of a shard, which of them are hit, and (row, item) of each item found in a row."""
    w = words(column, ALNUM, lower=True)
    hit, none = np.zeros(len(w.start), dtype=bool), np.zeros(0, dtype=np.int64)
    if not len(phrases.length) or not len(hit):
        return w, hit, none, none
    symbol = phrases.symbols(w.hashes())
    # Runs of words that windows have; shorter runs than the shortest window hold none and aren't indexed.
    first, last = runs(symbol > 0, w.row)
    long = last - first + 1 >= phrases.length.min()
    first, size = first[long], (last - first + 1)[long]
    if not len(first):
        return w, hit, none, none
    at = np.cumsum(size + 1) - size - 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text = np.zeros(int((size + 1).sum()), dtype=np.int64)
    word = np.zeros(len(text), dtype=np.int64)
    word[np.repeat(at, size) + step] = np.repeat(first, size) + step
    text[np.repeat(at, size) + step] = symbol[np.repeat(first, size) + step]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.windows, phrases.length)
    count = high - low
    found = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    start = word[index.locate(rows)]
    cover = np.zeros(len(hit) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + phrases.length[found], -1)
    hit = np.cumsum(cover[:-1]) > 0
    # Windows found in each row, then the items that have these windows.
    key = np.unique(w.row[start] * len(count) + found)
    row, found = key // len(count), key % len(count)
    low, high = np.searchsorted(phrases.window, found), np.searchsorted(phrases.window, found, "right")
    count = high - low
    items = phrases.item[np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    key = np.unique(np.repeat(row, count) * len(phrases.ids) + items)
    return w, hit, key // len(phrases.ids), key % len(phrases.ids)


def _stage(docs: DataFrame, text: str, phrases: Phrases, remove: bool, shard: int) -> DataFrame:
    kinds = "n_words long, items array<string>, spans array<struct<start:int,end:int>>" + ", _cut string" * remove
    fields = T.StructType.fromDDL(kinds).fields

    def make():
        ids = pa.array(phrases.ids, pa.string())

        def part(column: pa.Array) -> list[pa.Array]:
            w, hit, row, item = _search(column, phrases)
            first, last = runs(hit, w.row)
            base = w.first[w.row[first]]
            spans = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (first, last + 1)], ["start", "end"])
            out = [pa.array(np.diff(w.first)), lists(ids.take(pa.array(item)), row, len(column)), lists(spans, w.row[first], len(column))]
            if remove:
                out.append(_left(column, w, w.start[first], w.end[last]))
            return out

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [part(column.slice(a, b - a)) for a, b in slices(batch, text, shard)]
            return {f.name: pa.concat_arrays([p[k] for p in parts]) for k, f in enumerate(fields)}

        return work

    return map_rows(docs, fields, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, remove: bool = False, shard: int = 4 << 20, block: int = 8 << 20) -> DataFrame:
    """Append n_words, n_hit, items (ids of items with occurring windows) and spans (merged runs of hit words).

    Words are runs of letters, digits and non-ASCII, with A-Z lower-cased. A window is ``width`` consecutive words of
    an item, or all words of a shorter one. Each shard (``shard`` bytes of a task's texts, whole documents) gets an
    FM-index; every window is searched in it backwards, and occurrences are located and merged. With ``remove``,
    texts lose the bytes from the first to the last word of each merged span.

    The windows travel with the tasks, at most ``block`` bytes of item text at a time; a larger benchmark is searched
    in as many blocks, each one more pass over the rows, without a shuffle. Every block searches the whole texts; with
    ``remove`` on several blocks, one more pass cuts the merged spans. Null texts have no words and stay null, null
    items have no windows, a null item id reads as the empty string, an id's items count once. Columns of the
    results' names are replaced.
    """
    columns = without(docs, "n_words", "n_hit", "items", "spans", "_items", "_spans", "_cut", "_n").columns
    docs = docs.select(columns)
    queries = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    size = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    once = remove and blocks == 1
    out = docs.withColumns({"_items": F.array().cast("array<string>"), "_spans": F.array().cast("array<struct<start:int,end:int>>"), "_n": F.lit(None).cast("long")})
    for k in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()
        out = _stage(out, text, Phrases.of([(r.i, r.t) for r in rows], width), once, shard)
        own = {"_items": F.array_union("_items", "items"), "_n": F.coalesce("_n", "n_words")}
        own["_spans"] = F.col("spans") if blocks == 1 else F.concat("_spans", "spans")
        out = out.withColumns(own)
    if blocks > 1:
        out = out.withColumn("_spans", _merged("_spans"))
        out = _cut_spans(out, text) if remove else out
    if remove:
        out = out.withColumn(text, F.col("_cut"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(*columns, F.col("_n").alias("n_words"), hit.alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def _left(column: pa.Array, w: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without the bytes from each start to each end; a null text stays null."""
    left = cut_out(text_bytes(column)[0], w.row_start, start, end)
    return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), left) if column.null_count else left


def _cut_spans(docs: DataFrame, text: str) -> DataFrame:
    """Append _cut: each text without its word spans (column _spans)."""

    def make():
        def part(column: pa.Array, spans: pa.Array) -> pa.Array:
            w = words(column, ALNUM, lower=True)
            base = np.repeat(w.first[:-1], pc.list_value_length(spans).to_numpy(zero_copy_only=False))
            first, after = (pc.struct_field(spans.flatten(), n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
            return _left(column, w, w.start[base + first], w.end[base + after - 1])

        def work(batch: pa.RecordBatch) -> dict:
            column, spans = (batch.column(batch.schema.get_field_index(c)) for c in (text, "_spans"))
            return {"_cut": pa.concat_arrays([part(column.slice(a, b - a), spans.slice(a, b - a)) for a, b in slices(batch, text)])}

        return work

    return map_rows(docs, [T.StructField("_cut", T.StringType())], make)


def _merged(spans: str):
    """Union of an array of spans: sorted, with overlapping and touching ones merged."""
    kind = "array<struct<start:int,end:int>>"

    def add(have, x):
        last = F.try_element_at(have, F.lit(-1))
        joins = (F.size(have) > 0) & (x["start"] <= last["end"])
        longer = F.concat(F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(have, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)
