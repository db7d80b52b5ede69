"""The exact check of near-duplicates: Jaccard similarity of word shingles over a prefix join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, forget, map_rows, slices, stored
from .graph import connected_components, in_blocks, pairs, run_starts, whole_runs
from .words import NOT_BLANK, grams, words

#: Which pairs of prints (rows of segments) may belong to similar sets, and by how many bits they differ.
Near = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Bits of a shingle's place in the table of frequencies, and places that travel in one row.
PLACES, CHUNK = 20, 1 << 14
#: From so many occurrences on, a shingle's sets are dealt out to several tasks.
HOT = 1 << 16
#: Of a key of so many sets or fewer, only those that may have a similar one there go on.
FEW = 64
#: So many shingles are in a block of sets, two of which are compared by a task.
BLOCK = 1 << 19


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, ascending; a text of fewer words than a shingle is one."""
    w = words(column, NOT_BLANK, lower=True)
    hashes = w.hashes()
    whole = grams(hashes, shingle)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield np.unique(whole[a : b - shingle + 1] if b - a >= shingle else grams(hashes[a:b], b - a) if b > a else whole[:0])


def _set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def _signed(ids: list[int]) -> pa.Array:
    return pa.array(np.array(ids, dtype=np.uint64).view(np.int64))


def _parts(batch: pa.RecordBatch, text: str, shingle: int) -> Iterator[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(text))
    for a, b in slices(batch, text):
        yield from _sets(column.slice(a, b - a), shingle)


def with_set_id(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Append _set: a hash of each text's set of shingles."""

    def make():
        return lambda batch: {"_set": _signed([_set_id(x) for x in _parts(batch, text, shingle)])}

    return map_rows(docs, [T.StructField("_set", T.LongType())], make)


def set_ids(docs: DataFrame, doc_id: str, text: str, shingle: int, print_of: Callable[[np.ndarray], bytes]) -> DataFrame:
    """_id, _set and print of every row; the texts don't come back from the tasks' workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = [], []
            for x in _parts(batch, text, shingle):
                ids.append(_set_id(x))
                prints.append(print_of(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(ids), pa.array(prints, pa.binary())], ["_id", "_set", "print"])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField("_id", docs.schema[doc_id].dataType), T.StructField("_set", T.LongType()), T.StructField("print", T.BinaryType())])
    return docs.select(doc_id, text).mapInArrow(run, schema)


def _frequencies(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """About how often shingles occur, by the first ``PLACES`` bits of their hashes (shingles share places)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACES, dtype=np.int64)
        for batch in batches:
            for x in _parts(batch, text, shingle):
                np.add.at(total, x >> np.uint64(64 - PLACES), 1)
        chunks = [c.tobytes() for c in total.reshape(-1, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype=np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, counts binary"
    rows = docs.select(text).mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect()
    out = np.zeros((1 << PLACES) // CHUNK * CHUNK, dtype=np.int64).reshape(-1, CHUNK)
    for r in rows:
        out[r["part"]] = np.frombuffer(r.counts, dtype=np.int64)
    return out.reshape(-1)


def _least_overlap(a, b, least: float):
    """How many shingles sets of a and b elements share at least, at a similarity of ``least``."""
    return np.ceil(least / (1 + least) * (a + b) - 1e-9)


def _prefixes(docs: DataFrame, text: str, shingle: int, least: float) -> DataFrame:
    """Rows (key, id, size, salt): each set's rarest shingles, so many that similar sets have one of them in common.

    size holds the key's place above 32 bits. salt is 0; where a shingle's place in the table of frequencies has more
    than ``HOT`` occurrences (and 64 times as many as most), it deals the key's sets out to parts of about so many, from 1 on.
    """
    counts = _frequencies(docs, text, shingle)
    common, hot = docs.sparkSession.sparkContext.broadcast(counts), max(HOT, int(64 * counts.mean()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task deals each set once, so copies cost nothing more
        for batch in batches:
            key, ids, size, salt = [np.zeros(0, dtype=np.uint64)], [], [], [np.zeros(0, dtype=np.int32)]
            for x in _parts(batch, text, shingle):
                n = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1 if len(x) else 0
                own = _set_id(x)
                if own in seen:
                    continue
                seen.add(own)
                # Any order of all shingles will do; by frequency, prefixes of unlike sets seldom meet.
                often = common.value[x >> np.uint64(64 - PLACES)]
                first = np.argsort(often, kind="stable")[:n]
                key.append(x[first])
                parts = often[first] // hot + 1
                salt.append(np.where(parts > 1, 1 + (own >> 7) % parts, 0).astype(np.int32))
                ids.append(np.full(n, own, dtype=np.uint64))
                size.append(np.arange(n, dtype=np.int64) << 32 | len(x))
            columns = [np.concatenate(key).view(np.int64), np.concatenate([key[0], *ids]).view(np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *size]), np.concatenate(salt)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "size", "salt"])

    return docs.select(text).mapInArrow(deal, "key long, id long, size long, salt int")


def _met(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, id, size) of keys that more than one set has; those of salted keys all stay.

    A task holds a batch at a time, and of the one before its last row, so no key's rows need to fit in memory.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False  # the last row so far, not given yet, and whether the one before it has its key
        for batch in batches:
            table = pa.Table.from_batches([*([last] if last is not None else []), batch])
            if not table.num_rows:
                continue
            key, ids, salt = (table.column(c).to_numpy() for c in ("key", "id", "salt"))
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            new = np.append(True, ~(same & (ids[1:] == ids[:-1])))
            table, key, salt = table.filter(pa.array(new)), key[new], salt[new]
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            good = np.append(met, same) | np.append(same, False) | (salt > 0)
            yield from table.slice(0, len(key) - 1).filter(pa.array(good[:-1])).select(["key", "id", "size"]).to_batches()
            last, met = table.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(good[-1])
        if last is not None and met:
            yield last.select(["key", "id", "size"])

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(pick, "key long, id long, size long")


def _tried(table: pa.Table, least: float, near: Near | None, small: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two arrays of rows: which pairs may be similar sets that meet first at the rows' key.

    Such sets are near in size and in print, and have enough left after the key, for no shingle before it in either is
    common. Where the keys just before it (``before``, ``further``) are common, the pair has met there.
    """
    packed = table.column("size").to_numpy()
    size, place = packed & 0xFFFFFFFF, packed >> 32
    earlier = [(table.column(c).fill_null(0).to_numpy(), table.column(c).is_valid().to_numpy()) for c in ("before", "further")]
    segments = np.frombuffer(b"".join(table.column("print").to_pylist()), dtype=np.uint16).reshape(len(size), -1) if near else None

    def tried(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        good = (low >= np.ceil(least * high - 1e-9)) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= _least_overlap(low, high, least))
        for x, has_x in earlier:
            for y, has_y in earlier:
                good &= (x[i] != y[j]) | ~has_x[i] | ~has_y[j]
        at = np.flatnonzero(good)
        return at if near is None else at[near(segments[i[at]], segments[j[at]])[0] | (low[at] < small)]

    return tried


def _meeting(rows: DataFrame, least: float, near: Near | None, small: int) -> DataFrame:
    """The rows (key, id, size, print, before, further) that may have a similar set at a key where they meet first.

    All pairs of a key of up to ``FEW`` sets are tried; the rows of a larger one all stay. A task holds some
    thousand rows at a time, whatever a key has.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for table in whole_runs(batches, ["key"], most=FEW):
            starts, key = run_starts(table, ["key"]), table.column("key").to_numpy()
            count = np.diff(np.append(starts, len(key)))
            good = np.repeat(count > FEW, count) | (key == last)
            last, tried = key[-1], _tried(table, least, near, small)
            for i, j in pairs(starts, len(key)):
                some = np.flatnonzero(~good[i] | ~good[j])
                if not len(some):
                    break
                at = some[tried(i[some], j[some])]
                good[i[at]] = good[j[at]] = True
            yield from table.filter(pa.array(good)).to_batches()

    by_id = Window.partitionBy("id").orderBy(F.shiftright("size", 32))
    known = rows.withColumns({"before": F.lag("key").over(by_id), "further": F.lag("key", 2).over(by_id)})
    known = known.select("key", "id", "size", "print", "before", "further")
    return known.repartition("key").sortWithinPartitions("key").mapInArrow(keep, known.schema)


def _candidates(rows: DataFrame, least: float, near: Near | None, small: int, block: int) -> DataFrame:
    """Rows (key, lo, hi, part, id): the sets to compare in each group of a key's blocks, those that may have a similar one there.

    A key's sets are dealt out to blocks of about ``block`` shingles, and any two blocks are a group. A row comes from
    each group a set is in, not from each pair, so groups of sets that are alike make no more rows for having more pairs.
    """
    group = ["key", "lo", "hi"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, group):
            part, lo, hi = (table.column(c).to_numpy() for c in ("part", "lo", "hi"))
            good, tried = np.zeros(len(part), dtype=bool), _tried(table, least, near, small)
            for i, j in pairs(run_starts(table, group), len(part)):
                new = np.flatnonzero(((part[i] != part[j]) | (lo[i] == hi[i])) & ~(good[i] & good[j]))
                at = new[tried(i[new], j[new])]
                good[i[at]] = good[j[at]] = True
            yield from table.select([*group, "part", "id"]).filter(pa.array(good)).to_batches()

    dealt = in_blocks(rows, "key", "id", block, F.col("size").bitwiseAND(0xFFFFFFFF)).withColumns({"lo": F.col("pair.lo"), "hi": F.col("pair.hi")}).drop("pair")
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet, "key long, lo int, hi int, part int, id long")


def _forest(sets: list[np.ndarray], part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the sets of a group whose similarity is ``least`` or more; sets of one block meet in the group of that block alone.

    A set is compared with all later ones at once that nothing connects to it yet.
    """
    size = np.array([len(x) for x in sets])
    start, root = np.cumsum(size) - size, np.arange(len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own, one = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool), bool((part == part[0]).all())
    for i in range(len(sets) - 1):
        low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        fit = (root[i + 1 :] != root[i]) & (low > 0) & (low >= np.ceil(least * high - 1e-9)) & (one | (part[i + 1 :] != part[i]))
        j = i + 1 + np.flatnonzero(fit)
        if not len(j):
            continue
        mine = codes[start[i] : start[i] + size[i]]
        own[mine] = True
        first = np.cumsum(size[j]) - size[j]
        common = np.add.reduceat(own[codes[np.repeat(start[j] - first, size[j]) + np.arange(int(size[j].sum()))]], first, dtype=np.int64)
        own[mine] = False
        alike = j[common >= _least_overlap(size[i], size[j], least)]
        if len(alike):
            joined = np.unique(root[np.append(alike, i)])
            root[np.isin(root, joined)] = joined[0]
    tied = np.flatnonzero(root != np.arange(len(sets)))
    return tied, root[tied]


def _similar(found: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, sets: DataFrame, least: float, most: int = 2_000_000) -> DataFrame:
    """Links (a, b) that connect the sets of each group in ``found`` whose Jaccard similarity is ``least`` or more.

    One row's text stands for each set. It goes once to each group that the set is in, as a text: these are smaller
    than their sets of hashes. Up to ``most`` wanted sets, rows are picked before anything moves. A task holds one group.
    """
    ends = found.select(F.col("id").alias("_set")).distinct()
    wanted = stored(sets.join(ends, "_set").groupBy("_set").agg(F.min(F.struct(F.col("_id").isNull(), "_id")).alias("f")).select(F.col("_set").alias("set"), F.col("f._id").alias("_wanted")), "jaccard-wanted")
    count = wanted.count()
    chosen = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("text"))
    picked = chosen.join(F.broadcast(wanted) if count <= most else wanted, chosen["_own"].eqNullSafe(F.col("_wanted"))).select("set", "text")
    goes = found.select(F.col("id").alias("set"), F.struct("key", "lo", "hi", "part").alias("go"))
    goes = goes.groupBy("set", F.pmod(F.xxhash64("go"), F.lit(64)).alias("_salt")).agg(F.collect_list("go").alias("gos"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, own, part = None, [], [], []

        def links() -> pa.RecordBatch:
            tied, root = _forest(own, np.array(part), least) if len(own) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()) for at in (tied, root)], ["a", "b"])

        for batch in batches:
            key, lo, hi, block, known = (batch.column(k).to_pylist() for k in range(5))
            for k, x in enumerate(_parts(batch, "text", shingle)):
                # Rows of one id may have other texts: the set that is asked for tells which is meant.
                if _signed([_set_id(x)])[0].as_py() != known[k]:
                    continue
                if (key[k], lo[k], hi[k]) != group:
                    yield links()
                    group, ids, own, part = (key[k], lo[k], hi[k]), [], [], []
                if not ids or ids[-1] != known[k]:
                    ids.append(known[k])
                    own.append(x)
                    part.append(block[k])
        yield links()

    moved = picked.join(goes, "set").select("set", "text", F.explode("gos").alias("go")).select("go.key", "go.lo", "go.hi", "go.part", "set", "text")
    dealt = moved.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "set")
    return dealt.mapInArrow(test, "a long, b long").distinct()


def components(docs: DataFrame, doc_id: str, text: str, shingle: int, least: float, sets: DataFrame, near: Near | None, small: int) -> DataFrame:
    """Rows (node, component) of the sets (ids of ``_set``) that links of ``least`` or more connect to others.

    ``sets`` are of ``set_ids``. Of two sets of such a similarity, each has one of their common shingles among its first
    ``size - ceil(least * size) + 1`` in any order that all sets follow: they meet at that key, and no pair is missed.
    Rows are dropped if no set of their key may be similar, by size, place and print (``near``; None prunes nothing) unless a
    set has fewer than ``small`` shingles. What is left is compared on the sets themselves, by groups of bounded size, each of
    which gives the links that connect its sets, never its pairs. Time still grows with the pairs of those that are
    alike but not similar; rows don't. What a step stored is deleted as soon as the next one has its own.
    """
    met = stored(_met(_prefixes(docs, text, shingle, least)), "jaccard-keys")
    forget(docs.sparkSession)
    prints = sets.groupBy(F.col("_set").alias("id")).agg(F.first("print").alias("print"))
    rows = stored(_meeting(met.join(prints, "id"), least, near, small), "jaccard-rows")
    discard(met)
    forget(docs.sparkSession)
    found = stored(_candidates(rows, least, near, small, BLOCK), "jaccard-groups")
    discard(rows)
    forget(docs.sparkSession)
    links = stored(_similar(found, docs, doc_id, text, shingle, sets, least), "jaccard-links")
    discard(found)
    forget(docs.sparkSession)
    linked = stored(connected_components(links), "jaccard-components")
    discard(links)
    forget(docs.sparkSession)
    return linked
