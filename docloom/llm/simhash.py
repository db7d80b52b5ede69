"""SimHash near-duplicates: 64-bit fingerprints, joined by segments and pruned by pigeonring chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import map_rows, slices, stored, without
from .graph import connected_components, in_blocks, local_roots, pairs, run_starts, whole_runs
from .words import NOT_BLANK, joined, mix, words

#: Lowest bit and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    w = words(column, NOT_BLANK, lower=True)
    text, start, end, _ = joined(w)
    count = np.diff(w.first)
    # A row has a shingle at each word but its last shingle - 1, and one of all its words if these are fewer.
    number = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    first = np.cumsum(number) - number
    at = np.repeat(w.first[:-1] - first, number) + np.arange(int(number.sum()))
    until = np.minimum(at + shingle, np.repeat(w.first[1:], number)) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), end[until].tolist())], dtype=np.uint64)
    out = np.zeros(len(column), dtype=np.uint64)
    some = np.flatnonzero(number)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > number[some, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """Append each whole text's 64-bit SimHash over word shingles, as a long (its bits are the unsigned value's).

    Words are runs of anything but blanks, with A-Z lower-cased; a shingle's hash is XXH64, seed 42, of its words
    joined by spaces; repeated shingles count each time. A bit is set if it is set in over half of the hashes. A
    text of fewer words than a shingle is one shingle; null, empty and blank texts get fingerprint 0.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [_fingerprints(column.slice(a, b - a), shingle) for a, b in slices(batch, text)]
            return {out: pa.array(np.concatenate(parts).view(np.int64))}

        return work

    return map_rows(docs, [T.StructField(out, T.LongType())], make)


def _chains(x: np.ndarray, y: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """Whether, from the shared segment on, the differences along the ring stay within proportional budgets."""
    diff = x ^ y
    each = np.stack([np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS])
    total, good, m = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool), len(SEGMENTS)
    for step in range(m):
        total += each[(segment + step) % m, np.arange(len(x))]
        good &= total * m <= most * (step + 1)
    return good


def fingerprint_links(prints: DataFrame, most: int = 2, block: int = 1024) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fingerprint) at ``most`` or fewer differing bits.

    Two such fingerprints agree in a segment from which, along the ring of three, the differences stay within
    ``most / 3`` for each segment passed (``most`` is below 3, so the first segment is equal: that is the join). A
    bucket of a segment's value is compared in blocks; a block yields links to the smallest fingerprint that it
    connects to, never its pairs, so the output is linear even where thousands of fingerprints are alike.
    """
    if not 0 <= most < len(SEGMENTS):
        raise ValueError("most must be 0, 1 or 2")
    keys = F.array(*[F.lit(i).cast("long") * F.lit(1 << 32) + F.shiftrightunsigned("fingerprint", low).bitwiseAND((1 << width) - 1) for i, (low, width) in enumerate(SEGMENTS)])
    rows = prints.select("fingerprint", F.explode(keys).alias("key"))
    dealt = in_blocks(rows, "key", "fingerprint", block).select("key", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "part", "fingerprint")
    columns = ["key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, columns):
            starts = run_starts(table, columns)
            x = table.column("fingerprint").to_numpy().view(np.uint64)
            part, lo, hi = (table.column(c).to_numpy() for c in ("part", "lo", "hi"))
            segment = table.column("key").to_numpy() >> 32
            found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, j in pairs(starts, len(x)):
                new = (part[i] != part[j]) | (lo[i] == hi[i])
                i, j = i[new], j[new]
                good = _chains(x[i], x[j], segment[i], most)
                i, j = i[good], j[good]
                near = np.bitwise_count(x[i] ^ x[j]) <= most
                found_i.append(i[near])
                found_j.append(j[near])
            root = local_roots(len(x), np.concatenate(found_i), np.concatenate(found_j))
            tied = np.flatnonzero(root != np.arange(len(x)))
            signed = x.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[tied]), pa.array(signed[root[tied]])], ["a", "b"])

    sorted_rows = dealt.repartition(*columns).sortWithinPartitions(*columns)
    return sorted_rows.mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame, doc_id: str = "doc_id", most: int = 2) -> DataFrame:
    """One row per distinct fingerprint: fingerprint, root (the smallest reachable one), component_id (smallest id)."""
    classes = stored(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("least")), "simhash-classes")
    links = connected_components(fingerprint_links(classes, most))
    rooted = classes.join(links, classes.fingerprint == links.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2, keep_columns: bool = True) -> DataFrame:
    """Append fingerprint (long), component_id and root to every document.

    Documents link if their fingerprints differ in ``most`` or fewer bits; a component is what links reach. Equal
    fingerprints are one class, so copies are never paired; a row joins its class by fingerprint, a join whose hot
    keys the adaptive skew join splits. ``keep_columns=False`` keeps the id only and computes fingerprints once.
    Null ids are grouped like others, but only an all-null component has a null component_id; repeated rows each
    stay a row. An empty table gives an empty result; columns of the results' names are replaced.
    """
    docs = without(docs, "fingerprint", "component_id", "root")
    small = stored(fingerprints(docs.select(doc_id, text), text, shingle).select(doc_id, "fingerprint"), "simhash-prints")
    found = stored(groups(small, doc_id, most), "simhash-groups")
    return (fingerprints(docs, text, shingle) if keep_columns else small).join(found, "fingerprint")


#: Bits of the prints that stand for shingle sets, and how many of them two sets of a similarity of 0.8 differ in at
#: most: 19.4 on average, and more than 42 in about one of 10**8 such pairs.
WIDE, WIDE_MOST = 128, 42
#: Sets of fewer shingles are never pruned: their prints vary too much.
SMALL = 64
_SALTS = np.array([0, 0xD1B54A32D192ED03], dtype=np.uint64)


def wide_print(shingles: np.ndarray) -> bytes:
    """The SimHash of 128 bits of a set of 64-bit shingle hashes."""
    own = mix(shingles[:, None] ^ _SALTS)
    bits = np.unpackbits(own.view(np.uint8).reshape(len(own), WIDE // 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(0, dtype=np.int32) > len(own), bitorder="little").tobytes()


def near_prints(x: np.ndarray, y: np.ndarray, most: int = WIDE_MOST, chain: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of wide prints (rows of 16-bit segments) differ in ``most`` bits at most, and in how many.

    Pairs need a chain of segments along the ring whose differences, summed from its start, stay within
    ``most / segments`` for each segment passed; only these get the full Hamming check.
    """
    each = np.bitwise_count(x ^ y).astype(np.int32)
    m = each.shape[1]
    some = np.zeros(len(each), dtype=bool)
    for start in range(m):
        total, good = np.zeros(len(each), dtype=np.int32), np.ones(len(each), dtype=bool)
        for step in range(chain):
            total = total + each[:, (start + step) % m]
            good &= total * m <= most * (step + 1)
        some |= good
    total = np.full(len(each), 8 * WIDE, dtype=np.int32)
    total[some] = each[some].sum(1)
    return total <= most, total


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, exact: bool = False) -> DataFrame:
    """Keep one document of each component of near-duplicates: that with the smallest id (one of repeated rows).

    Documents link if their sets of word shingles are equal or have a Jaccard similarity of ``least`` (0.8 or more)
    or more; see ``jaccard.components``. Prints lose about one of 10**8 pairs at 0.8; ``exact`` asks no print and loses
    none. Words are as in ``near_duplicates``; a text of fewer words than a shingle
    is one shingle; null, empty and blank texts are equal. The choice is made on a table of ids and set ids. Texts
    are then filtered by the ids that go: without a shuffle of texts while these are few enough to be broadcast.
    Rows of repeated or null ids are chosen by id and set. An empty table stays empty.
    """
    if least < 0.8:
        raise ValueError("prints are made for a similarity of 0.8 or more")
    columns = docs.columns
    docs = without(docs, "_set", "_root", "_least", "_n")
    sets = stored(jaccard.set_ids(docs, doc_id, text, shingle, wide_print), "simhash-sets")
    small = sets.select("_id", "_set")
    classes = small.groupBy("_set").agg(F.min("_id").alias("_least"))
    linked = jaccard.components(docs, doc_id, text, shingle, least, sets, None if exact else near_prints, SMALL)
    rooted = classes.join(linked, classes["_set"] == linked.node, "left").select("_set", "_least", F.coalesce("component", "_set").alias("_root"))
    keeps = rooted.groupBy("_root").agg(F.min_by("_set", F.struct(F.col("_least").isNull(), "_least", "_set")).alias("_set"), F.min("_least").alias("_least"))
    ids = small.groupBy("_id").agg(F.count("*").alias("_n"))
    chosen = keeps.select("_set", "_least", F.lit(True).alias("_keep"))
    gone = stored(small.join(chosen, small["_id"].eqNullSafe(chosen["_least"]) & (small["_set"] == chosen["_set"]), "left_anti").select("_id").where("_id is not null"), "simhash-gone")
    odd = stored(ids.where("_n > 1 or _id is null").select("_id"), "simhash-odd")
    count = gone.count()
    out = drop_ids(docs, gone, doc_id, count).where(F.col(doc_id).isNotNull())
    if odd.isEmpty():
        return out.select(columns)
    # Ids that several rows have: drop them all, and add one row of each that is chosen, by id and set.
    out = drop_ids(out, odd.where("_id is not null"), doc_id, odd.count())
    some = docs.join(odd, docs[doc_id].eqNullSafe(odd["_id"]), "left_semi")
    some = jaccard.with_set_id(some, text, shingle).join(chosen.select("_set", "_least"), "_set").where(F.col(doc_id).eqNullSafe(F.col("_least")))
    return out.select(columns).unionByName(some.dropDuplicates(["_set"]).select(columns))


def drop_ids(docs: DataFrame, ids: DataFrame, doc_id: str, count: int, most: int = 200_000) -> DataFrame:
    """Rows whose id isn't among ``count`` ids (column _id); up to ``most`` ids are broadcast, more are joined by shuffle."""
    ids = F.broadcast(ids) if count <= most else ids
    return docs.join(ids, docs[doc_id] == ids["_id"], "left_anti")
