"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import connected_components, in_blocks, local_roots, pairs, run_starts, whole_runs

TABLES, HASHES, PROBES = 5, 2, 3
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each vector in each table, and the next likely ones (PROBES a table).

    A hash is the nearest signed axis after three random sign flips and Hadamard transforms; a bucket joins HASHES
    of them. Probes put the second axis in place of the first in one hash, the least loss first, then in both.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([SEED, size])
    main, probes = np.zeros((n, tables), dtype=np.int64), np.zeros((n, tables, PROBES), dtype=np.int64)
    at = np.arange(n)
    for t in range(tables):
        codes, losses = [], []
        for _ in range(HASHES):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            strength = np.abs(y)
            two = np.argpartition(-strength, 1, axis=1)[:, :2]
            swap = strength[at, two[:, 0]] < strength[at, two[:, 1]]
            two[swap] = two[swap][:, ::-1]
            codes.append(two * 2 + (y[at[:, None], two] < 0))
            losses.append(strength[at, two[:, 0]] - strength[at, two[:, 1]])
        wide = 2 * size
        main[:, t] = codes[0][:, 0] * wide + codes[1][:, 0]
        one, two = codes[0][:, 1] * wide + codes[1][:, 0], codes[0][:, 0] * wide + codes[1][:, 1]
        first = losses[0] <= losses[1]
        probes[:, t, 0], probes[:, t, 1] = np.where(first, one, two), np.where(first, two, one)
        probes[:, t, 2] = codes[0][:, 1] * wide + codes[1][:, 1]
    return main, probes


def _matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _keys(classes: DataFrame, tables: int) -> DataFrame:
    """Each class's rows in the tables: key (label, dimension, table and bucket), main (own bucket, or a probe's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy()
            for d in np.unique(dims):
                for rows in np.array_split(np.flatnonzero(dims == d), max(1, len(dims) * int(d) // 1_000_000)):
                    if not len(rows):
                        continue
                    main, probes = buckets(_matrix(batch.column(2), rows), tables)
                    table = np.concatenate([main[:, :, None], probes], axis=2)
                    kinds = table.shape[2]
                    ids = batch.column(0).take(pa.array(np.repeat(rows, tables * kinds)))
                    label = batch.column(1).take(pa.array(np.repeat(rows, tables * kinds)))
                    number = np.tile(np.repeat(np.arange(tables), kinds), len(rows))
                    own = np.tile(np.arange(kinds) == 0, len(rows) * tables)
                    yield pa.RecordBatch.from_arrays([ids, label, pa.array(np.full(len(own), d, dtype=np.int32)), pa.array(number.astype(np.int32)), pa.array(table.reshape(-1)), pa.array(own)], ["rep", "label", "dim", "table", "bucket", "main"])

    rows = classes.select("rep", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "rep long, label string, dim int, table int, bucket long, main boolean")
    return rows.withColumn("key", F.struct("label", "dim", "table", "bucket"))


def links(classes: DataFrame, least: float, tables: int = TABLES, block: int = 1024) -> DataFrame:
    """Verified links of distinct vectors (rep, label, embedding, copies): rows (a, b, n).

    For each vector a, n counts the vectors (with copies) that it links to in one block, and b is the smallest that
    the block's links reach; sums of n over all rows are the numbers of links. A pair is counted where it first
    meets: in its first shared table, and there in the smaller of the buckets where it meets. Buckets are compared
    in blocks, by cosine in double precision, and yield rows for vectors, not for pairs.
    """
    lite = _keys(classes, tables).select("rep", "key", "main")
    dealt = in_blocks(lite, "key", "rep", block).select("rep", "main", "part", "key.*", "pair.*")
    rows = dealt.join(classes.select("rep", "embedding", "copies"), "rep")
    columns = ["label", "dim", "table", "bucket", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, columns, 4_000):
            yield from _compare(table, columns, least, tables)

    ordered = rows.select(*columns, "part", "rep", "main", "copies", "embedding").repartition(*columns).sortWithinPartitions(*columns)
    return ordered.mapInArrow(compare, "a long, b long, n long")


def _compare(table: pa.Table, columns: list[str], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    starts = run_starts(table, columns)
    get = lambda c: table.column(c).to_numpy()
    rep, part, lo, hi, main, copies, number, bucket = (get(c) for c in ("rep", "part", "lo", "hi", "main", "copies", "table", "bucket"))
    dims = get("dim")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        x = _matrix(table.column("embedding"), rows)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        place = np.full(len(dims), -1)
        place[rows] = np.arange(len(rows))
        own, probes = buckets(x, tables)
        near_i, near_j = [], []
        # Long runs by matrix products, the others by pairs of neighbours, of those two apart, and so on.
        size = np.diff(np.append(starts, len(dims)))
        for s, n in zip(starts[(size > 48)], size[(size > 48)]):
            if dims[s] == d:
                at = place[s : s + n]
                i, j = np.nonzero(np.triu(x[at] @ x[at].T >= least - 1e-9, 1))
                near_i.append(s + i)
                near_j.append(s + j)
        short = starts[size <= 48]
        mask = np.repeat(size <= 48, size) & (dims == d)
        picked = np.flatnonzero(mask)
        if len(picked):
            first = np.flatnonzero(np.isin(picked, short))
            for i, j in pairs(first, len(picked)):
                i, j = picked[i], picked[j]
                good = np.einsum("ij,ij->i", x[place[i]], x[place[j]]) >= least - 1e-9
                near_i.append(i[good])
                near_j.append(j[good])
        if not near_i:
            continue
        i, j = np.concatenate(near_i), np.concatenate(near_j)
        good = (main[i] | main[j]) & ((part[i] != part[j]) | (lo[i] == hi[i])) & (rep[i] != rep[j])
        i, j = i[good], j[good]
        good = np.einsum("ij,ij->i", x[place[i]], x[place[j]]) >= least
        i, j = i[good], j[good]
        # Where else the pair meets: in an earlier table, or in a smaller bucket of this one.
        t, b, pi, pj = number[i], bucket[i], place[i], place[j]
        keep = np.ones(len(i), dtype=bool)
        for k in range(tables):
            meets_i = (own[pi, k] == own[pj, k]) | (probes[pj, k] == own[pi, k][:, None]).any(1)
            meets_j = (own[pi, k] == own[pj, k]) | (probes[pi, k] == own[pj, k][:, None]).any(1)
            keep &= ~((meets_i | meets_j) & (k < t))
            keep &= ~((k == t) & ((meets_i & (own[pi, k] < b)) | (meets_j & (own[pj, k] < b))))
        found.append((i[keep], j[keep]))
    if not found:
        return
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    total = np.zeros(len(rep), dtype=np.int64)
    np.add.at(total, i, copies[j])
    np.add.at(total, j, copies[i])
    # Roots by id, so that the smallest index of a component is its smallest vector.
    order = np.argsort(rep, kind="stable")
    position = np.empty(len(rep), dtype=np.int64)
    position[order] = np.arange(len(rep))
    root = local_roots(len(rep), position[i], position[j])
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[order[root[position[some]]]]), pa.array(total[some])], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", least: float = 0.93, tables: int = TABLES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null (``label=None``: always) and the cosine of their vectors is at
    least ``least``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Equal vectors of a label are one class and link with each other; the class is
    hashed once. Hashing finds a link with a probability that grows with the cosine (see the tests for the recall);
    each is verified. kept is whether the row has its component's smallest id. Repeated ids are separate rows that
    link if their vectors do; a null id is its own component.
    """
    mark = F.lit("") if label is None else F.col(label)
    doubles = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), mark.alias("label"), doubles.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    zero = F.forall("embedding", lambda v: v == 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite & ~zero, F.lit(False))
    good = rows.where(usable)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = stored(links(classes, least, tables), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    components = connected_components(found.select("a", "b"))
    named = classes.join(components, classes.rep == components.node, "left").select("rep", "label", "embedding", "copies", "least", F.coalesce("component", "rep").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").join(counts, F.col("rep") == F.col("a"), "left")
    named = named.select("label", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
