"""Linked groups: comparing the rows of large buckets in bounded blocks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node and component: the smallest node that links of ``edges`` (columns a, b) reach.

    Alternates large-star and small-star steps, each a shuffle by node, until the edges stay as they are; then
    every node points at its smallest. Nodes without an edge are absent; nulls and loops are ignored. The number
    of rounds grows with the logarithm of a component's size. Each round is a table in the shared folder, so a lost
    executor costs one round at most.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, state = stored(e, "links"), None
    while True:
        # Each half of a round is stored: as one plan of both, it reads the links many times over, which the driver must hold and plan.
        least = e.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("m"))
        large = stored(e.join(least, e["b"] == least["_node"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select("b", "m")
        before, e = e, stored(least.unionAll(rest).toDF("a", "b").distinct(), "links")
        discard(before, large)
        forget(edges.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    root = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)


def in_blocks(rows: DataFrame, key: str, by: str, block: int = 1024, weight: Column | None = None) -> DataFrame:
    """Deal the rows of each bucket out so that any two of a bucket meet once, in a group of at most about 2 x block.

    A bucket of n rows is split by a hash of ``by`` into ceil(n / block) parts, and each two parts form a group;
    buckets of one row are dropped, for they hold no pair. Adds part and pair (struct lo, hi). With a weight, n is its sum.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), (F.count("*") if weight is None else F.sum(weight)).alias("_sum")).where("_n > 1")
    parts = rows.join(sizes, key).withColumn("_parts", F.greatest(F.ceil(F.col("_sum") / block), F.lit(1)).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64(by, F.lit(7)), F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        parts.withColumn("_other", other)
        .withColumn("pair", F.struct(F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi")))
        .drop("_n", "_sum", "_parts", "_other")
    )


def whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = 20_000, most: int | None = None) -> Iterator[pa.Table]:
    """Tables that end where a run of equal ``columns`` ends; the input is sorted by them.

    With ``most``, a run of more rows than that may go on in the next tables.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held)
            where = run_starts(table, columns)[-1]
            if most is not None and size - where > most:
                where = size
            if where:
                yield table.slice(0, where)
            rest = table.slice(where).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where each run of equal values begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for c in columns:
        values = table.column(c).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def pairs(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs inside the runs, as arrays: neighbours first, then those two apart, and so on."""
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    i, lag = np.arange(n), 1
    while len(i := i[i + lag < end[i]]):
        yield i, i + lag
        lag += 1


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links i - j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root
