"""Exact top-k search by inner product: a pivot table bounds every score, and candidates are tried in bound order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .graph import run_starts, whole_runs

#: Pivots of a vector length besides the origin, and how many lengths get pivots of their own.
PIVOTS, LENGTHS = 32, 16
#: Most distinct vectors that pivots are picked from and that give each query its first threshold, and their bytes.
SAMPLE, SAMPLE_BYTES = 2048, 16 << 20
#: Most rows of either side, about, that meet in one group.
BLOCK = 2048
_KEYS = ["dims", "cell", "sub", "part"]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def pick_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """The origin and up to ``most`` vectors of the sample, each as far as can be from those before it."""
    pivots = np.zeros((1, sample.shape[1]))
    away = np.sqrt((sample * sample).sum(1))
    while len(pivots) <= most and len(sample) and away.max() > 0:
        new = sample[away.argmax()]
        pivots = np.vstack([pivots, new])
        away = np.minimum(away, np.sqrt(((sample - new) ** 2).sum(1)))
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)


def _bounds(own: np.ndarray, apart: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Most that scores can be, from squared norms and a least distance: 2 <q, v> = |q|^2 + |v|^2 - |q - v|^2."""
    total = own + theirs
    return np.floor((total - apart * apart) / 2 + 1e-9 * total + 1e-6)


def _pivot_table(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Append dims, distances to the pivots (the origin first) and cell: the nearest pivot's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(1)).to_numpy()
            for d in np.unique(dims).tolist():
                for rows in np.array_split(np.flatnonzero(dims == d), max(1, len(dims) * d // 1_000_000)):
                    if len(rows):
                        table = _distances(_matrix(batch.column(1), rows), pivots.get(d, np.zeros((1, d))))
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.reshape(-1)))
                        kept = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(rows), d, dtype=np.int32)), pa.array(table.argmin(1).astype(np.int32)), flat], [*kept.schema.names, "dims", "cell", "away"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kept}, dims int, cell int, away array<double>")


def _cells(points: DataFrame, lengths: list[int]) -> dict[int, dict[int, np.ndarray]]:
    """For each of the lengths and each cell, the least and greatest distance of its vectors to every pivot (2 x pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, c in np.unique(np.stack([dims, cell], axis=1), axis=0).tolist():
                x = _matrix(batch.column(2), np.flatnonzero((dims == d) & (cell == c)))
                ends = np.concatenate([x.min(0), -x.max(0)])
                least[d, c] = np.minimum(least.get((d, c), ends), ends)
        rows = [(d, c, p, v) for (d, c), ends in least.items() for p, v in enumerate(ends.tolist())]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["dims", "cell", "at", "least"])

    found = points.where(F.col("dims").isin(lengths)).select("dims", "cell", "away").mapInArrow(run, "dims int, cell int, at int, least double")
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in found.groupBy("dims", "cell", "at").agg(F.min("least").alias("least")).orderBy("dims", "cell", "at").collect():
        out.setdefault(r.dims, {}).setdefault(r.cell, []).append(r.least)
    return {d: {c: np.array(v).reshape(2, -1) * np.array([[1.0], [-1.0]]) for c, v in own.items()} for d, own in out.items()}


def _asked(points: DataFrame, sample: dict[int, np.ndarray], cells: dict[int, dict[int, np.ndarray]], k: int) -> DataFrame:
    """A row for each query and each cell whose bound reaches the query's threshold: the k-th best score in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            dims = get("dims").to_numpy()
            for d in np.unique(dims).tolist():
                for rows in np.array_split(np.flatnonzero(dims == d), max(1, len(dims) // 1024)):
                    if not len(rows):
                        continue
                    x, away = _matrix(get("v"), rows), _matrix(get("away"), rows)
                    known = sample.get(d, np.zeros((0, d)))
                    least = np.full(len(rows), -np.inf)
                    if len(known) >= k:
                        least = np.partition(x @ known.T, len(known) - k, axis=1)[:, len(known) - k]
                    wanted, number = [], []
                    for c, (near, far) in cells.get(d, {0: (None, None)}).items():
                        if near is None:
                            good = np.arange(len(rows))
                        else:
                            apart = np.maximum(np.maximum(near - away, away - far), 0).max(1)
                            good = np.flatnonzero(_bounds(away[:, 0] ** 2, np.maximum(apart - 1e-6 - 1e-9 * far[0], 0), far[0] ** 2) >= least)
                        wanted.append(good)
                        number.append(np.full(len(good), c, dtype=np.int32))
                    at = np.concatenate(wanted)
                    kept = batch.take(pa.array(rows[at]))
                    cell = kept.schema.get_field_index("cell")
                    yield kept.set_column(cell, "cell", pa.array(np.concatenate(number))).append_column("floor", pa.array(least[at]))

    schema = T.StructType([*points.schema.fields, T.StructField("floor", T.DoubleType())])
    return points.mapInArrow(run, schema)


def _best(score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([least, -score])[:k]


def _search(table: pa.Table, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Query, class and score of each query's k best candidates of one group."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(q) or not len(v):
        return [], [], []
    vectors, away = table.column("v"), table.column("away")
    x, y, dx, dy = _matrix(vectors, q), _matrix(vectors, v), _matrix(away, q), _matrix(away, v)
    ids, least, floor = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "least", "floor"))
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, (1 << 19) // len(v))
    for a in range(0, len(q), step):
        apart = np.zeros((len(q[a : a + step]), len(v)))
        for p in range(dx.shape[1]):
            np.maximum(apart, np.abs(dx[a : a + step, p, None] - dy[None, :, p]), out=apart)
        apart = np.maximum(apart - 1e-9 * (dx[a : a + step, :1] + dy[None, :, 0]) - 1e-6, 0)
        bounds = _bounds(nx[a : a + step, None], apart, ny[None, :])
        for i, bound in enumerate(bounds, a):
            most = floor[q[i]]
            order = np.flatnonzero(bound >= most)
            order = order[np.argsort(-bound[order], kind="stable")]
            score, kept, at, size = np.zeros(0), np.zeros(0, dtype=np.int64), 0, 64
            # In bound order, in batches that double, until no bound reaches the k-th best score.
            while at < len(order) and bound[order[at]] >= most:
                some = order[at : at + size]
                score, kept = np.append(score, y[some] @ x[i]), np.append(kept, some)
                top = _best(score, least[v[kept]], k)
                score, kept = score[top], kept[top]
                if len(score) == k:
                    most = max(most, score[-1])
                at, size = at + size, size * 2
            good = score >= floor[q[i]]
            out[0].append(np.full(int(good.sum()), ids[q[i]]))
            out[1].append(v[kept[good]])
            out[2].append(score[good])
    return out


def _met(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows (query, cls, least, score): the k best of each group in which a block of queries meets a block of a cell."""
    held = points.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    asking = asked.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sizes = stored(held.join(asking, ["dims", "cell"]), "topk-sizes")
    spread = lambda n: F.pmod(F.xxhash64("cls", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = points.withColumn("floor", F.lit(None).cast("double")).join(sizes, ["dims", "cell"]).withColumn("sub", spread("subs")).withColumn("part", every("parts"))
    two = asked.join(sizes, ["dims", "cell"]).withColumn("part", spread("parts")).withColumn("sub", every("subs"))
    columns = [*_KEYS, "cls", "least", "v", "away", "floor"]
    both = one.select(*columns, F.lit(False).alias("asks")).unionByName(two.select(*columns, F.lit(True).alias("asks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, _KEYS, 2 * BLOCK):
            starts = run_starts(table, _KEYS)
            query, at, score = [], [], []
            for a, b in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
                found = _search(table.slice(a, b - a), k)
                query += found[0]
                at += [a + x for x in found[1]]
                score += found[2]
            if query:
                rows = pa.array(np.concatenate(at))
                take = lambda c: table.column(c).combine_chunks().take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), take("cls"), take("least"), pa.array(np.rint(np.concatenate(score)).astype(np.int64))], ["query", "cls", "least", "score"])

    return both.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, "query long, cls long, least long, score long")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    Components are floor(scale * x), x as double. Candidates are all ``vectors`` of the query's length but those of
    its own id; equal scores go by the smaller id; with fewer candidates than k, all are returned. The result is
    exact. Pivots (and the origin) are picked from at most ``SAMPLE`` distinct vectors; the table of every vector's
    distances to them gives each pair a least distance and so a greatest score. A query meets only cells (vectors by
    nearest pivot) whose bound reaches its k-th best score in the sample, in groups of about ``BLOCK`` rows of either
    side, and there tries candidates in bound order until no bound reaches its k-th best score.
    Equal vectors are searched once: a class of them stands for its k + 1 smallest ids, so copies cost nothing more.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; a row that
    is there again counts once; an empty vector scores 0 with others. Scores are exact while a vector's squares sum
    to less than 2**53. Other columns are ignored; empty tables give no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.col(embedding).cast("array<double>")
        rows = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
        rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        return rows.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v")).distinct()

    first = Window.partitionBy("v").orderBy("id")
    few = clean(vectors).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), "v", "ids", F.element_at("ids", 1).alias("least")), "topk-classes")
    asking = stored(clean(queries), "topk-queries")
    kinds = stored(asking.select("v").distinct().select(F.monotonically_increasing_id().alias("cls"), "v", F.lit(0).cast("long").alias("least")), "topk-kinds")

    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    number = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    some = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(number).select("v").toArrow()["v"].to_pylist()
    by_length: dict[int, list] = {}
    for v in some:
        by_length.setdefault(len(v), []).append(v)
    sample = {d: np.array(by_length[d], dtype=np.float64).reshape(len(by_length[d]), d) for d in sorted(by_length, key=lambda d: (-len(by_length[d]), d))[:LENGTHS]}
    pivots = {d: pick_pivots(x) for d, x in sample.items()}

    points = stored(_pivot_table(classes.select("cls", "v", "least"), pivots), "topk-table")
    asked = stored(_asked(_pivot_table(kinds, pivots), sample, _cells(points, list(pivots)), k + 1), "topk-asked")
    met = _met(points, asked, k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    top = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "cls", "score")
    named = top.join(classes.select("cls", "ids"), "cls").select("query", F.explode("ids").alias("vec_id"), "score")
    listed = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id"))), 1, k + 1).alias("top"))
    answers = asking.join(kinds.select("cls", "v"), "v").select(F.col("id").alias("query_id"), "cls")
    answers = answers.join(listed, answers.cls == listed.query).select("query_id", "top")
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    rows = answers.select("query_id", F.posexplode(own).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.cost")).alias("score"))
