"""BM25 similarity: corpus statistics, best documents by blocks of queries and documents, best pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import top_per_group
from .store import stored

# The usual Okapi parameters, what is cut from a text before it is split into words, and what a word is.
K1, B, EPSILON = 1.5, 0.75, 0.25
FRONTMATTER = r"(?s)\A---\n.*?\n---\n?"
FENCES = r"(?sm)^(`{3,}|~{3,})[^\n]*\n.*?\n\1[ \t]*$"
WORD = r"[\p{L}\p{N}_]+"

#: Distinct words of queries, and queries, that a task holds at most (a hash of them can be somewhat above), and words of documents in a block.
ASKED, QUERIES, WORDS = 1 << 23, 1 << 16, 1 << 22
#: Scores that a task has at once, and places of the matrix of terms that many queries have.
PAIRS, MATRIX = 1 << 20, 1 << 23
#: Scores are rounded to so many decimals before they are compared.
DECIMALS = 6


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, without a leading frontmatter and fenced blocks."""
    body = F.when(F.startswith(text, F.lit("---\n")), F.regexp_replace(text, FRONTMATTER, "")).otherwise(text)
    body = F.when(F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")), F.regexp_replace(body, FENCES, "")).otherwise(body)
    return F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))


def _idf(df: DataFrame, n: int) -> DataFrame:
    """Terms with their idf, from df (columns term, df) of n documents: a negative one becomes a share of the mean idf."""
    raw = df.withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    return raw.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")))


def terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Terms (term, idf) of a collection. A term in over half the documents has a share of the mean idf instead of its own."""
    words = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    df = stored(words.groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    return _idf(df, docs.count()).select("term", "idf")


class _Asked:
    """One block's query vectors and the k best documents so far of each, while the block's documents go by in order of keys."""

    def __init__(self, q: np.ndarray, selves: list, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int):
        self.q, self.n = q, len(q)
        self.own: dict = {}
        for i, x in enumerate(selves):
            if x is not None:
                self.own.setdefault(x, []).append(i)
        order = np.argsort(terms, kind="stable")
        self.known, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(terms))
        self.asks, self.weights = np.repeat(np.arange(self.n), sizes)[order], weights[order]
        # Terms of many queries are multiplied as a matrix, the others by their lists.
        count = np.diff(self.first)
        many = np.argsort(-count, kind="stable")[: min(1024, MATRIX // self.n)]
        many = many[count[many] * 16 >= self.n]
        self.place = np.full(len(self.known), -1)
        self.place[many] = np.arange(len(many))
        self.matrix = np.zeros((len(many), self.n))
        for row, t in enumerate(many.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            self.matrix[row, self.asks[at]] = self.weights[at]
        self.score = np.full((self.n, k), -np.inf)
        self.key = np.full((self.n, k), None, dtype=object)

    def meet(self, keys: list, words: np.ndarray, sizes: np.ndarray, mean: float) -> None:
        """Score documents against all queries of the block, as many at once as ``PAIRS`` allows."""
        ends = np.append(0, np.cumsum(sizes))
        step = max(1, PAIRS // self.n)
        for a in range(0, len(keys), step):
            b = min(a + step, len(keys))
            self._take(keys[a:b], self._scores(words[ends[a] : ends[b]], sizes[a:b], mean))

    def _scores(self, words: np.ndarray, sizes: np.ndarray, mean: float) -> np.ndarray:
        t = np.searchsorted(self.known, words)
        t[t == len(self.known)] = 0
        hit = self.known[t] == words if len(self.known) else np.zeros(len(words), dtype=bool)
        both, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[hit] * len(self.known) + t[hit], return_counts=True)
        row, t = np.divmod(both, max(1, len(self.known)))
        w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / mean))
        dense = self.place[t] >= 0
        left = np.zeros((len(sizes), len(self.matrix)))
        left[row[dense], self.place[t[dense]]] = w[dense]
        total = (left @ self.matrix).reshape(-1)
        row, t, w = row[~dense], t[~dense], w[~dense]
        long = self.first[t + 1] - self.first[t]
        until = np.cumsum(long)
        start = 0
        while start < len(row):  # a stretch of entries whose lists are together about as long as PAIRS
            end = max(start + 1, int(np.searchsorted(until, until[start] - long[start] + 4 * PAIRS, side="right")))
            n = long[start:end]
            at = np.repeat(self.first[t[start:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total += np.bincount(np.repeat(row[start:end] * self.n, n) + self.asks[at], np.repeat(w[start:end], n) * self.weights[at], len(total))
            start = end
        return total.reshape(len(sizes), self.n)

    def _take(self, keys: list, scores: np.ndarray) -> None:
        for i in range(len(keys) if self.own else 0):
            scores[i, self.own.get(keys[i], [])] = -np.inf
        # Only where a score may be above the k-th best it is rounded; of equal ones the first that came has the smaller key.
        some = np.flatnonzero((scores > self.score[:, -1] - 10.0**-DECIMALS).any(0))
        if not len(some):
            return
        held = self.score.shape[1]
        both = np.concatenate([self.score[some], scores[:, some].T.round(DECIMALS) + 0.0], axis=1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :held]
        self.score[some] = np.take_along_axis(both, best, axis=1)
        new = np.full(len(keys), None, dtype=object)
        new[:] = keys
        kept = np.take_along_axis(self.key[some], np.minimum(best, held - 1), axis=1)
        self.key[some] = np.where(best < held, kept, new[np.maximum(best - held, 0)])

    def found(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        good = self.score > -np.inf
        for a in range(0, self.n, 1 << 14):
            own = good[a : a + (1 << 14)]
            q = np.repeat(self.q[a : a + len(own)], own.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.key[a : a + len(own)][own].tolist(), kind), pa.array(self.score[a : a + len(own)][own])], ["q", "key", "score"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of an array column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _search(dealt: DataFrame, k: int, mean: float) -> DataFrame:
    """q, key and score: the k best documents of a group (block of queries, block of documents) for each of its queries.

    Rows are sorted by group, queries first, documents by key: a task holds one block of queries and a batch of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, waiting, kind = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("key").type
            groups, queries = batch.column("group").to_numpy(), batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (groups[1:] != groups[:-1]) | (queries[1:] != queries[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if groups[a] != group:
                    if asked is not None:
                        yield from asked.found(kind)
                    group, asked, waiting = groups[a], None, []
                part = batch.slice(a, b - a)
                if queries[a]:
                    waiting.append((part.column("q").to_numpy(), part.column("key").to_pylist(), *_flat(part.column("words")), _flat(part.column("weights"))[0]))
                    continue
                if asked is None and waiting:
                    q, selves, terms, sizes, weights = zip(*waiting)
                    asked = _Asked(np.concatenate(q), [x for own in selves for x in own], np.concatenate(terms), np.concatenate(weights), np.concatenate(sizes), k)
                    waiting = []
                for at in range(0, part.num_rows if asked is not None else 0, 2048):
                    some = part.slice(at, 2048)
                    asked.meet(some.column("key").to_pylist(), *_flat(some.column("words")), mean)
        if asked is not None:
            yield from asked.found(kind)

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", dealt.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    return dealt.mapInArrow(run, schema)


def top_k(queries: DataFrame, docs: DataFrame, k: int = 5, query_key: str = "item_id", query_text: str = "text", key: str = "doc_id", text: str = "text", pool: DataFrame | None = None, itself: bool = False) -> DataFrame:
    """For each query text the k best documents: query_key, key, score (6 decimals), rank; ties by key.

    Each query word counts as often as it stands in the query; documents without any of them score 0 and count too.
    ``pool`` keeps only documents whose keys it has (statistics are of all); ``itself`` leaves out the document of
    the query's own key. Keys are not null and differ. A null text has no words.

    The result is exact: every query is scored against every document. Queries and documents are dealt into blocks that meet once;
    a task scores a batch of documents against a block of queries and keeps k documents of each, so neither scores nor
    pairs are shuffled or stored. A document is moved once for each ``ASKED`` distinct words of all queries, a
    query once for each block of documents, which are only so many as to move about as much as the documents. No
    query text or score goes through the driver. Terms are known by a hash of 64 bits.
    """
    spark = docs.sparkSession
    hashed = lambda x: F.transform(F.coalesce(tokens(x), F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    kept = stored(docs.select(F.col(key).alias("key"), hashed(F.col(text)).alias("words")), "bm25-words")
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    df = stored(kept.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    asks = stored(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_key).alias("query"), hashed(F.col(query_text)).alias("words")), "bm25-queries")
    own = asks.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    own = own.join(_idf(df, size["n"]), "term").groupBy("q").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("c"))).alias("s"))
    own = own.select("q", F.transform("s", lambda s: s["term"]).alias("terms"), F.transform("s", lambda s: s["c"]).alias("c"))
    kind = kept.schema["key"].dataType
    vectors = asks.select("q", F.col("query").try_cast(kind).alias("key") if itself else F.lit(None).cast(kind).alias("key")).join(own, "q", "left")
    vectors = stored(vectors.select("q", "key", F.coalesce("terms", F.array().cast("array<bigint>")).alias("words"), F.coalesce("c", F.array().cast("array<double>")).alias("weights")), "bm25-vectors")
    asked = vectors.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    blocks = max(1, -(-asked["words"] // ASKED), -(-asked["n"] // QUERIES))
    parts = max(spark.sparkContext.defaultParallelism, min(-(-size["words"] // WORDS), size["words"] // max(1, asked["words"])))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    asking = vectors.withColumn("part", every(parts)).select((block * parts + F.col("part")).alias("group"), "q", "key", "words", "weights")
    found = kept.join(pool.select(F.col(key).alias("key")).distinct(), "key", "left_semi") if pool is not None else kept
    found = found.withColumn("block", every(blocks)).select((F.col("block") * parts + F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).alias("group"), F.lit(None).cast("long").alias("q"), "key", "words", F.lit(None).cast("array<double>").alias("weights"))
    dealt = asking.unionByName(found).repartition(blocks * parts, "group").sortWithinPartitions("group", F.col("q").asc_nulls_last(), "key")
    best = top_per_group(_search(dealt, k, max(size["mean"], 1e-9)), "q", [F.desc("score"), F.col("key")], k)
    named = query_key if query_key != key else f"{key}_query"
    return best.join(asks.select("q", "query"), "q").select(F.col("query").alias(named), F.col("key").alias(key), "score", F.col("rank").cast("long").alias("rank"))


def top_k_pairs(docs: DataFrame, k: int = 5, least: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs a, b (a the query document) and score: every document's best k others of ``least`` or more, each pair once.

    Scores aren't symmetric: a pair has the score of the direction whose query document comes first in order of keys,
    if that direction is among its best k and reaches ``least``, else of the other. Best pairs first.
    """
    found = top_k(docs, docs, k, key, text, key, text, itself=True).where(F.col("score") >= least)
    one, two = F.col(f"{key}_query"), F.col(key)
    pairs = found.groupBy(F.least(one, two).alias("_low"), F.greatest(one, two).alias("_high")).agg(F.min_by(F.struct(one.alias("a"), two.alias("b"), "score"), one).alias("p"))
    return pairs.select("p.*").orderBy(F.desc("score"), "a", "b")
