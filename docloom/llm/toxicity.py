"""Toxicity by class-conditional Kneser-Ney models of the letters of words, with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, forget, map_rows, resident, slices
from .words import text_bytes

#: Symbols of the classes' longest n-grams and of the shared ones, which give the chances that the classes back off to.
ORDER, SHARED, BITS = 11, 5, 5
#: Where an n-gram's number of symbols stands in its packed form, above its symbols.
TOP = ORDER * BITS
BLANK = 26
#: Symbols of an n-gram: letters without case, blanks, digits, other ASCII, and three classes of non-ASCII bytes.
SYMBOL = np.full(256, 28, dtype=np.int32)
SYMBOL[0x61:0x7B] = SYMBOL[0x41:0x5B] = np.arange(26)
SYMBOL[[0x20, *range(0x09, 0x0E)]] = BLANK
SYMBOL[0x30:0x3A] = 27
SYMBOL[0x80:] = 29 + np.arange(128) % 3
#: A word's log ratio counts as far as it is over this margin, chosen with ORDER on folds 0, 1 and 3 (see the README).
MARGIN = 4.0
#: The log of a text's summed excess, and of its number of symbols, which the score weighs to normalise the sum by length.
FEATURES = ["excess", "length"]
CLASSES = ("toxic", "ordinary")
#: Bytes of texts whose n-grams are worked on at once; a symbol takes some 100 bytes meanwhile.
SLICE = 1 << 19
#: The bits of an n-gram's last symbols, by their number.
LOW = (np.int64(1) << BITS * np.arange(ORDER + 1)) - 1


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed n-gram of each symbol of the texts and of the blank after each; its row; n-grams before each row.

    An n-gram is a symbol, those before it in the same word, and the blank before the word, at most ORDER symbols:
    what a word follows doesn't matter, so its first letters are one expression wherever it stands.
    """
    data, row_start = text_bytes(column)
    size = np.diff(row_start)
    rows = np.arange(len(size))
    code = np.full(len(data) + 2 * len(size), BLANK, dtype=np.int64)
    code[np.arange(len(data)) + np.repeat(2 * rows + 1, size)] = SYMBOL[data]
    key = code.copy()
    for k in range(1, min(ORDER, len(code))):
        key[k:] |= code[:-k] << (k * BITS)
    at = np.arange(len(code))
    blank = np.maximum.accumulate(np.where(code == BLANK, at, 0))
    held = np.minimum(at - np.append(0, blank)[: len(at)] + 1, ORDER)
    key = key & LOW[held] | held << TOP
    predicted = np.ones(len(code), dtype=bool)
    predicted[row_start[:-1] + 2 * rows] = False
    return key[predicted], np.repeat(rows, size + 1), np.append(0, np.cumsum(size + 1))


def _short(key: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of packed n-grams; blanks stand for symbols before the word."""
    held = np.minimum(key >> TOP, order)
    blanks = np.array([sum(BLANK << BITS * j for j in range(k, order)) for k in range(order + 1)], dtype=np.int64)
    return key & LOW[held] | blanks[held]


def shared_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the short n-grams of all texts (key, n); at most 2**25 keys exist.

    Every task sums up its texts first, so what is shuffled is a row per n-gram and block of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for batch in batches:
            for a, b in slices(batch, text, SLICE):
                unique, count = np.unique(_short(_keys(batch.column(0).slice(a, b - a))[0], SHARED).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(count)], ["key", "n"])

    return docs.select(text).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def class_counts(docs: DataFrame, text: str = "text", label: str = "toxic", part: str = "part") -> DataFrame:
    """Counts of the n-grams (key) in each part's texts labelled 1 (toxic) and in its texts labelled 0 (ordinary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)
        for batch in batches:
            labels, parts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for a, b in slices(batch, text, SLICE):
                key, row, _ = _keys(batch.column(0).slice(a, b - a))
                for p in np.unique(parts[a:b]):
                    own = parts[a:b][row] == p
                    unique, of = np.unique(key[own], return_inverse=True)
                    columns = [np.bincount(of[labels[a:b][row[own]] == value], minlength=len(unique)) for value in (1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(np.full(len(unique), p, dtype=np.int32)), *map(pa.array, columns)], ["key", "part", "toxic", "ordinary"])

    rows = docs.select(text, F.col(label).cast("int"), F.col(part).cast("int")).mapInArrow(run, "key long, part int, toxic long, ordinary long")
    return rows.groupBy("key", "part").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary): of known n-grams, of what known contexts leave to others; weights of the score."""

    key: np.ndarray
    ratio: np.ndarray
    context: np.ndarray
    rest: np.ndarray
    weights: np.ndarray

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """The log ratio of each n-gram; of an unknown one what its context leaves to others, 0 if that is unknown too."""
        unique, of = np.unique(key, return_inverse=True)
        out, known = _find(self.key, self.ratio, unique)
        out[~known] = _find(self.context, self.rest, _context(unique[~known]))[0]
        return out[of]


def _find(known: np.ndarray, value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key (0 of an unknown one), and whether it is known."""
    if not len(known) or not len(key):
        return np.zeros(len(key), dtype=np.float32), np.zeros(len(key), dtype=bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    good = known[at] == key
    return np.where(good, value[at], np.float32(0)), good


def _context(key: np.ndarray) -> np.ndarray:
    """A packed n-gram without its last symbol; it keeps the n-gram's number of symbols."""
    return (key & LOW[ORDER]) >> BITS | (key >> TOP) << TOP


def discount(once: int, twice: int) -> float:
    """Kneser-Ney's estimate from the numbers of n-grams seen once and twice."""
    return once / (once + 2 * twice) if once else 0.5


def _shared(key: np.ndarray) -> np.ndarray:
    """Probability of each (SHARED - 1)-gram's last symbol after the others, from continuation counts of all texts."""
    types, chances = key, np.full(1, 1 / (1 << BITS))
    levels = []
    for order in range(SHARED - 1, 0, -1):
        count = np.bincount(types & ((1 << (order * BITS)) - 1), minlength=1 << (order * BITS)).astype(np.float64)
        levels.append(count)
        types = np.flatnonzero(count)
    for count in reversed(levels):
        by = count.reshape(-1, 1 << BITS)
        total, kinds, d = by.sum(1, keepdims=True), (by > 0).sum(1, keepdims=True), discount(int((count == 1).sum()), int((count == 2).sum()))
        # The lower order's row of a context is that of the context without its first symbol.
        lower = np.resize(chances.reshape(-1, 1 << BITS) if chances.size > 1 else np.repeat(chances, 1 << BITS)[None], by.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            chances = np.where(total > 0, (np.maximum(by - d, 0) + d * kinds * lower) / total, lower).reshape(-1)
    return chances


def likelihood_ratios(key: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> Model:
    """The classes' models from the packed n-grams and their counts (a column for each class), without weights.

    A class's chance of a symbol is its discounted share of what followed the same beginning of a word in the class;
    the discounts' sum goes to the chance of the symbol after the three before it, which is Kneser-Ney's from the
    counts of all texts and the same for both classes. An n-gram that begins a word keeps its plain count, since
    nothing precedes it. Discounts are estimated for each number of symbols.
    """
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for size in range(2, ORDER + 1):
        own = np.flatnonzero(key >> TOP == size)
        own = own[np.argsort(key[own])]
        grams, n = key[own], counts[own]
        context, of = np.unique(_context(grams), return_inverse=True)
        total = np.column_stack([np.bincount(of, n[:, c], len(context)) for c in (0, 1)])
        kinds = np.column_stack([np.bincount(of, n[:, c] > 0, len(context)) for c in (0, 1)])
        d = np.array([discount(int((n[:, c] == 1).sum()), int((n[:, c] == 2).sum())) for c in (0, 1)])
        left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        chances = np.maximum(n - d, 0) / np.maximum(total, 1)[of] + left[of] * shared[_short(grams, SHARED - 1)][:, None]
        rest = np.log(np.maximum(left, 1e-6))
        for part, x in zip(parts, (grams, np.log(chances[:, 0]) - np.log(chances[:, 1]), context, rest[:, 0] - rest[:, 1])):
            part.append(x)
    known, ratio, context, rest = map(np.concatenate, parts)
    return Model(known, ratio.astype(np.float32), context, rest.astype(np.float32), np.zeros(len(FEATURES) + 1))


def features(column: pa.Array, model: Model) -> np.ndarray:
    """Of each text: the log of the sum of its words' log ratios as far as they are over MARGIN, and of its length."""
    key, row, first = _keys(column)
    sums = np.append(0.0, np.cumsum(model.ratios(key), dtype=np.float64))
    end = np.flatnonzero((key & LOW[1]) == BLANK) + 1
    words = np.diff(np.append(0.0, sums[end]))
    over = np.bincount(row[end - 1], np.maximum(words - MARGIN, 0), len(column))
    return np.column_stack([np.log1p(over), np.log1p(np.diff(first))])


def _with_features(docs: DataFrame, text: str, model: Model) -> DataFrame:
    def make():
        resident(None)

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text))
            found = np.concatenate([features(column.slice(a, b - a), model) for a, b in slices(batch, text, SLICE)])
            return {name: pa.array(found[:, k]) for k, name in enumerate(FEATURES)}

        return work

    return map_rows(docs, [T.StructField(name, T.DoubleType()) for name in FEATURES], make)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps on a penalised logistic likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 4_000, most_bytes: int = 8 << 20) -> Model:
    """Fit the models. Labels come from rows whose id's crc32 is not 2 modulo 4; a null id or label is no label.

    The score's weights are fitted on the features that each fold's rows get from the counts of the other folds, so
    that no text weighs itself; the models then use the counts of all three. About ``most`` labelled rows of about
    ``most_bytes`` in all, at most, are used, chosen by a hash of the id, which bounds the model. Backoff counts are
    gathered over all texts. An id with several labels has the largest.
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"), fold(F.col(doc_id)).cast("int").alias("_fold")).where("_id is not null and _y is not null and _fold <> 2")
    usable = usable.groupBy("_id").agg(F.max("_y").alias("_y"), F.first("_fold").alias("_fold"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    size = texts.select("_id", F.octet_length("_text").alias("_n")).join(usable, "_id").agg(F.count("*").alias("n"), F.sum("_n").alias("b")).first()
    share = min(1.0, most / max(1, size.n), most_bytes / max(1, size.b or 0))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = texts.join(F.broadcast(chosen), "_id")  # at most about `most` rows of 16 bytes
    shared = _shared(shared_counts(texts, "_text").select("key").toArrow()["key"].to_numpy())
    counts = class_counts(rows, "_text", "_y", "_fold").toArrow()
    key, part = counts["key"].to_numpy(), counts["part"].to_numpy()
    numbers = np.column_stack([counts[c].to_numpy().astype(np.int32) for c in CLASSES])
    del counts

    def fitted(own: np.ndarray) -> Model:
        unique, of = np.unique(key[own], return_inverse=True)
        return likelihood_ratios(unique, np.column_stack([np.bincount(of, numbers[own, c], len(unique)) for c in (0, 1)]).astype(np.int64), shared)

    found = []
    for k in (0, 1, 3):
        found.append(_with_features(rows.where(F.col("_fold") == k), "_text", fitted(part != k)).select("_y", *FEATURES).toArrow())
        forget(docs.sparkSession)  # the fold's model, which the driver holds for the tasks
    x = np.column_stack([np.concatenate([f[c].to_numpy() for f in found]) for c in FEATURES])
    y = np.concatenate([f["_y"].to_numpy() for f in found])
    model = fitted(part >= 0)
    model.weights = logistic(x, np.minimum(y, 1)) if len(np.unique(y > 0)) > 1 else np.array([1.0, 0.0, -2.0])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append each whole text's score, 0 to 1: a logistic function of its words' log-likelihood ratios, normalised by length.

    Null and empty texts have one n-gram, of blanks, and get the score that it gives. The other columns are kept;
    columns named like the result or the features (excess, length) are replaced by them.
    """
    w = model.weights
    linear = F.lit(float(w[-1]))
    for k, name in enumerate(FEATURES):
        linear = linear + F.col(name) * float(w[k])
    kept = [c for c in docs.columns if c.lower() not in {out.lower(), *FEATURES}]
    return _with_features(docs.select(kept), text, model).withColumn(out, 1 / (1 + F.exp(-linear))).select(*kept, *FEATURES, out)
