"""Language ID: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_rows, slices, without
from .words import LOWER, text_bytes

SIZE_BITS = 13
SIZE = 1 << SIZE_BITS
#: Lower-cased letters and non-ASCII bytes; anything else is a blank.
LETTERS = np.where(np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), LOWER, 0x20).astype(np.uint32)


def counts(column: pa.Array) -> np.ndarray:
    """How often each hashed n-gram of 2 and 3 bytes stands in each text, which a blank precedes and follows."""
    data, row_start = text_bytes(column)
    size = np.diff(row_start)
    rows = len(size)
    code = np.full(len(data) + 2 * rows, 0x20, dtype=np.uint32)
    code[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, size)] = LETTERS[data]
    row = np.repeat(np.arange(rows), size + 2)
    out = np.zeros(rows * SIZE, dtype=np.int64)
    for n in (2, 3):
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, dtype=np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * np.uint32(0x01000193)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SIZE_BITS)
        inside = row[: len(h)] == row[n - 1 :]
        out += np.bincount(row[: len(h)][inside] * SIZE + h[inside], minlength=rows * SIZE)
    return out.reshape(rows, SIZE)


def _small(batch: pa.RecordBatch, text: str, rows: int = 128) -> Iterator[tuple[int, int]]:
    for a, b in slices(batch, text, 1 << 20):
        for c in range(a, b, rows):
            yield c, min(b, c + rows)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length of (1 + log tf) x idf; a row without n-grams stays zero."""
    x = np.zeros(tf.shape, dtype=np.float32)
    some = tf > 0
    x[some] = 1 + np.log(tf[some].astype(np.float32))
    x *= idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    #: Index of each centroid's language.
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    #: Distance beyond which a text is unlike all that the centroid's cluster was made of.
    reach: np.ndarray


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and how far each one's members lie (99.5th percentile, half as much again)."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, 1)
        sums = np.stack([x[of == c].sum(0) if (of == c).any() else centres[c] for c in range(len(centres))])
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = sums / np.where(norm > 0, norm, 1)
    near = x @ centres.T
    of = np.argmax(near, 1)
    far = [1.5 * float(np.percentile(1 - near[of == c, c], 99.5)) if (of == c).any() else 0.0 for c in range(len(centres))]
    return centres, np.array(far)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, centroids: int = 4) -> Model:
    """Fit on rows whose id's crc32 is not 2 modulo 4, with a text and a language.

    Document frequencies cover all of these rows. The centroids of a language are clustered from a sample of about
    ``per_language`` of its rows (chosen by a hash of the id). The model has all languages there are, some 130 kB
    each. No usable row gives a model without languages.
    """
    usable = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where((fold(F.col("_id")) != 2) & F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    sizes = usable.groupBy("_lang").agg(F.count("*").alias("_n"))
    counted = sizes.agg(F.count("*").alias("languages"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE, dtype=np.int64)
        for batch in batches:
            for a, b in _small(batch, "_text"):
                df += (counts(batch.column(0).slice(a, b - a)) > 0).sum(0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["bucket", "n"])

    found = usable.select("_text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SIZE)
    for r in found:
        df[r.bucket] = r.n
    idf = (np.log((1 + counted.rows) / (1 + df)) + 1).astype(np.float32)
    rates = sizes.select("_lang", F.least(F.lit(1.0), F.lit(per_language) / F.col("_n")).alias("_rate"))
    rates = F.broadcast(rates) if counted.languages <= 100_000 else rates
    chosen = usable.join(rates, "_lang").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("_rate") * (1 << 30)).select("_id", "_text", "_lang")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_text"])
        x = np.concatenate([vectors(counts(pa.array(pdf["_text"][i : i + 64], pa.string())), idf) for i in range(0, len(pdf), 64)])
        centres, far = _clusters(x, centroids)
        return pd.DataFrame({"lang": pdf["_lang"].iloc[0], "reach": far, "centre": list(centres.astype(np.float32))})

    rows = chosen.groupBy("_lang").applyInPandas(fit, "lang string, reach double, centre array<float>").toPandas().sort_values("lang", kind="stable")
    languages = sorted(set(rows["lang"]))
    owner = np.array([languages.index(x) for x in rows["lang"]], dtype=np.int64)
    centres = np.stack(rows["centre"].tolist()) if len(rows) else np.zeros((0, SIZE), dtype=np.float32)
    return Model(languages, owner, centres.astype(np.float32), idf, rows["reach"].to_numpy(dtype=float))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected (beyond that centroid's reach).

    A null text, one without a letter, and any text under a model without languages has lang_pred und and score 0.
    A rejected text keeps its nearest language; the caller decides. Columns of the results' names are replaced.
    """
    docs = without(docs, "lang_pred", "score", "rejected", "_letter").withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = T.StructType.fromDDL("lang_pred string, score double, rejected boolean").fields

    def make():
        names = np.array([*model.languages, "und"], dtype=object)

        def part(column: pa.Array, letter: np.ndarray) -> list[np.ndarray]:
            best, near, owner = np.zeros(len(column), dtype=int), np.zeros(len(column)), np.full(len(column), len(names) - 1)
            if len(model.owner):
                x, near = vectors(counts(column), model.idf), np.full(len(column), -np.inf)
                for a in range(0, len(model.owner), 1024):
                    cosine = x @ model.centroids[a : a + 1024].T
                    first = np.argmax(cosine, 1)
                    nearer = cosine[np.arange(len(x)), first] > near
                    best, near = np.where(nearer, a + first, best), np.where(nearer, cosine[np.arange(len(x)), first], near)
                near = np.clip(near.astype(float), 0, 1)
                owner = np.where(letter, model.owner[best], len(names) - 1)
            near = np.where(letter, near, 0.0)
            far = (1 - near > model.reach[best]) if len(model.owner) else np.ones(len(column), dtype=bool)
            return [names[owner], near, far | ~letter]

        def work(batch: pa.RecordBatch) -> dict:
            column, letter = (batch.column(batch.schema.get_field_index(c)) for c in (text, "_letter"))
            flags = letter.to_numpy(zero_copy_only=False)
            parts = [part(column.slice(a, b - a), flags[a:b]) for a, b in _small(batch, text)]
            return {f.name: pa.array(np.concatenate([p[k] for p in parts])) for k, f in enumerate(fields)}

        return work

    return map_rows(docs, fields, make).drop("_letter")
