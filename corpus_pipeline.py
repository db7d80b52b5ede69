"""The corpus pipeline: five stages of the training-data operators, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontam, secrets, sentpiece, simhash, toxicity
from docloom.llm.queries import PIECE_MODEL, table

#: The score from which a document counts as toxic.
TOXIC = 0.3


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 500 rows: texts are long, and a batch is held by the JVM and by the Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now (a null text keeps its number)."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity models reject."""
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity") < TOXIC).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    _small_batches(spark)
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark out of texts."""
    _small_batches(spark)
    done = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove=True)
    return _sized(done, docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put marks in place of secrets."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark)))
    return _sized(secrets.redact(found), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked against the library."""
    _small_batches(spark)
    done = sentpiece.encode(docs, PIECE_MODEL)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenise),
]

#: SQL has no form of the models, fingerprints and tokens; tests/llm hold the near-duplicate stage and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        common.forget(spark)  # the stage's models, which the driver holds for its tasks
    return docs
