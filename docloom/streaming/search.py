"""Search that answers while files come in: caps for each document and a total limit that hold across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import search

MATCH = "path string, line_no int, line string, n_matches long"


def file_stream(spark: SparkSession, folder: str, kind: str = "*.md", files_per_batch: int = 1000) -> DataFrame:
    """path and text of the files of a folder, as they appear; a file is read once, whole."""
    reader = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", kind).option("maxFilesPerTrigger", files_per_batch).format("text").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def capped_matches(parts: DataFrame, query: str, per_document: int | None = 50) -> DataFrame:
    """Matching lines of a stream of documents or parts of them (path, text; first_line, from 0, may be missing).

    The cap holds for a path over all of its parts, in whatever batches they come: the number of its lines that were
    given is state, kept in Spark's state store. Within a batch a path's lines count in order.
    """
    known = "first_line" in parts.columns
    first = F.col("first_line") if known else F.lit(0)
    key = F.struct("path", first.cast("int").alias("first"))
    found = search.search_lines(parts.withColumn("_key", key), query, "_key", "text", None)
    rows = found.select(F.col("_key.path").alias("path"), (F.col("line_no") + F.col("_key.first")).cast("int").alias("line_no"), "line", F.col("n_matches").cast("long").alias("n_matches"))
    if per_document is None:
        return rows

    def cap(path: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = state.get[0] if state.exists else 0
        batch = pd.concat(list(frames)).sort_values("line_no").head(max(0, per_document - given))
        state.update((given + len(batch),))
        yield batch

    return rows.groupBy("path").applyInPandasWithState(cap, MATCH, "given long", "append", GroupStateTimeout.NoTimeout)


def kept_matches(spark: SparkSession, out: str) -> DataFrame:
    """What a search has written so far; nothing where it has written nothing."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = f"{MATCH}, batch long"
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(out)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def search_stream(parts: DataFrame, query: str, out: str, checkpoint: str, per_document: int | None = 50, limit: int | None = 200, once: bool = False) -> StreamingQuery:
    """Start a search that writes matches to ``out`` as they are found; ``limit`` is the most it writes in all.

    A batch's matches are a partition of ``out`` that is written over if the batch is run again, and what earlier batches
    have written says how many are left, so neither is lost nor doubled when a query is stopped and started again
    with the same checkpoint. ``once`` takes what is there and ends. Which matches the limit keeps depends on the order in
    which files come; within a batch they go by path and line. A query that has reached its limit writes nothing more.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if limit is not None:
            left = limit - kept_matches(spark, out).where(F.col("batch") < number).count()
            if left <= 0:  # the batch still has to run, for the state of its paths
                batch.write.format("noop").mode("overwrite").save()
                return
            rows = rows.orderBy("path", "line_no").limit(left)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = capped_matches(parts, query, per_document).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def reached(spark: SparkSession, out: str, limit: int) -> bool:
    """Whether a search has written as much as it may, so that its query can be stopped."""
    return kept_matches(spark, out).count() >= limit
