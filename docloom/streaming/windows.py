"""Sessions and deduplication over event streams; the same code runs on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each key: start, end, number of events; ``late`` sets a watermark for streams."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if late else rows
    grouped = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str | None = None) -> DataFrame:
    """One row of each key; a stream forgets a key once the watermark has passed it by ``late``."""
    if late and events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
