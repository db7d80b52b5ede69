"""A store of a model's answers by the hash of what was asked: written by any number of jobs, the last write wins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .runs import _file_system

SCHEMA = "prompt_hash string, answer string, prompt_tokens long, completion_tokens long, cost_usd double, at timestamp, shard string"


class AnswerStore:
    """Parquet in a shared folder. Each write is a folder of its own, dealt by the first two digits of the hash.

    A write counts once Spark has marked it as whole, so a job that dies leaves nothing that is read, and writers don't
    meet. Of several answers of one hash the newest counts, of equally new ones the greatest. ``ttl_seconds`` of 0 keeps
    answers forever.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl_seconds: int = 0):
        self.spark, self.folder, self.ttl_seconds = spark, folder.rstrip("/"), ttl_seconds

    def writes(self) -> list[str]:
        """Folders of the writes that are whole, by name."""
        fs, at = _file_system(self.spark, self.folder)
        if not fs.exists(at(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at(self.folder)) if s.isDirectory()]
        return sorted(n for n in names if n.startswith("write-") and fs.exists(at(f"{self.folder}/{n}/_SUCCESS")))

    def put(self, rows: DataFrame) -> None:
        """Keep answers (prompt_hash, answer; prompt_tokens, completion_tokens, cost_usd and at may be missing); null ones aren't kept."""
        extra = {"prompt_tokens": F.lit(0).cast("long"), "completion_tokens": F.lit(0).cast("long"), "cost_usd": F.lit(None).cast("double"), "at": F.current_timestamp()}
        rows = rows.withColumns({k: v for k, v in extra.items() if k not in rows.columns}).where("answer is not null and prompt_hash is not null")
        rows = rows.select("prompt_hash", "answer", "prompt_tokens", "completion_tokens", "cost_usd", "at", F.substring("prompt_hash", 1, 2).alias("shard"))
        rows.repartition("shard").write.partitionBy("shard").parquet(f"{self.folder}/write-{uuid.uuid4().hex}")

    def _all(self) -> DataFrame:
        names = self.writes()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        out = None
        for name in names:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{name}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def entries(self, now: Column | None = None) -> DataFrame:
        """One row for each hash that has an answer which hasn't expired."""
        now = F.current_timestamp() if now is None else now
        whole = F.struct("answer", "prompt_tokens", "completion_tokens", "cost_usd", "at")
        newest = self._all().groupBy("shard", "prompt_hash").agg(F.max_by(whole, F.struct("at", "answer")).alias("e"))
        return rules.valid_entries(newest.select("prompt_hash", "e.*"), "at", now, self.ttl_seconds)

    def get(self, wanted: DataFrame, now: Column | None = None) -> DataFrame:
        """The entries of the hashes in ``wanted`` (prompt_hash)."""
        return self.entries(now).join(wanted.select("prompt_hash").distinct(), "prompt_hash", "left_semi")

    def _delete(self, names: list[str]) -> None:
        fs, at = _file_system(self.spark, self.folder)
        for name in names:
            fs.delete(at(f"{self.folder}/{name}"), True)

    def prune(self, now: Column | None = None) -> int:
        """Drop what has expired or was written over, by writing the rest anew; how many hashes have gone."""
        names, before = self.writes(), self._all().select("prompt_hash").distinct().count()
        left = self.entries(now)
        n = left.count()
        if names:
            self.put(left)
            self._delete(names)  # writes that came meanwhile stay
        return before - n

    def clear(self) -> int:
        """Delete everything; how many hashes had an answer."""
        names, n = self.writes(), self._all().select("prompt_hash").distinct().count()
        self._delete(names)
        return n
