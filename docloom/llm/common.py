"""Helpers that several operators share: lineage cuts, folds, and Arrow row mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Run a plan once and go on from a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Run a plan once and go on from a Parquet table in the shared folder (for larger results than ``cut``)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and broadcasts of plans that nothing refers to any more.

    It does so when the driver collects garbage, which may be long after a loop's next rounds have written theirs
    (``spark.cleaner.periodicGC.interval`` is half an hour).
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing is read from them any more; other frames are left alone."""
    for df in tables:
        spark = df.sparkSession
        top = shared_dir(spark).removeprefix("file://").rstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if top and folder.removeprefix("file://").removeprefix("file:").startswith(top + "/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4 (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the held-out fold; a null id does not."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def constants(values: list, kind: str) -> Column:
    """A constant array, folded once into one literal (an array of so many literals is slow to plan)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that a result column of the same name (in any case) replaces."""
    taken = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in taken])


#: Rows that a function gets at once, so that a task holds little besides Spark's own batch.
ROWS = 2048


def map_rows(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Append columns that a function computes from each Arrow batch; same-named input columns are replaced.

    ``make`` runs once in a task (to load a model); what it returns maps a record batch to arrays by column name.
    A column that the function needs but that it replaces is still in the batch it gets.
    """
    new = [f.name for f in fields]
    kept = without(df, *new).columns
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = work(batch)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [out[c] for c in new]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *new])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together have about ``most`` bytes (a longer text is alone)."""
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    lengths = lengths.fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield start, len(lengths)


_resident: dict = {}


def resident(key: tuple | None, make: Callable | None = None):
    """This worker's one large model: made at a key's first use, dropped when another is asked for (or None).

    Workers outlive tasks and operators; without this each operator's model would stay beside the next one's.
    """
    if key not in _resident:
        _resident.clear()
        if key is not None:
            _resident[key] = make()
    return _resident.get(key)
