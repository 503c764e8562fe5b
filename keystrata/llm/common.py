"""Helpers that the operators of this subpackage share: inputs, shared storage, row identity, chunks."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at once; longer texts are taken alone.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 500, "4m"
#: Setting by which Spark deletes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_by_value() -> None:
    """Executors get the functions of this subpackage with the tasks and need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def prepare(frame: DataFrame) -> None:
    """Before Python steps over texts: ship the code, and keep Arrow batches to few rows, as a batch is
    held by the JVM and by Python at once and its rows may be long."""
    ship_by_value()
    conf = frame.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast of an object of this subpackage, classes included; received() unpacks it."""
    ship_by_value()
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Where that setting is
    missing (a local session, as in tests), one temporary folder of this process stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"file://{tempfile.mkdtemp(prefix='keystrata-')}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/keystrata-{uuid.uuid4().hex}"


def store(df: DataFrame) -> str:
    """Write df once to shared storage: cuts lineage, survives lost executors. What it shuffled is not
    needed afterwards and is deleted."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Store df and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df))


def erase(spark: SparkSession, *paths: str) -> None:
    """Delete stored frames that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases, whose plans nothing refers to now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the decimal text of a column, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def row_key(*columns: str) -> Column:
    """64-bit identity of a row by its values: equal rows share it and are handled alike."""
    return F.xxhash64(*(F.col(c) for c in columns))


def carried(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "n_chars")) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that a cleaning stage works on, and all others as one struct, so that their names can't
    clash with what the stage adds; and the columns that make docs again."""
    kept = [c for c in docs.columns if c in own]
    others = [c for c in docs.columns if c not in own]
    held = docs.select(*kept, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried")] if others else []))
    return held, [F.col(c) if c in kept else F.col("carried").getField(c).alias(c) for c in docs.columns]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose texts take at most limit bytes together, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, taken = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and taken + n > limit:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += n
        if start < batch.num_rows:
            yield batch.slice(start)


def hand_back() -> None:
    """Give the system the memory that this process has freed and still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(*steps: Callable) -> Callable:
    """One Python step of steps over batches, one after the other in the same worker. Workers live on for later tasks,
    idle ones too, so each hands back what its task has taken."""

    def run(batches):
        try:
            for step in steps:
                batches = step(batches)
            yield from batches
        finally:
            del batches
            hand_back()

    return run


def arrow_of(frame_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame_schema)
