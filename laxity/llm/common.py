"""Shared helpers of the training-data operators: table access, work tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python, if the session does not say otherwise; Spark's own 64 MB are held several times over in each task.
BATCH_BYTES = 4 << 20
#: Rows for which compact() keeps a task and its file.
FILE_ROWS = 20_000
#: Rows that a table may have and still be broadcast; rows are narrow (a few longs or a digest).
BROADCAST_ROWS = 300_000


def in_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose batches to Python are of BATCH_BYTES, unless it has been given a size of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 << 20):
        conf.set(key, f"{BATCH_BYTES}b")
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="laxity-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/laxity-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many narrow rows, in a task for each FILE_ROWS of them, and one for each core at least: each file that is written costs
    an executor several processes on a local file system, and with many shuffle partitions small tables would be hundreds of files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def gathered(df: DataFrame) -> DataFrame:
    """df, made by a task for each shuffle partition or file, dealt to an eighth of them, and one for each core at least, before it is written: for tables of
    unknown size that cost more to make than to shuffle. The tasks that make it stay as many as they are."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() when nothing will read it again."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when the counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= bound else df


def packed(docs: DataFrame, key: Column) -> DataFrame:
    """_row (all columns of docs), _id (doc_id), _key: so that no column of docs can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), key.alias("_key"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker keeps from one task to the next: things of one operator at a time.
_kept: dict = {}


def release() -> None:
    """Gives freed memory back to the system; an idle worker counts to its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def kept(key: tuple, make: Callable):
    """make(), once in a Python worker, until another operator's tasks come."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    if _kept:
        _kept.clear()
        gc.collect()
        release()


def alone(run: Callable) -> Callable:
    """run over batches in a worker that has dropped what other operators kept, and gives back what it has freed at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        forget()
        yield from run(batches)
        release()

    return wrapped


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices that end where the texts of the column reach about `most` bytes; none of an empty batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
