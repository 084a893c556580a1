"""What the corpus operators share: the cluster's shared folder, stored tables, raw files, text helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: Rows that Python code takes at once. Spark bounds an Arrow batch by spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this machine serves a session of
    one machine; on a cluster that is an error, since executors would each write to their own disks."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="invoicelake-")
    return _own_dir


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder so that a lost executor costs no redo.

    ``store`` writes a table and reads it back; ``drop`` deletes what later steps don't need, ``keep`` all but what the result is
    read from.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.paths: set[str] = set()

    def store(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.tag)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                delete_path(self.spark, path)
                self.paths.discard(path)

    def keep(self, *frames: DataFrame) -> None:
        for path in self.paths - {getattr(df, "_scratch_path", None) for df in frames}:
            delete_path(self.spark, path)
            self.paths.discard(path)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


_WORKER: dict[str, object] = {}


def worker_cache(key: str, make: Callable[[], object]):
    """What a Python worker keeps between its tasks for one operator. Workers outlive stages, so another operator's is let go
    first: a worker holds the largest of its caches, not all of them."""
    got = _WORKER.get(key)
    if got is None:
        _WORKER.clear()
        gc.collect()
        got = _WORKER[key] = make()
    return got


def write_blobs(df: DataFrame, path: str, column: str, compression: str = "none") -> None:
    """Writes each row's bytes as a file of its own, followed by one line feed, in the order of the partitions.

    Spark's text writer passes on the bytes of a string as they are, so its commit protocol and any file system that
    Spark knows serve binary files too.
    """
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", compression)
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below a folder, each read whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows``; empty ones are left out."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def batch_columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    for b in slices(batches):
        yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def as_bytes(c: Column) -> Column:
    """A text's UTF-8 bytes; null gives none."""
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


#: Rows of one key that may meet in a task as they are; and the most keys with more of them, which bounds the list that is broadcast.
HOT_ROWS = 200
MOST_HOT_KEYS = 100_000
#: Values that a task of ``seen_twice`` looks at together.
HELD_VALUES = 8 << 20


def seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over one column of arrays of numbers: (value, n) of values that this task sees at least twice among HELD_VALUES. A value that
    no task names has at most one row for each task and HELD_VALUES. No shuffle of all values is needed to find the common ones."""

    def flush() -> pa.RecordBatch:
        every, counts = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(every[often], pa.int64()), pa.array(counts[often], pa.int64())], names=["value", "n"])

    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
        if sum(map(len, held)) > HELD_VALUES:
            yield flush()
            held = []
    yield flush()


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """Of counts (keys, n) that add up to at most ``total``: the keys that need more tasks than one, with their number ``_ways``. At most
    MOST_HOT_KEYS."""
    least = max(HOT_ROWS, -(-total // MOST_HOT_KEYS))
    return counts.filter(F.col(n) > least).select(*keys, F.expr(f"cast((`{n}` + {least - 1}) div {least} as int)").alias("_ways"))


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with table, in which each key is there once or a few times. Rows of hot keys are dealt out by ``spread``, the table's rows of them
    are repeated once for each way; so no task gets a whole hot key, and nothing but the list of hot keys is broadcast."""
    few = F.broadcast(hot)
    dealt = rows.join(few, keys, "left").withColumn("_way", F.pmod(spread, F.coalesce("_ways", F.lit(1))).cast("int")).drop("_ways")
    copied = table.join(few, keys, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copied, [*keys, "_way"], how).drop("_way")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that a column already has."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def n_shuffle(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions for a shuffle of all rows: the session's number, or as many as the input has if those are more."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return n if df is None else max(n, df.rdd.getNumPartitions())
