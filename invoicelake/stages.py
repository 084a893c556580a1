"""Intermediate tables of a batch, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of this machine serves a session of one machine; on a cluster that is an error,
    since executors would each write to their own disks."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="invoicelake-")
    return _own


def stage(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes a step's rows to the shared folder, reads them back, and deletes the stored tables that only this step needed.

    Steps that join a table with what was summed up from it read it twice, so a chain of n such steps would read the input
    2**n times; and a lost executor costs one step, not the chain. What spark_partition_id() and the like gave is fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes stored tables; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_stage_path", None):
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of finished shuffles' files. Spark deletes them once the driver's collector sees that no plan names them any more; a driver with
    memory to spare collects seldom, and until then the files of all steps lie on the executors' disks together."""
    spark.sparkContext._jvm.System.gc()


def row_numbers(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with ``name``: 0, 1, 2 ... in the order of ``order``. Numbers within range partitions plus the rows before them: no single task.

    The ranged rows are stored first: partitions are counted from the very rows that are numbered, since a range exchange that is
    planned twice may draw other bounds.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))})
    placed = stage(placed)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n")).selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    out = placed.join(F.broadcast(parts), "_part").withColumn(name, F.col("_at") + F.col("_before")).select(*df.columns, name)
    out._stage_path = placed._stage_path
    return out
