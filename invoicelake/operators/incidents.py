"""For every line the next one that isn't ok, going round at the end: a suffix scan over range partitions.

One shuffle deals the lines out by ranges of their numbers. Each task goes through its range from the end and carries the last incident it met; what
it can't know, the first incident of the ranges behind it, is one row for each range, and is brought in once all are scanned.
No window runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import stage

_SCANNED = pa.schema([("at", pa.int64()), ("local", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, bad) from the greatest number down -> the least incident above each, within the task. Holds one batch and two numbers."""
    near: int | None = None  # the least incident so far, and the least above it: equal numbers may lie in two batches
    far: int | None = None
    for b in batches:
        if not b.num_rows:
            continue
        at, bad = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        known = np.unique(at[bad.astype(bool)])
        every = np.array(sorted({*known.tolist(), *(x for x in (near, far) if x is not None)}), np.int64)
        place = np.searchsorted(every, at, side="right")
        found = place < len(every)
        values = np.where(found, every[np.minimum(place, len(every) - 1)], 0) if len(every) else np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values, mask=~found)], schema=_SCANNED)
        if len(every):
            near, far = int(every[0]), int(every[1]) if len(every) > 1 else None


def next_incidents(rows: DataFrame, *, order_col: str = "fila", state_col: str = "estado", partitions: int | None = None) -> DataFrame:
    """(order_col, siguiente): for each line number the least greater one of a line that isn't ok; behind the last incident the first of all, which may be the
    line itself; null where all are ok. Lines of one number share the answer, each gives a row. Lines without a number give none and, like
    those without a state, are no incidents."""
    keyed = rows.select(F.col(order_col).cast("long").alias("at"), F.coalesce(F.col(state_col) != "ok", F.lit(False)).alias("bad")).filter("at is not null")
    ranged = keyed.repartitionByRange(partitions, "at") if partitions else keyed.repartitionByRange("at")
    scanned = ranged.sortWithinPartitions(F.desc("at")).select("at", "bad").mapInArrow(_scan, "at long, local long")
    scanned = stage(scanned.withColumn("range", F.spark_partition_id()))
    # a range's first incident: itself where bad, which the scan gives to the rows below it; the lowest row's own state is asked of the input
    firsts = stage(scanned.groupBy("range").agg(F.min("at").alias("begin"), F.max("at").alias("end")))
    incidents = keyed.filter("bad").join(F.broadcast(firsts), F.expr("at between begin and end")).groupBy("range").agg(F.min("at").alias("first"))
    behind = "min(first) over (order by range rows between 1 following and unbounded following)"
    carry = firsts.select("range").join(incidents, "range", "left").selectExpr("range", f"{behind} as carry", "min(first) over () as wrap")
    out = scanned.join(F.broadcast(carry), "range").select(F.col("at").alias(order_col), F.coalesce("local", "carry", "wrap").alias("siguiente"))
    out._stage_path = scanned._stage_path
    return out
