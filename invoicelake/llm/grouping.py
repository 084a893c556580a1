"""Small groups out of a sorted stream of Arrow batches, without a call into Python from Spark for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_groups(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows of equal keys in one partition and in a row."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Each group of equal (whole-number, non-null) keys once. Holds one batch and one group at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(new), b.num_rows)
        for i, j in zip(starts[:-1], starts[1:]):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Forest:
    """Union-find over positions: keeps the links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
