"""Packing documents into fixed-length training sequences: bounded-space online best fit.

Each input partition keeps a fixed number of open windows. A document's ids, its end id included, are cut into whole
windows of ``seq_len`` and one rest; the rest goes into the open window with the least sufficient room. Where none has
room, a new window opens, or, at the bound, the fullest is emitted first. Windows still open at a partition's end are
leftovers: their fills alone, never their ids, are merged in groups of partitions by the same rule, fullest first.

No shuffle of texts or ids: a task tokenises and places what it reads, and only piece metadata move.

Nulls and empty texts: a document of its end id alone. A null id stays null. Repeated rows are packed each on its own. An
empty table gives no rows. Very long texts span as many windows as they need. Other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, slices
from .tokens import tokenizer

#: Input partitions whose leftovers are merged in one task; with the window bound, it bounds a task's rows.
MERGED_PARTITIONS = 32
_SCHEMA = "kind int, part long, win long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, ids binary"
_ARROW = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("part", "win", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")), ("ids", pa.binary())])


class Windows:
    """Open windows of one partition, at most ``most``. place(n) gives (window, offset)."""

    def __init__(self, seq_len: int, most: int):
        self.seq_len, self.most, self.count = seq_len, most, 0
        self.open: list[tuple[int, int]] = []  # (room, window), least room first

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, n: int) -> tuple[int, int]:
        k = bisect_left(self.open, (n, -1))
        if k < len(self.open):
            room, win = self.open.pop(k)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest is emitted
            room, win = self.seq_len, self.new()
        if room > n:
            insort(self.open, (room - n, win))
        return win, self.seq_len - room


def _place_all(path: str, special: bool, end_id: int, seq_len: int, open_windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk, part, windows = tokenizer(path, special), TaskContext.get().partitionId(), Windows(seq_len, open_windows)
        for b in slices(batches):
            names = iter(b.column(0).to_pylist())
            for ids, bounds in tk.many(b.column(1), end_id):
                rows, raw, at = [], memoryview(ids.tobytes()), bounds.tolist()
                for first, last in zip(at, at[1:]):
                    doc_id = next(names)
                    for start in range(first, last, seq_len):
                        n = min(seq_len, last - start)
                        piece = raw[4 * start : 4 * (start + n)]
                        win, offset = windows.place(n) if n < seq_len else (windows.new(), 0)
                        rows.append((0, part, win, doc_id, start - first, n, zlib.crc32(piece), last - first, offset, bytes(piece) if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        if windows.open:
            rows = [(1, part, win, None, None, seq_len - room, None, None, None, None) for room, win in windows.open]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return run


def _merge(seq_len: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "part", "win"], ascending=[False, True, True])
        windows, first, out = Windows(seq_len, len(group)), {}, []
        for part, win, n in zip(group.part, group.win, group.length):
            at, base = windows.place(n)
            first.setdefault(at, (part, win))
            out.append((part, win, *first[at], base))
        return pd.DataFrame(out, columns=["part", "win", "to_part", "to_win", "base"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, seq_len: int = 2048, open_windows: int = 64, with_ids: bool = False, special: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if ``with_ids``. ``special``: literals of added tokens become their ids, as the library has it."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("utf8"))
    placed = Scratch(spark, "pack").store(source.mapInArrow(_place_all(tokenizer_path, special, end_id, seq_len, open_windows, with_ids), _SCHEMA))
    left = placed.filter("kind = 1").select("part", "win", "length").withColumn("part_group", F.expr(f"part div {MERGED_PARTITIONS}"))
    moved = left.groupBy("part_group").applyInPandas(_merge(seq_len), "part long, win long, to_part long, to_win long, base long")
    pieces = placed.filter("kind = 0").drop("kind").join(moved, ["part", "win"], "left")
    out = pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("shiftleft(coalesce(to_part, part), 32) + coalesce(to_win, win)").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )
    out._scratch_path = placed._scratch_path  # Scratch.drop(out) deletes it
    return out
