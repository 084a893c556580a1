"""Validation anew after edits, of what they touch alone.

A line's own rules depend on the line, and whether it is a duplicate on the lines of its key. So an edit touches its line, and the lines of the key that the
line had and of the one that it has now; a deleted line those of its old key. The stored result carries each line's key as a hash, and is bucketed by it
in files: only the buckets of touched keys are read and written again, the others stay as they are. What was edited twice or not at all makes no difference:
the result is that of the whole run.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import joins
from ..sources import records
from ..stages import free_shuffles, release, shared_dir, stage
from . import duplicates, edits, validate

#: Folders that a result is dealt into by key, and those that lines are found in by document.
BUCKETS = 64
#: Buckets that are computed anew at once.
GROUP = 16


class Results:
    """Validated lines in the folder ``path``: versions, each a list of bucket folders. A version shares the folders of buckets that it didn't
    change with the one before. States and duplicates are stored; messages follow from a line alone and are written as lines are read."""

    def __init__(self, lines: DataFrame, period: int, path: str | None = None, buckets: int = BUCKETS):
        """The whole run: validates all lines. They are read twice: store them first (``stages.stage``)."""
        self.spark, self.period, self.buckets = lines.sparkSession, period, buckets
        self.path = path or f"{shared_dir(self.spark)}/results-{uuid.uuid4().hex}"
        self.columns = lines.columns
        self.folders: dict[int, str] = {}
        self.read_rows = 0
        free_shuffles(self.spark)
        self._store(self._hashed(lines), range(buckets))

    def _hashed(self, lines: DataFrame) -> DataFrame:
        """lines with the hash of their key; lines without a key are dealt out by their own number."""
        return lines.withColumn("_hash", duplicates.key_hash(F.struct("doc_seq", "line_no")))

    def _bucket(self) -> Column:
        """The bucket of a hash: as Spark numbers the tasks of a shuffle by it, so that a task holds one bucket."""
        return F.pmod(F.hash("_hash"), F.lit(self.buckets)).cast("int")

    def _validated(self, lines: DataFrame) -> DataFrame:
        return validate.validate(lines, F.lit(self.period).cast("long"))

    def _store(self, hashed: DataFrame, buckets) -> None:
        """Judges the buckets and writes them anew, into a folder of this version. Whole lines are shuffled once, without messages."""
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        marked = duplicates.mark_in_place(hashed.withColumn("_bucket", self._bucket()), "_hash", self.buckets)
        judged = validate.final_state(self._validated(marked).drop("issues"))
        judged.write.option("compression", "zstd").partitionBy("_bucket").parquet(folder)
        free_shuffles(self.spark)
        have = set(records.subfolders(self.spark, folder))
        for b in buckets:
            name = f"_bucket={b}"
            if name in have:
                self.folders[b] = f"{folder}/{name}"
            else:
                self.folders.pop(b, None)
        self.schema = judged.drop("_bucket").schema

    def _stored(self, buckets=None) -> DataFrame:
        """The stored lines, or those of some buckets."""
        paths = [p for b, p in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lines(self, buckets=None) -> DataFrame:
        """The results, or those of some buckets."""
        found = self._stored(buckets)
        told = self._validated(found.withColumnRenamed("estado", "_final"))
        own = [c for c in found.columns if c not in ("estado", "issues", "dup_doc", "dup_line")]
        return told.select(*own, "issues", F.col("_final").alias("estado"), "dup_doc", "dup_line")

    def _groups(self, at: DataFrame, buckets) -> list[tuple[list[int], DataFrame]]:
        """The buckets in groups, with the touched lines that are in each: so few that they are broadcast, unless one bucket has more."""
        counts = {r["_bucket"]: r["count"] for r in at.groupBy("_bucket").count().collect()}  # at most as many as buckets
        groups, n = [], 0
        for b in sorted(buckets):
            if not groups or len(groups[-1]) == GROUP or n + counts.get(b, 0) > joins.BROADCAST_ROWS:
                groups.append([])
                n = 0
            groups[-1].append(b)
            n += counts.get(b, 0)
        out = []
        for g in groups:
            here = at.filter(F.col("_bucket").isin(g)).select("doc_seq", "line_no")
            out.append((g, F.broadcast(here) if sum(counts.get(b, 0) for b in g) <= joins.BROADCAST_ROWS else here))
        return out

    def apply(self, changes: DataFrame, deleted: DataFrame | None = None) -> set[int]:
        """Takes in edits (doc_seq, line_no, campo, valor, orden) and deleted lines (doc_seq, line_no); returns the buckets that were computed anew.
        They are read and written group by group, so that what is shuffled at once is a part of them."""
        changes = stage(changes)
        gone = stage((deleted if deleted is not None else changes.limit(0)).select("doc_seq", "line_no").distinct())
        touched = changes.select("doc_seq", "line_no").unionByName(gone).distinct()
        # where the touched lines are now: two columns of the buckets are read, and the lines themselves from theirs
        place = F.regexp_extract(F.input_file_name(), r"_bucket=(\d+)", 1).cast("int")
        at = stage(self._stored().select("doc_seq", "line_no", place.alias("_bucket")).join(touched, ["doc_seq", "line_no"], "left_semi"))
        old = {r[0] for r in at.select("_bucket").distinct().collect()}  # at most as many as buckets
        if not old:
            release(changes, gone, at)
            return set()
        found = reduce(DataFrame.unionByName, (self._stored(g).select(*self.columns).join(here, ["doc_seq", "line_no"], "left_semi") for g, here in self._groups(at, old)))
        moved = stage(self._hashed(edits.without_rows(edits.apply(found, changes), gone)).withColumn("_bucket", self._bucket()))
        affected = old | {r[0] for r in moved.select("_bucket").distinct().collect()}
        self.read_rows = 0
        for g, here in self._groups(at, affected):
            stay = self._hashed(self._stored(g).select(*self.columns).join(here, ["doc_seq", "line_no"], "left_anti"))
            rows = stay.unionByName(moved.filter(F.col("_bucket").isin(g)).drop("_bucket"))
            self._store(rows, g)
            self.read_rows += self._stored(g).count()
        release(changes, gone, at, moved)
        return affected
