"""Size-tiered compaction of an append-only table of small shards.

Arrivals are written as small immutable Parquet shards and become visible by a new manifest version. A shard's tier is the logarithm of
its size; once a tier holds ``fan_in`` shards, they are merged into files of about ``target_bytes``, which reach a higher tier. Shards
of the target size are never rewritten, so each row is rewritten at most once for each tier. Merges that don't depend on each
other run at the same time.

A manifest lists the live shards of one version, and the table's schema. Version n + 1 is written aside, and then renamed to its own
name, which only one writer can do: readers take the highest version, so they see an append or a merge entirely or not at all; a
writer that fails before the rename leaves nothing that is read or in the way, and one that lost the race reads the winner's version
and tries again. The shards of the last ``retain`` versions stay, for readers that have begun; what only older ones list is deleted with
them. Manifests hold shard names and sizes, never rows, and only as many are kept.

Nulls, empty texts, repeated rows and all columns are kept as they are, whatever their names; an empty arrival adds no shard, and a
table without rows is read as such. Appends of another schema are refused.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _fs, delete_path

#: Merges at the same time.
PARALLEL = 4


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, least_bytes: int = 1 << 16, retain: int = 10):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes, self.retain = target_bytes, fan_in, least_bytes, retain

    def tier(self, size: int) -> int:
        """0 for the smallest shards; those near the target size have the last."""
        return max(0, int(math.log(max(size, 1) / self.least_bytes, self.fan_in)))

    # Manifests
    def _list(self, path: str) -> list[tuple[str, int]]:
        fs, jpath = _fs(self.spark, path)
        return [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(jpath)] if fs.exists(jpath) else []

    def _versions(self) -> list[int]:
        """Those there are, highest first."""
        return sorted((int(name[1:-5]) for name, _ in self._list(f"{self.root}/manifests") if name.startswith("v") and name.endswith(".json")), reverse=True)

    def _path(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict:
        """The highest version, or the one asked for: {"version", "schema", "shards": [{"path", "bytes"}]}."""
        if version is None:
            version = next(iter(self._versions()), 0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, jpath = _fs(self.spark, self._path(version))
        stream = fs.open(jpath)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        body, _, mark = text.rpartition("\n")
        if mark != f"{zlib.crc32(body.encode()):08x}":
            raise ValueError(f"version {version} is broken")
        return json.loads(body)

    def _publish(self, version: int, body: str) -> bool:
        """Whether the version is ours. Written whole under another name first; renaming never replaces."""
        jvm = self.spark._jvm
        fs, aside = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(f"{body}\n{zlib.crc32(body.encode()):08x}".encode()))
        stream.close()
        final = jvm.org.apache.hadoop.fs.Path(self._path(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            fs.delete(aside, False)
            if not fs.exists(final):
                raise
            return False

    def _commit(self, add: list[dict], remove: set[str], schema: StructType | None = None) -> dict:
        """Tries again on the winner's version; a merge whose inputs are gone there is given up."""
        while True:
            now = self.manifest()
            if not remove <= {s["path"] for s in now["shards"]}:
                raise RuntimeError("another writer has merged these shards")
            if schema is not None and now["schema"] is not None and json.loads(now["schema"]) != json.loads(schema.json()):
                raise ValueError("the table has another schema")
            shards = [s for s in now["shards"] if s["path"] not in remove] + add
            nxt = {"version": now["version"] + 1, "schema": now["schema"] or (schema.json() if schema is not None else None), "shards": shards}
            if self._publish(nxt["version"], json.dumps(nxt)):
                return nxt

    # Shards
    def _shards_in(self, folder: str) -> list[dict]:
        return [{"path": f"{folder}/{name}", "bytes": size} for name, size in self._list(f"{self.root}/{folder}") if name.endswith(".parquet")]

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._shards_in(folder)

    def append(self, df: DataFrame) -> dict:
        return self._commit(self._write(df), set(), df.schema)

    def append_each(self, df: DataFrame, arrival: Column) -> None:
        """One pass over ``df`` for many arrivals: each value of ``arrival`` is one, committed in ascending order; then compaction."""
        folder, name = f"shards/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
        arrivals = [x for x, _ in self._list(f"{self.root}/{folder}") if x.startswith(f"{name}=")]
        for x in sorted(arrivals, key=lambda x: (len(x), x)):
            self._commit(self._shards_in(f"{folder}/{x}"), set(), df.schema)
        if not arrivals:
            self._commit([], set(), df.schema)
        self.compact()

    def due(self) -> list[list[dict]]:
        """Runs of shards that can be merged now, each into files of about the target size: of every tier that holds ``fan_in`` shards."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            if s["bytes"] < self.target_bytes // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs: list[list[dict]] = []
        for t in sorted(tiers):
            run: list[dict] = []
            for s in tiers[t]:
                run.append(s)
                if len(run) >= self.fan_in and sum(x["bytes"] for x in run) >= self.target_bytes:
                    runs.append(run)
                    run = []
            if len(run) >= self.fan_in:
                runs.append(run)
        return runs

    def _merge(self, run: list[dict]) -> None:
        files = max(1, round(sum(s["bytes"] for s in run) / self.target_bytes))
        self._commit(self._write(self._read(run).coalesce(files)), {s["path"] for s in run})

    def compact(self) -> int:
        """Merges until no tier is due; returns the number of merges."""
        merges = 0
        while runs := self.due():
            with ThreadPoolExecutor(PARALLEL) as pool:
                list(pool.map(self._merge, runs))
            merges += len(runs)
            self.vacuum()
        return merges

    def vacuum(self) -> int:
        """Deletes all but the last ``retain`` versions, and the shards that only deleted versions list; returns how many shards. A writer's shards
        that no version lists yet are left alone."""
        versions = self._versions()
        kept, old = versions[: self.retain], versions[self.retain :]
        live = {s["path"] for v in kept for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in old for s in self.manifest(v)["shards"]} - live
        for path in [f"{self.root}/{p}" for p in gone] + [self._path(v) for v in old]:
            delete_path(self.spark, path)
        return len(gone)

    def _read(self, shards: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.manifest()["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the highest version, or of one that is still kept. A table must have been appended to before."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError(f"there is no table in {self.root}")
        return self._read(held["shards"])


def content_digest(df: DataFrame) -> DataFrame:
    """One row per document read: its id, labels, length and the MD5 of its text."""
    return df.select("doc_id", "source", "lang", F.length("text").cast("long").alias("text_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
