"""Extraction through the cache: pages are asked for once, whatever fails meanwhile.

Pages that the cache has aren't asked for. Each task writes the answers of its other pages to the cache in slices, and what it has when a client fails or
refuses; a task that runs again reads its own earlier slices and goes on behind them. So a batch that breaks off at page k of a task has that task's
first k - 1 pages in the cache, and the next run asks for the rest alone. Pages that stay unreadable get a placeholder and aren't cached.

All tasks of a run wait out of one budget: each wait is noted in the run's folder, and once the notes add up to it, pages that would have to wait are given
up. Notes are read before a wait, so tasks that begin to wait at once may exceed it by one wait each.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import stage
from . import files, records, remote

#: Up to so many keys of known pages are sent to every executor.
BROADCAST_KEYS = 500_000


class Budget:
    """Seconds that the tasks of a run may wait in all."""

    def __init__(self, folder: str, seconds: float | None):
        self.folder, self.seconds = f"{folder}/_waits", seconds

    def used(self) -> float:
        store, root = remote.located(self.folder)
        return sum(int(f.base_name.partition("-")[0]) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name[0] != ".") / 1000

    def wait(self, seconds: float) -> bool:
        """Waits, or says that no time is left."""
        if self.seconds is not None:
            if self.used() + seconds > self.seconds:
                return False
            remote.write(f"{self.folder}/{round(seconds * 1000)}-{uuid.uuid4().hex}", b"")
        time.sleep(seconds)
        return True


class Slices:
    """A task's own answers in the run's folder."""

    def __init__(self, folder: str, task: int, pages: int):
        self.prefix, self.pages = f"part-{task:06d}-", pages
        self.folder, self.new = folder, []
        store, root = remote.located(folder)
        mine = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(self.prefix))
        self.next = len(mine)
        self.answers = {r["clave"]: r["texto"] for p in mine for r in map(json.loads, remote.read(p, store).decode().splitlines())}

    def add(self, key: str, text: str) -> None:
        self.new.append({"clave": key, "texto": text})
        if len(self.new) >= self.pages:
            self.flush()

    def flush(self) -> None:
        if self.new:
            content = "".join(json.dumps(r) + "\n" for r in self.new).encode()
            remote.write(f"{self.folder}/{self.prefix}{self.next:06d}.json", content)
            self.next, self.new = self.next + 1, []


def extract(pages: DataFrame, client: files.Client, models: tuple[str, ...], cache: str, *, slice_pages: int = 8, asks: int = 3, tries: int = 3, wait: float = 2.0, budget: float | None = None) -> DataFrame:
    """pages (doc_seq, origen, pagina, imagen) -> (doc_seq, origen, pagina, texto, _error), stored, for all of them. ``cache`` is a folder that all executors can
    write to. Pages of one file name and number share an entry; pages without an image, or either, are errors."""
    run = f"{cache.rstrip('/')}/run-{uuid.uuid4().hex}"
    held = records.read_cache(pages.sparkSession, cache)
    schema = pa.schema([("doc_seq", pa.int64()), ("origen", pa.string()), ("pagina", pa.int32()), ("texto", pa.string()), ("_error", pa.string())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, waits = Slices(run, TaskContext.get().partitionId(), slice_pages), Budget(run, budget)
        try:
            for b in batches:
                out = []
                for seq, name, page, image, key in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_seq", "origen", "pagina", "imagen", "clave"))):
                    text, error = mine.answers.get(key), None
                    if text is None and image is None:
                        error = "no image"
                    elif text is None:
                        text, error = files.ask_page(client, models, image, page, asks=asks, tries=tries, wait=wait, pause=waits.wait)
                        if text is not None and name is not None and page is not None:
                            mine.add(key, text)
                            mine.answers[key] = text
                    out.append((seq, name, page, text or files.PLACEHOLDER, error))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)
        finally:
            mine.flush()  # what a client answered before it failed

    columns = "doc_seq long, origen string, pagina int, texto string, _error string"
    keyed = pages.select("doc_seq", "origen", "pagina", "imagen")
    known = stage(keyed.select("doc_seq", "origen", "pagina", F.concat_ws("#", "origen", "pagina").alias("clave")).join(held, "clave"))
    keys = known.select("clave").distinct()  # images stay where they are, unless very many pages are known
    rest = records.uncached(keyed, F.broadcast(keys) if known.count() <= BROADCAST_KEYS else keys)
    asked = stage(rest.sortWithinPartitions("doc_seq", "pagina").mapInArrow(ask, columns))
    return stage(asked.unionByName(known.select("doc_seq", "origen", "pagina", "texto", F.lit(None).cast("string").alias("_error"))), asked, known)

