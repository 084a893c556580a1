"""Scanned files as a Spark data source of pages: format ``escaneos``.

Planning lists the folder and opens no file. A PDF is cut into as many ranges of pages as its bytes suggest; each task counts the pages itself and renders its own
range, so that a long PDF is the work of many tasks. Small files share a task. Filters on path, name and extension are applied to the listing:
files that they rule out are never opened. Images are rendered only where the schema asks for them.

The renderer is a plug-in, named as module:function, since no imaging library is at hand: count(content) -> pages, and
render(content, first, last, dpi) -> images of those pages, counted from 1; normalise(image, MAX_SIDE, QUALITY) -> a JPEG, for other files.
A file that can't be read or counted gives one row, page 1, with the reason in ``error``; so does a page that can't be rendered.
"""

from __future__ import annotations

import importlib
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from . import remote
from .files import EXTENSIONS, MAX_SIDE, QUALITY

SCHEMA = "doc_seq long, path string, origen string, extension string, pagina int, paginas int, imagen binary, error string"
#: Bytes that a page of a PDF is taken to have, pages of one task, bytes of small files that share a task.
PAGE_BYTES, TASK_PAGES, TASK_BYTES = 100_000, 16, 8 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def plugin(name: str | None) -> Callable | None:
    """The function that module:function names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Piece:
    """One of ``of`` equal ranges of a file's pages."""

    doc_seq: int
    path: str
    part: int
    of: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)


def _fits(filters: list[Filter], path: str) -> bool:
    values = {"path": path, "origen": posixpath.basename(path), "extension": path.rpartition(".")[2].lower()}
    for f in filters:
        v = values[f.attribute[0]]
        if isinstance(f, EqualTo):
            good = v == f.value
        elif isinstance(f, In):
            good = v in f.value
        elif isinstance(f, StringStartsWith):
            good = v.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            good = v.endswith(f.value)
        else:
            good = f.value in v
        if not good:
            return False
    return True


class PageReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.count, self.render, self.normalise = (options.get(k) for k in ("count", "render", "normalise"))
        self.dpi = int(options.get("dpi", 150))
        self.page_bytes, self.task_pages, self.task_bytes = (int(options.get(k, d)) for k, d in (("pageBytes", PAGE_BYTES), ("taskPages", TASK_PAGES), ("taskBytes", TASK_BYTES)))
        self.filters: list[Filter] = []

    def partitions(self) -> list[Pieces]:
        out, small, held = [], [], 0
        files = [(p, n) for p, n in remote.listed(self.path) if p.rpartition(".")[2].lower() in EXTENSIONS]
        for seq, (path, size) in enumerate(files):  # numbers don't depend on filters
            if not _fits(self.filters, path):
                continue
            of = -(-size // (self.page_bytes * self.task_pages)) if path.lower().endswith(".pdf") else 1
            if of > 1:
                out += [Pieces([Piece(seq, path, k, of)]) for k in range(of)]
                continue
            small.append(Piece(seq, path, 0, 1))
            held += size
            if held >= self.task_bytes:
                out.append(Pieces(small))
                small, held = [], 0
        if small or not out:
            out.append(Pieces(small))
        return out

    def read(self, partition: Pieces) -> Iterator[tuple]:
        store, _ = remote.located(self.path)
        imaged = "imagen" in self.columns
        count, render, normalise = plugin(self.count), plugin(self.render if imaged else None), plugin(self.normalise if imaged else None)
        for piece in partition.value:
            for page, pages, image, error in self._pages(piece, store, count, render, normalise):
                row = {"doc_seq": piece.doc_seq, "path": piece.path, "origen": posixpath.basename(piece.path), "extension": piece.path.rpartition(".")[2].lower(), "pagina": page, "paginas": pages, "imagen": image, "error": error}
                yield tuple(row[c] for c in self.columns)

    def _pages(self, piece: Piece, store, count, render, normalise) -> Iterator[tuple]:
        wanted = "imagen" in self.columns
        try:
            pdf = piece.path.lower().endswith(".pdf")
            content = remote.read(piece.path, store) if pdf or wanted else b""
            pages = count(content) if pdf else 1
        except Exception as e:
            if not piece.part:
                yield 1, None, None, str(e) or type(e).__name__
            return
        for page in range(piece.part * pages // piece.of + 1, (piece.part + 1) * pages // piece.of + 1):
            image = error = None
            if wanted:
                try:
                    image = render(content, page, page, self.dpi)[0] if pdf else normalise(content, MAX_SIDE, QUALITY) if normalise else content
                except Exception as e:
                    error = str(e) or type(e).__name__
            yield page, pages, image, error


class FilteringPageReader(PageReader):
    """Where the session lets filters through to Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute[0] in ("path", "origen", "extension") and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f


class PageSource(DataSource):
    """Options: path, count, render, normalise, dpi, pageBytes, taskPages, taskBytes, pushdown (true where the session has it on)."""

    @classmethod
    def name(cls) -> str:
        return "escaneos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        unknown = [f.name for f in schema.fields if f"{f.name} " not in f"{SCHEMA.replace(', ', ' , ')} "]
        if unknown:
            raise ValueError(f"pages have no {', '.join(unknown)}")
        kind = FilteringPageReader if self.options.get("pushdown", "false") == "true" else PageReader
        return kind(self.options, [f.name for f in schema.fields])


def pages(spark: SparkSession, path: str, *, columns: list[str] | None = None, **options: object) -> DataFrame:
    """The pages of the invoice files at ``path``, with ``columns`` alone: without imagen nothing is rendered. Filters reach the listing if the session has
    spark.sql.python.filterPushdown.enabled; else Spark applies them to the rows."""
    spark.dataSource.register(PageSource)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    wanted = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    reader = spark.read.format("escaneos").schema(wanted).option("path", path).option("pushdown", spark.conf.get(_PUSHDOWN, "false").lower())
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
