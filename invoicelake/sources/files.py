"""Scanned files: listing, pages, extraction by a client that callers plug in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..messages import UNREADABLE
from ..stages import row_numbers

# The extensions that are invoices, and words of a refusal to go on without payment.
EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
BILLING_WORDS = ("credit", "billing", "depleted")
TRANSIENT_WORDS = ("503", "429", "unavailable")
#: Longest side in pixels, and JPEG quality, that an image is brought down to before it is sent.
MAX_SIDE, QUALITY = 2000, 80
Client = Callable[[str, bytes], str]


def wanted(paths: DataFrame, col: str = "path") -> DataFrame:
    """Rows whose path has an invoice's extension."""
    return paths.filter(F.lower(F.regexp_extract(col, r"[.]([^./]+)$", 1)).isin(*EXTENSIONS))


def local_paths(urls: list[str]) -> list[str]:
    """Dropped or listed URLs to local paths with an invoice's extension."""
    paths = [u.removeprefix("file://") for u in urls if u.startswith(("file://", "/"))]
    return [p for p in paths if p.rpartition(".")[2].lower() in EXTENSIONS]


def import_arguments(argv: list[str]) -> list[str]:
    """The files behind --import."""
    return argv[argv.index("--import") + 1 :] if "--import" in argv else []


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_seq, origen, content) of the invoice files of a folder; doc_seq follows the paths' order."""
    files = wanted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("origen"), "content")
    order = row_numbers(files.select("path"), ["path"], "doc_seq")
    return named.join(order, "path").select("doc_seq", "origen", "content")


def pages(files: DataFrame, render: Callable[[bytes, int], list[bytes]], dpi: int = 150, normalise: Callable[[bytes, int, int], bytes] | None = None) -> DataFrame:
    """One row per page: PDFs through ``render`` (content, dpi) -> images; other files are page 1, through ``normalise`` (image, MAX_SIDE, QUALITY)
    -> a JPEG in RGB or grey, no side longer, where it is given. Both are plug-ins: no imaging library is at hand here."""
    schema = pa.schema([("doc_seq", pa.int64()), ("origen", pa.string()), ("pagina", pa.int32()), ("imagen", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seq, name, content in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_seq", "origen", "content"))):
                images = render(content, dpi) if name.lower().endswith(".pdf") else [normalise(content, MAX_SIDE, QUALITY) if normalise else content]
                for k, image in enumerate(images, 1):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((seq, name, k, image), schema.types)], schema=schema)

    return files.mapInArrow(run, "doc_seq long, origen string, pagina int, imagen binary")


class NoCredit(RuntimeError):
    """The client refuses for want of payment: the batch stops."""


def _ask(client: Client, models: tuple[str, ...], image: bytes, tries: int, wait: float, pause: Callable[[float], bool | None] = time.sleep) -> str:
    """``pause`` waits, or says False where no time is left: then the page is given up."""
    last: Exception | None = None
    for model in models:
        for k in range(tries):
            try:
                return client(model, image)
            except Exception as e:
                text, last = str(e).lower(), e
                if any(w in text for w in BILLING_WORDS):
                    raise NoCredit(str(e)) from e
                if not any(w in text for w in TRANSIENT_WORDS):
                    break
                if pause(wait * (k + 1)) is False:
                    raise
    raise last or ValueError("no models")


def ask_page(client: Client, models: tuple[str, ...], image: bytes, page: int, *, asks: int, tries: int, wait: float, pause: Callable[[float], bool | None] = time.sleep) -> tuple[str | None, str | None]:
    """(text, error): the client's JSON of one page, or why there is none. A refusal for want of payment is raised."""
    try:
        text = None
        for _ in range(asks):
            text = _ask(client, models, image, tries, wait, pause)
            if json_text.readable(text):
                return text, None
        return None, f"no JSON on page {page}: {(text or '')[:200]}"
    except NoCredit:
        raise
    except Exception as e:
        return None, str(e)


#: What stands for a page that can't be read.
PLACEHOLDER = f'{{"emisor_nombre": "{UNREADABLE}"}}'


def extract(images: DataFrame, client: Client, models: tuple[str, ...], *, asks: int = 3, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """(doc_seq, origen, pagina, texto, _error): the client's JSON text of each page. A page that stays unreadable becomes a
    placeholder with its error, and the batch goes on. Write the result to a table before using it: a task that is run again asks again
    (``cached.extract`` doesn't)."""
    schema = pa.schema([("doc_seq", pa.int64()), ("origen", pa.string()), ("pagina", pa.int32()), ("texto", pa.string()), ("_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, name, page, image in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_seq", "origen", "pagina", "imagen"))):
                text, error = ask_page(client, models, image, page, asks=asks, tries=tries, wait=wait)
                out.append((seq, name, page, text or PLACEHOLDER, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return images.mapInArrow(run, "doc_seq long, origen string, pagina int, texto string, _error string")
