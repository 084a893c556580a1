"""A workbook as a Spark sink: tasks write compressed fragments of the sheet, a commit joins them into one file.

A workbook is a zip archive, and its sheet one deflate stream. Each task compresses its rows as a piece of that stream that ends on a byte and refers to
nothing before it, and tells the commit where its rows begin, how long the piece is, and its CRC. The commit copies the pieces, in the order of rows, between
the sheet's head and foot, and computes the CRC of the whole from those of the pieces. So no row passes the driver, only compressed bytes, a
bounded buffer at a time; a lost task's fragment isn't in any commit message and goes with the folder of fragments.

    spark.dataSource.register(SheetSource)
    by_rows(cells).write.format("hoja").mode("overwrite").option("path", path).save()
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import remote, xlsx

#: Rows of one fragment's buffer, and bytes that the commit copies at a time.
BUFFER = 1 << 20
_SHEET = "xl/worksheets/sheet1.xml"


def crc_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts in a row, from their own and the second's length: the first one's register is moved on by as many zero bytes, each
    doubling of which is a matrix over bits."""
    if not length:
        return first

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for k in range(32):
            if vector >> k & 1:
                out ^= matrix[k]
        return out

    matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]  # one zero byte
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second


@dataclass
class Fragment(WriterCommitMessage):
    path: str
    first: int
    last: int
    rows: int
    size: int
    plain: int
    crc: int


def _cell(row: int, letters: str, value: str, style: str | None, numeric: bool) -> str:
    if numeric and row > 1 and value.replace(".", "", 1).lstrip("-").isdigit() and "." in value:
        return f'<c r="{letters}{row}"><v>{value}</v></c>'
    return f'<c r="{letters}{row}" t="inlineStr"{" s=\"1\"" if style == "@" else ""}><is><t xml:space="preserve">{escape(value)}</t></is></c>'


class SheetWriter(DataSourceArrowWriter):
    """Rows (fila, columna, letra, valor, formato), sorted within tasks, no fila in two tasks (``by_rows``)."""

    def __init__(self, path: str, numeric: bool):
        self.path, self.numeric = path, numeric
        folder, name = posixpath.split(path.rstrip("/"))
        self.fragments = f"{folder}/_{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragment:
        path = f"{self.fragments}/{uuid.uuid4().hex}"  # an attempt's own
        packed, crc, plain, rows, size = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0, 0
        first = last = 0
        store, target = remote.located(path)
        store.create_dir(posixpath.dirname(target), recursive=True)
        with store.open_output_stream(target) as f:
            held: list[str] = []

            def flush() -> None:
                nonlocal crc, plain, size
                text = "".join(held).encode()
                held.clear()
                crc, plain = zlib.crc32(text, crc), plain + len(text)
                size += f.write(packed.compress(text))

            for b in iterator:
                columns = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("fila", "letra", "valor", "formato")}
                for row, letters, value, style in zip(*columns.values()):
                    if row != last:
                        if row > xlsx.MAX_ROWS or row < last:
                            raise ValueError("more rows than a sheet can hold" if row > xlsx.MAX_ROWS else "rows have to be sorted: use by_rows")
                        held.append(("</row>" if rows else "") + f'<row r="{row}">')
                        first, last, rows = first or row, row, rows + 1
                    held.append(_cell(row, letters, value, style, self.numeric))
                if len(held) > 20_000:
                    flush()
            if rows:
                held.append("</row>")
            flush()
            size += f.write(packed.flush(zlib.Z_FULL_FLUSH))  # ends on a byte, and isn't the stream's end
        return Fragment(path, first, last, rows, size, plain, crc)

    def commit(self, messages: list[Fragment | None]) -> None:
        try:
            parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
            for a, b in zip(parts, parts[1:]):
                if b.first <= a.last:
                    raise ValueError("a row is in two tasks: use by_rows")
            self._join(parts)
        finally:
            remote.delete_folder(self.fragments)

    def abort(self, messages: list[Fragment | None]) -> None:
        remote.delete_folder(self.fragments)

    def _join(self, parts: list[Fragment]) -> None:
        store, target = remote.located(self.path)
        store.create_dir(posixpath.dirname(target), recursive=True)
        own = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            out = _Zip(f)
            for name, text in xlsx.parts("").items():
                if name != _SHEET:
                    out.stored(name, text.encode())
            head, foot = xlsx.parts("\x00")[_SHEET].encode().split(b"\x00")
            out.begin(_SHEET)
            out.piece(*_packed(head))
            for m in parts:
                source, place = remote.located(m.path)
                with source.open_input_stream(place) as fragment:
                    while chunk := fragment.read(BUFFER):
                        out.copy(chunk)
                out.account(m.crc, m.plain)
            out.piece(*_packed(foot))
            out.copy(zlib.compressobj(6, zlib.DEFLATED, -15).flush(zlib.Z_FINISH))  # an empty last block
            out.end()
            out.close()
        store.move(own, target)


def _packed(text: bytes) -> tuple[bytes, int, int]:
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packed.compress(text) + packed.flush(zlib.Z_FULL_FLUSH), zlib.crc32(text), len(text)


class _Zip:
    """An archive written front to back: sizes that aren't known at an entry's beginning stand behind it. 64-bit sizes throughout."""

    def __init__(self, f):
        self.f, self.at = f, 0
        self.directory: list[bytes] = []

    def _write(self, b: bytes) -> None:
        self.f.write(b)
        self.at += len(b)

    def begin(self, name: str) -> None:
        self.name, self.start = name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x0808, 8, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)
        self.data, self.crc, self.plain = self.at, 0, 0

    def copy(self, packed: bytes) -> None:
        self._write(packed)

    def account(self, crc: int, plain: int) -> None:
        self.crc, self.plain = crc_joined(self.crc, crc, plain), self.plain + plain

    def piece(self, packed: bytes, crc: int, plain: int) -> None:
        self.copy(packed)
        self.account(crc, plain)

    def end(self) -> None:
        size = self.at - self.data
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, size, self.plain))
        extra = struct.pack("<HHQQQ", 1, 24, self.plain, size, self.start)
        self.directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x0808, 8, 0, 0x21, self.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + self.name + extra)

    def stored(self, name: str, content: bytes) -> None:
        self.begin(name)
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        self.copy(packed.compress(content) + packed.flush())
        self.account(zlib.crc32(content), len(content))
        self.end()

    def close(self) -> None:
        start = self.at
        for entry in self.directory:
            self._write(entry)
        size, n, end = self.at - start, len(self.directory), self.at
        self._write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class SheetSource(DataSource):
    """Format ``hoja``. Options: path, of the file; mode, texto or numero."""

    @classmethod
    def name(cls) -> str:
        return "hoja"

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        if not {"fila", "letra", "valor", "formato"} <= {f.name for f in schema.fields}:
            raise ValueError("a sheet's cells have fila, letra, valor and formato")
        return SheetWriter(self.options["path"], self.options.get("mode", "texto") == "numero")


def by_rows(cells: DataFrame) -> DataFrame:
    """Cells dealt out by ranges of rows, sorted: how the writer wants them. Cells without a row or a value are left out."""
    return cells.filter("fila is not null and letra is not null and valor is not null").repartitionByRange("fila").sortWithinPartitions("fila", "columna")


def write(cells: DataFrame, path: str, mode: str = "texto") -> None:
    """A sheet's cells (fila, columna, letra, valor, formato) as a workbook at any path that Arrow's file systems know. No cells give a sheet without rows."""
    cells.sparkSession.dataSource.register(SheetSource)
    by_rows(cells).write.format("hoja").mode("overwrite").option("path", path).option("mode", mode).save()
