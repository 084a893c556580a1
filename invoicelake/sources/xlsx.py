"""The parts of a workbook with one sheet, and workbooks by type."""

from __future__ import annotations

from pyspark.sql import DataFrame

SHEET = "Facturas"
#: A sheet can't hold more rows; a table beyond is many workbooks, or not a sheet.
MAX_ROWS = 1_048_576
_PACK = "http://schemas.openxmlformats.org/package/2006"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def parts(rows: str) -> dict[str, str]:
    """The archive's files, by name; ``rows`` is what stands in the sheet."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_DOC}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>',
    }


def write(cells: DataFrame, path: str, mode: str = "texto") -> None:
    """A sheet's cells (fila, columna, letra, valor, formato) as a workbook. Tasks write its parts (``sheet_writer``); more than MAX_ROWS rows are an error."""
    from . import sheet_writer

    sheet_writer.write(cells, path, mode)


def write_by_type(sheets: dict[str, DataFrame], folder: str, names: dict[str, str] | None = None) -> list[str]:
    """One workbook for each type that has rows; a type without rows writes nothing."""
    names = names or {"gasto": "gastos.xlsx", "venta": "ingresos.xlsx"}
    out = []
    for kind, cells in sheets.items():
        if cells.filter("fila > 1").limit(1).count():
            write(cells, path := f"{folder}/{names[kind]}")
            out.append(path)
    return out
