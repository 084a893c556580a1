"""The sheet as a table of cells, laid out by a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import cells, numbers
from ..schema import FIELDS
from ..stages import release, stage
from .summary import numbered


def exported(lines: DataFrame) -> DataFrame:
    """The fields that are exported."""
    return lines.select("doc_seq", "line_no", *FIELDS)


def grid_view(lines: DataFrame) -> DataFrame:
    """What the grid shows, with formatted amounts."""
    t = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return lines.select("doc_seq", "line_no", t("tipo"), t("concepto"), t("gxx"), t("fecha"), t("num_factura"), t("nombre"), t("nif"), *(numbers.cell_text(F.col(c)).alias(c) for c in ("base_iva", "pct_iva", "cuota_iva", "total_impreso")))


def header_label(field: Column) -> Column:
    pairs = [F.lit(x) for kv in M.HEADERS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), field), field)


def by_letter(layout: DataFrame) -> DataFrame:
    """The columns in use, by their letters as texts (AA comes before B)."""
    return layout.filter("letra <> ''").orderBy("letra")


def sheet(lines: DataFrame, layout: DataFrame, mode: str = "texto") -> DataFrame:
    """(fila, columna, letra, valor, formato): header cells in row 1 if the layout has them, one row for each line from its first row on.
    Null and empty fields leave no cell; numbers as texts get the format @."""
    fields = ", ".join(f"'{f}', _v_{f}" for f in FIELDS)
    # stored first: the ranges for numbers are drawn from a run of their own
    kept = stage(lines.select("doc_seq", "line_no", *FIELDS))
    rows = numbered(kept)
    release(kept)
    rows = rows.select("fila", *(cells.cell_value(f, F.col(f), mode).alias(f"_v_{f}") for f in FIELDS))
    long = rows.select("fila", F.expr(f"stack({len(FIELDS)}, {fields}) as (campo, valor)")).filter("valor is not null")
    placed = layout.filter("letra <> ''")
    body = long.join(placed, "campo").select((F.col("fila") + F.col("primera_fila")).cast("long").alias("fila"), "letra", "valor", F.when(F.lit(mode == "texto") & F.col("campo").isin(*cells.AMOUNTS, *cells.PERCENTAGES), "@").alias("formato"))
    head = placed.filter("incluye_cabecera").select(F.lit(1).cast("long").alias("fila"), "letra", header_label(F.col("campo")).alias("valor"), F.lit(None).cast("string").alias("formato"))
    return head.unionByName(body).withColumn("columna", cells.column_index(F.col("letra"))).select("fila", "columna", "letra", "valor", "formato")
