"""What goes into a cell of the sheet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, numbers, taxid

# The fields of the model that are amounts and percentages.
AMOUNTS = ("base_iva", "cuota_iva", "base_irpf", "cuota_irpf", "base_requiv", "cuota_requiv", "base_sujeta_cero", "suplidos", "no_sujeta")
PERCENTAGES = ("pct_iva", "pct_irpf", "pct_requiv")


def column_index(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27"""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def cell_value(field: str, c: Column, mode: str = "texto") -> Column:
    """The cell's text, or null where it stays unwritten. Mode "numero" gives numbers with two decimals at most, "texto" texts with a comma."""
    if field == "nif":
        out = taxid.normalize(c)
    elif field == "nombre":
        out = names.trimmed(c)
    elif field in AMOUNTS or field in PERCENTAGES:
        x = c.cast("double")
        out = numbers.round2(x).cast("string") if mode == "numero" else numbers.percent_text(x) if field in PERCENTAGES else numbers.amount_text(x)
    else:
        out = c.cast("string")
    return F.when(c.isNotNull() & (c.cast("string") != ""), out)
