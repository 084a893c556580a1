"""What a person changes in the grid: cells, types, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers

# The cells that can be edited; the last five are amounts.
EDITABLE = ("concepto", "fecha", "num_factura", "nombre", "nif", "base_iva", "pct_iva", "cuota_iva", "total_impreso")
_AMOUNTS = EDITABLE[5:]


def apply(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (doc_seq, line_no, campo, valor, and orden where there is more than one edit of a cell): typed texts replace cells; ``campo`` tipo
    overrides the type, with nothing derived anew. Of several edits of a cell that of the highest ``orden`` holds, of equals the greatest text."""
    order = [F.col(c) for c in ("orden", "valor") if c in edits.columns]
    wide = edits.groupBy("doc_seq", "line_no").pivot("campo", [*EDITABLE, "tipo"]).agg(F.max_by("valor", F.struct(*order)))
    wide = wide.select("doc_seq", "line_no", *(F.col(c).alias(f"_e_{c}") for c in [*EDITABLE, "tipo"]))
    out = lines.join(wide, ["doc_seq", "line_no"], "left")
    for c in [*EDITABLE, "tipo"]:
        new = numbers.parse_typed_number(F.col(f"_e_{c}")) if c in _AMOUNTS else F.col(f"_e_{c}")
        out = out.withColumn(c, F.when(F.col(f"_e_{c}").isNotNull(), new).otherwise(F.col(c)))
    return out.select(*lines.columns)


def as_shown(lines: DataFrame) -> DataFrame:
    """Amounts as the grid holds them, after a round trip through two decimals."""
    return lines.withColumns({c: numbers.round2(F.col(c)) for c in _AMOUNTS})


def without_rows(lines: DataFrame, rows: DataFrame) -> DataFrame:
    return lines.join(rows.select("doc_seq", "line_no"), ["doc_seq", "line_no"], "left_anti")


def restored(lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """The last deleted rows come back behind all others: they get the document numbers that follow the highest."""
    top = lines.agg(F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("_top"))
    back = deleted.join(F.broadcast(top), F.lit(True)).withColumn("doc_seq", F.col("doc_seq") + F.col("_top") + 1).drop("_top")
    return lines.unionByName(back)
