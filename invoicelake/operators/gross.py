"""Expense invoices as one entry by their gross total, for clients who don't deduct VAT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import numbers, texts

_CLEARED = ("pct_iva", "cuota_iva", "base_requiv", "pct_requiv", "cuota_requiv")


def collapse(lines: DataFrame) -> DataFrame:
    """Sales stay. Expenses with withholding stay and get a warning. Others become their first line with the gross total as base."""
    per = lines.groupBy("doc_seq").agg(
        (F.sum(F.coalesce("base_iva", F.lit(0.0)) + F.coalesce("cuota_iva", F.lit(0.0))) + F.sum(F.coalesce("cuota_requiv", F.lit(0.0)))).alias("_gross"),
        F.max(F.coalesce("cuota_irpf", F.lit(0.0)) != 0).alias("_held"),
    )
    df = lines.join(per, "doc_seq")
    expense = F.col("tipo") == "gasto"
    one = expense & ~F.col("_held")
    df = df.filter(~one | (F.col("line_no") == 0)).withColumn("_one", one)
    df = df.withColumn("aviso", F.when(expense & F.col("_held"), texts.added(F.col("aviso"), F.lit(M.WARN_WITHHOLDING))).otherwise(F.col("aviso")))
    df = df.withColumn("base_iva", F.when(F.col("_one"), numbers.round2(F.col("_gross"))).otherwise(F.col("base_iva")))
    for c in _CLEARED:
        df = df.withColumn(c, F.when(~F.col("_one"), F.col(c)))
    return df.select(*lines.columns)


def lines_of_invoice(lines: DataFrame) -> DataFrame:
    """``lineas_factura`` counted anew, for tables that don't carry it."""
    return lines.withColumn("lineas_factura", F.count("*").over(W.partitionBy("doc_seq")).cast("int"))
