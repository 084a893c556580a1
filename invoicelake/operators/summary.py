"""Counts and totals over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import dates, numbers, texts
from ..stages import row_numbers


def _total(c: str) -> Column:
    """Cents are summed as decimals: the sum doesn't depend on the order of the rows."""
    return F.coalesce(F.sum(numbers.fixed2(F.coalesce(F.col(c), F.lit(0.0))).cast("decimal(18,2)")), F.lit(0)).cast("double")


def totals(lines: DataFrame, *by: str) -> DataFrame:
    """lineas, base, iva, irpf, requiv, total, tiene_irpf, tiene_requiv for each group."""
    sums = lines.groupBy(*by).agg(F.count("*").alias("lineas"), _total("base_iva").alias("base"), _total("cuota_iva").alias("iva"), _total("cuota_irpf").alias("irpf"), _total("cuota_requiv").alias("requiv"))
    total = numbers.round2(F.col("base") + F.col("iva") + F.col("requiv") - F.col("irpf"))
    return sums.withColumn("total", total).withColumn("tiene_irpf", F.abs("irpf") > 0.005).withColumn("tiene_requiv", F.abs("requiv") > 0.005)


def described(only_total: bool = False) -> Column:
    """A row of ``totals`` as text."""
    e = lambda c: numbers.euros(F.col(c))
    if only_total:
        text = F.concat(F.lit("total factura "), e("total"))
    else:
        text = F.concat_ws("  ·  ", F.concat(F.lit("base "), e("base")), F.concat(F.lit("IVA "), e("iva")), F.when(F.col("tiene_requiv"), F.concat(F.lit("recargo "), e("requiv"))), F.when(F.col("tiene_irpf"), F.concat(F.lit("IRPF −"), e("irpf"))), F.concat(F.lit("total factura "), e("total")))
    return F.when(F.col("lineas") == 0, "—").otherwise(text)


def state_counts(lines: DataFrame) -> DataFrame:
    """One row: lines of each state and type."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return lines.agg(F.count("*").alias("total"), count("estado", "ok").alias("ok"), count("estado", "revisar").alias("revisar"), count("estado", "error").alias("error"), count("tipo", "gasto").alias("gastos"), count("tipo", "venta").alias("ventas"))


def outside(lines: DataFrame, p: int) -> DataFrame:
    """One row: lines of another quarter, or of none."""
    return lines.agg(F.count_if(~dates.period(F.col("fecha")).eqNullSafe(F.lit(p))).alias("fuera"))


def export_problems(lines: DataFrame, p: int) -> DataFrame:
    """One row: duplicates, lines whose own rules fail, lines out of the quarter."""
    return lines.agg(F.count_if(F.col("dup_doc").isNotNull()).alias("duplicadas"), F.count_if(F.col("estado") == "error").alias("errores"), F.count_if(~dates.period(F.col("fecha")).eqNullSafe(F.lit(p))).alias("fuera"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with ``fila``, from 0 in batch order."""
    return row_numbers(lines, ["doc_seq", "line_no"], "fila")


def in_state(lines: DataFrame, state: str | None = None) -> DataFrame:
    """The lines of one state, or all."""
    return lines if state is None else lines.filter(F.col("estado") == state)


def report(lines: DataFrame) -> DataFrame:
    """What a run prints at its end: lines and base of each type, as text."""
    sums = totals(lines, "tipo")
    base = F.format_string("%.2f", F.col("base"))
    return sums.select("tipo", "lineas", "base", F.concat(F.initcap("tipo"), F.lit("s: "), F.col("lineas").cast("string"), F.lit(" lineas, base "), base).alias("texto"))


def batch_label(files: DataFrame, col: str = "path", most: int = 3) -> DataFrame:
    """One row (texto): how many files a batch has, and the names of the first ``most`` by path."""
    name = F.regexp_extract(F.col(col), r"([^/]+)$", 1)
    first = files.select(col, name.alias("nombre")).orderBy(col).limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col, "nombre"))), lambda s: s["nombre"]), ", ").alias("nombres"))
    n = files.agg(F.count("*").alias("n"))
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " archivo: ").otherwise(" archivos: "), F.col("nombres"), F.when(F.col("n") > most, "…").otherwise(""))
    return n.join(F.broadcast(first), F.lit(True)).select(text.alias("texto"))


def next_incident(rows: DataFrame, current: int) -> DataFrame:
    """rows (fila, estado): the first line that isn't ok after the current one, going round; no row if all are."""
    n = rows.agg(F.max("fila") + 1).first()[0] or 1
    return rows.filter("estado <> 'ok'").orderBy(F.expr(f"pmod(fila - {current + 1}, {n})")).limit(1)


def alerts(rows: DataFrame, most: int = 6) -> DataFrame:
    """rows (fila, dup_fila, num_factura, nombre, sustituida): the first ``most`` alerts, duplicates first, and the number of all."""
    named = dict(row=F.col("fila") + 1, num=F.coalesce(texts.present(F.col("num_factura")), F.lit("?")), name=F.coalesce(texts.present(F.col("nombre")), F.lit("?")))
    dup = rows.filter("dup_fila is not null").select(F.lit(0).alias("clase"), "fila", texts.filled(M.ALERT_DUPLICATE, first=F.col("dup_fila") + 1, **named).alias("texto"))
    rep = rows.filter("sustituida").select(F.lit(1).alias("clase"), "fila", texts.filled(M.ALERT_REPLACED, **named).alias("texto"))
    every = dup.unionByName(rep)
    count = every.agg(F.count("*").alias("avisos"))
    return every.orderBy("clase", "fila").limit(most).join(F.broadcast(count), F.lit(True))
