"""Rules for each line, and a three-level state."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import dates, numbers, taxid, texts

TOLERANCE = 0.02
OK, REVIEW, ERROR = 0, 1, 2
# The names of the states, by severity.
STATES = ("ok", "revisar", "error")


def _rules(period: Column | None, own: Column) -> list[tuple[int, int, Column, Column]]:
    """(rule, severity, hit, message) in the order of the rules. ``own``: the line's quarter."""
    c, have, zero = F.col, lambda n: F.coalesce(F.col(n) != "", F.lit(False)), F.lit(0.0)
    p = F.lit(None).cast("long") if period is None else period
    text = lambda n: numbers.plain_text(c(n))
    dated = have("fecha") & p.isNotNull()
    vat = numbers.round2(c("base_iva") * c("pct_iva") / 100.0)
    held = numbers.round2(c("base_irpf") * c("pct_irpf") / 100.0)
    priced = c("base_iva").isNotNull() & c("pct_iva").isNotNull()
    whole = c("total_impreso").isNotNull() & c("base_iva").isNotNull() & (c("lineas_factura") == 1)
    due = numbers.round2(F.coalesce("base_iva", zero) + F.coalesce("cuota_iva", zero) + F.coalesce("cuota_requiv", zero) - F.coalesce("cuota_irpf", zero))
    return [
        (1, ERROR, ~have("fecha"), F.lit(M.NO_DATE)),
        (2, REVIEW, dated & own.isNull(), texts.filled(M.ODD_DATE, fecha=c("fecha"))),
        (3, REVIEW, dated & (own != p), texts.filled(M.OTHER_PERIOD, period=dates.period_text(p), own=dates.period_text(own), fecha=c("fecha"))),
        (4, ERROR, ~have("num_factura"), F.lit(M.NO_NUMBER)),
        (5, ERROR, ~have("nombre"), F.lit(M.NO_NAME)),
        (6, ERROR, ~have("concepto"), F.lit(M.NO_CONCEPT)),
        (7, REVIEW, ~have("nif"), F.lit(M.NO_ID)),
        (8, REVIEW, have("nif") & ~taxid.is_valid(c("nif")), texts.filled(M.ODD_ID, nif=c("nif"))),
        (9, REVIEW, priced & c("cuota_iva").isNull(), F.lit(M.NO_VAT)),
        (10, ERROR, priced & (F.abs(c("cuota_iva") - vat) > TOLERANCE), texts.filled(M.ODD_VAT, cuota=text("cuota_iva"), due=numbers.plain_text(vat))),
        (11, ERROR, c("cuota_irpf").isNotNull() & (F.abs(c("cuota_irpf") - held) > TOLERANCE), texts.filled(M.ODD_WITHHOLDING, cuota=text("cuota_irpf"), due=numbers.plain_text(held))),
        (12, ERROR, whole & ((c("total_impreso") < 0) != (c("base_iva") < 0)), texts.filled(M.ODD_SIGN, total=text("total_impreso"), base=text("base_iva"))),
        (13, REVIEW, whole & (F.abs(due - c("total_impreso")) > TOLERANCE), texts.filled(M.ODD_TOTAL, total=text("total_impreso"), due=numbers.plain_text(due))),
    ]


def validate(lines: DataFrame, period: Column | None = None) -> DataFrame:
    """lines with ``issues``, array<struct<rule, severity, message>> in the order of the rules, and ``estado``. ``period``: the quarter of the batch;
    null checks none. The rules that hit are bits of a number, so each is judged once, and messages are written only where they are asked for."""
    known = lines.withColumn("_own", dates.period(F.col("fecha")))
    rules = _rules(period, F.col("_own"))
    hits = known.withColumn("_hits", reduce(add, (F.when(F.coalesce(hit, F.lit(False)), 1 << rule).otherwise(0) for rule, _, hit, _ in rules)))
    among = lambda bits: F.col("_hits").bitwiseAND(F.lit(bits)) != 0
    every = F.array(*(F.when(among(1 << rule), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text.alias("message"))) for rule, severity, _, text in rules))
    of = lambda s: sum(1 << rule for rule, severity, _, _ in rules if severity == s)
    state = F.when(among(of(ERROR)), STATES[ERROR]).when(among(of(REVIEW)), STATES[REVIEW]).otherwise(STATES[OK])
    return hits.withColumns({"issues": F.filter(every, lambda i: i.isNotNull()), "estado": state}).drop("_own", "_hits")


def final_state(lines: DataFrame) -> DataFrame:
    """With ``estado``, ``aviso`` and ``dup_doc``: a warning lifts ok to review, a duplicate is an error."""
    lifted = F.when(F.col("dup_doc").isNotNull(), STATES[ERROR]).when((F.col("estado") == STATES[OK]) & (F.coalesce("aviso", F.lit("")) != ""), STATES[REVIEW]).otherwise(F.col("estado"))
    return lines.withColumn("estado", lifted)
