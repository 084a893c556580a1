"""Raw records to invoices, one row for each VAT line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import names, numbers, taxid, texts
from ..schema import RAW_LINE
from . import rules

TOLERANCE = 0.02
_N = numbers.parse_number


def role(client_id: Column, client_name: Column) -> Column:
    """struct(tipo, nombre, nif, aviso): ids decide, names only where ids don't. The counterparty's id keeps its spelling."""

    def out(kind: str, side: str, warning: Column) -> Column:
        return F.struct(F.lit(kind).alias("tipo"), F.col(f"{side}_nombre").alias("nombre"), F.col(f"{side}_nif").alias("nif"), warning.alias("aviso"))

    def decide(s: Column) -> Column:
        quiet = F.lit("")
        return (
            F.when((s["e"] == s["c"]) & (s["r"] != s["c"]), out("venta", "receptor", quiet))
            .when((s["r"] == s["c"]) & (s["e"] != s["c"]), out("gasto", "emisor", quiet))
            .otherwise(texts.let(named, lambda n: by_name(s, n)))
        )

    def by_name(s: Column, n: Column) -> Column:
        return (
            F.when(n["is_e"] & ~n["is_r"], out("venta", "receptor", F.when(s["e"] == "", M.WARN_NO_ID).otherwise("")))
            .when(n["is_r"] & ~n["is_e"], out("gasto", "emisor", F.lit("")))
            .otherwise(out("gasto", "emisor", F.lit(M.WARN_ROLE)))
        )

    sides = F.struct(taxid.normalize(client_id).alias("c"), taxid.normalize(F.col("emisor_nif")).alias("e"), taxid.normalize(F.col("receptor_nif")).alias("r"))
    # names are cut into words only where ids don't decide
    named = F.struct(names.same_name(F.col("emisor_nombre"), client_name).alias("is_e"), names.same_name(F.col("receptor_nombre"), client_name).alias("is_r"))
    return texts.let(sides, decide)


def _account(kind: Column) -> tuple[Column, Column]:
    given = F.trim(F.coalesce(F.col("cuenta_gasto"), F.lit("")))
    text = F.concat_ws(" ", F.coalesce(F.col("concepto_texto"), F.lit("")), F.coalesce(F.col("emisor_nombre"), F.lit("")))
    account = F.when(kind == "venta", rules.DEFAULT_SALE).when(given != "", given).otherwise(rules.expense_account(text))
    sub = F.when(kind != "venta", F.coalesce(texts.present(F.col("subclave_gxx")), F.when(account == rules.SUPPLIES, rules.supplies_subcode(text))))
    return account, sub


def reconciliation(lines: Column, total: Column, withholding: Column) -> Column:
    """lines: array<struct<base, cuota_iva, cuota_re>> of numbers. A warning where two or more VAT lines don't add up to the printed total, before the lines are exploded; else empty."""
    zero = F.lit(0.0)
    part = lambda line: F.coalesce(line["base"], zero) + F.coalesce(line["cuota_iva"], zero) + F.coalesce(line["cuota_re"], zero)
    total_of = F.aggregate(lines, zero, lambda s, line: s + part(line)) - F.coalesce(withholding, zero)
    wrong = (F.size(lines) >= 2) & total.isNotNull() & (F.abs(numbers.round2(total_of) - total) > TOLERANCE)
    return F.when(wrong, texts.filled(M.WARN_SUM, total=numbers.fixed2(total), n=F.size(lines), sum=numbers.fixed2(total_of))).otherwise("")


def _amounts(line: Column) -> Column:
    """A VAT line's texts as numbers."""
    of = {"base": "base", "tipo_iva": "tipo_iva", "cuota_iva": "cuota_iva", "pct_re": "pct_requiv", "cuota_re": "cuota_requiv"}
    return F.struct(*(_N(line[c]).alias(name) for name, c in of.items()))


def _with_surcharge(line: Column, falls: Column) -> Column:
    """A line's numbers; with the record's surcharge where that falls to it."""
    surcharge = (F.when(falls, F.col(f"_{c}quiv")).otherwise(line[c]).alias(c) for c in ("pct_re", "cuota_re"))
    return F.struct(*(line[c].alias(c) for c in ("base", "tipo_iva", "cuota_iva")), *surcharge)


def build(raw: DataFrame, client: DataFrame) -> DataFrame:
    """Records (doc_seq, origen, pagina and the raw fields; all may be null) and the one-row client -> lines.

    A record without lines is one empty line. Line 0 owns the withholding, and the record's own surcharge where it has none itself.
    """
    one = client.limit(1).select(F.col("nombre").alias("_client_name"), F.col("nif").alias("_client_id"))
    df = raw.crossJoin(F.broadcast(one))
    df = df.withColumn("_role", role(F.col("_client_id"), F.col("_client_name")))
    account, sub = _account(F.col("_role.tipo"))
    df = df.withColumn("cuenta", account).withColumn("gxx", sub)
    size = F.greatest(F.coalesce(F.size("lineas_iva"), F.lit(0)), F.lit(1))
    # amounts are read once, before they are used: those of the record, and those of its lines with the surcharge that falls to line 0
    df = df.withColumns({"lineas_factura": size, "total_impreso": _N(F.col("total"))} | {f"_{c}": _N(F.col(c)) for c in ("base_irpf", "pct_irpf", "cuota_irpf", "base_requiv", "pct_requiv", "cuota_requiv")})
    df = df.withColumn("_read", F.transform("lineas_iva", _amounts))
    df = df.withColumn("_lines", F.transform("_read", lambda x, k: _with_surcharge(x, (k == 0) & x["pct_re"].isNull() & x["cuota_re"].isNull())))
    check = F.coalesce(reconciliation(F.col("_lines"), F.col("total_impreso"), F.col("_cuota_irpf")), F.lit(""))
    hand = F.when(F.coalesce(F.col("hay_anotaciones_manuscritas"), F.lit(False)), M.WARN_HANDWRITTEN).otherwise("")
    df = df.withColumn("aviso", texts.added(texts.added(F.col("_role.aviso"), check), hand))

    df = df.select("*", F.posexplode_outer("_lines").alias("_pos", "_line")).withColumn("line_no", F.coalesce("_pos", F.lit(0)))
    first, line, read = F.col("line_no") == 0, F.col("_line"), lambda c: F.col(f"_{c}")
    # a record without lines has no line to hold its surcharge
    bare = F.col("_pos").isNull()
    pct_re = F.when(bare, read("pct_requiv")).otherwise(line["pct_re"])
    cuota_re = F.when(bare, read("cuota_requiv")).otherwise(line["cuota_re"])
    base_re = F.when(pct_re.isNotNull() | cuota_re.isNotNull(), F.coalesce(F.when(F.col("lineas_factura") == 1, read("base_requiv")), line["base"]))
    keep = lambda c: texts.present(F.col(c))
    return df.select(
        "doc_seq", "line_no", keep("num_factura").alias("num_factura"), keep("fecha").alias("fecha"), keep("fecha_operacion").alias("fecha_operacion"), F.lit(None).cast("string").alias("fecha_deduccion"),
        keep("cuenta").alias("concepto"), line["base"].alias("base_iva"), line["tipo_iva"].alias("pct_iva"), line["cuota_iva"].alias("cuota_iva"),
        F.when(first, read("base_irpf")).alias("base_irpf"), F.when(first, read("pct_irpf")).alias("pct_irpf"), F.when(first, read("cuota_irpf")).alias("cuota_irpf"),
        base_re.alias("base_requiv"), pct_re.alias("pct_requiv"), cuota_re.alias("cuota_requiv"), texts.present(F.col("_role.nif")).alias("nif"), texts.present(F.col("_role.nombre")).alias("nombre"),
        *(F.lit(None).cast("string").alias(c) for c in ("descripcion_sii", "tipo_factura", "clave_reg_esp", "isp", "recc")), *(F.lit(None).cast("double").alias(c) for c in ("base_sujeta_cero", "suplidos", "no_sujeta")),
        "total_impreso", "lineas_factura", F.col("_role.tipo").alias("tipo"), "cuenta", "gxx", "origen", "pagina", "aviso", F.trim(F.coalesce("sustituye_a", F.lit(""))).alias("sustituye_a"), F.lit(None).cast("string").alias("sustituida_por"),
    )


def heads(raw: DataFrame, client: DataFrame) -> DataFrame:
    """The first line of each record without what its VAT lines say: amounts aren't read, records not exploded."""
    return build(raw.withColumn("lineas_iva", F.lit(None).cast(f"array<{RAW_LINE}>")), client)
