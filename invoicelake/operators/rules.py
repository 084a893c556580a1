"""Ledger accounts by ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip_accents
from ..functions.texts import let
from . import rule_index

DEFAULT_EXPENSE, DEFAULT_SALE, SUPPLIES = "600", "700", "628"
# Accounts with their keywords, first match wins; sub-codes of account 628 likewise.
EXPENSE_RULES = (
    ("631", ("impuesto", "tributo", "tasa", "ivtm", "vehiculos de traccion", "agencia tributaria", "ayuntamiento", "suma gestion")),
    ("628", ("telefon", "telecomunicacion", "internet", "movil", "orange", "movistar", "vodafone", "masmovil", "yoigo", "fibra")),
    ("628", ("electricidad", "energia electrica", "iberdrola", "endesa", "naturgy")),
    ("628", ("aquaservice", "suministro de agua", "hidrogea", "aguas de", "factura de agua", "consumo de agua")),
    ("628", ("gas natural", "butano", "propano", "redexis")),
    ("623", ("notari", "registr", "abogad", "procurador", "gestoria", "asesoria", "auditor")),
    ("625", ("seguro", "poliza", "mutua", "mapfre")),
    ("626", ("comision bancaria", "banco", "interes")),
    ("627", ("publicidad", "marketing")),
    ("621", ("alquiler", "arrendamiento", "renting")),
    ("622", ("taller", "reparacion", "averia", "neumatico", "recambio", "repuesto", "kit distribucion", "revision vehiculo")),
    ("628", ("combustible", "gasoleo", "gasoil", "gasolina", "diesel", "carburante")),
    ("624", ("mensajeria", "porte", "paqueteria")),
    ("629", ("papeleria", "material de oficina")),
)
SUBCODE_RULES = (
    ("G14", ("luz", "electricidad")),
    ("G15", ("aquaservice", "suministro de agua")),
    ("G16", ("gas natural",)),
    ("G17", ("telefon", "internet", "movil", "orange", "movistar", "vodafone")),
    ("G18", ("combustible", "gasoleo", "gasoil", "gasolina", "diesel", "carburante")),
)
Rules = tuple[tuple[str, tuple[str, ...]], ...]


def by_case(text: Column, rules: Rules, default: str | None, whole_words: bool = False) -> Column:
    """One CASE, a projection: the code of the first rule with a keyword in the text. Keywords match within words unless ``whole_words``."""
    def first_hit(t: Column) -> Column:
        out = None
        for code, keywords in rules:
            hit = None
            for k in keywords:
                one = t.rlike(rf"\b{k}\b") if whole_words else t.contains(k)
                hit = one if hit is None else hit | one
            out = F.when(hit, code) if out is None else out.when(hit, code)
        return F.lit(default) if out is None else out.otherwise(F.lit(default))

    return let(strip_accents(F.lower(F.coalesce(text, F.lit("")))), first_hit)


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame([(p, code, k) for p, (code, keywords) in enumerate(rules) for k in keywords], "prio int, codigo string, clave string")


def by_join(df: DataFrame, id_col: str, text: Column, rules: DataFrame, default: str | None) -> DataFrame:
    """The same for rules kept in a table: (id, codigo). All rules count; an index of q-grams finds those worth a test."""
    return rule_index.by_index(df, id_col, text, rules, default)


def expense_account(text: Column) -> Column:
    return by_case(text, EXPENSE_RULES, DEFAULT_EXPENSE)


def supplies_subcode(text: Column) -> Column:
    return by_case(text, SUBCODE_RULES, None)
