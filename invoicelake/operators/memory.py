"""Memories that outlive a batch: tax ids of providers, surcharge regimes of clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, taxid


def learnable(lines: DataFrame) -> DataFrame:
    """What a batch, after its fills, teaches: (clave, nif, nombre, seq) of invoices with a name and a valid id."""
    return taught(lines.filter("line_no = 0").withColumn("clave", names.provider_key(F.col("nombre"))))


def taught(heads: DataFrame) -> DataFrame:
    """``learnable`` of first lines with their key in ``clave``."""
    head = heads.select("clave", taxid.normalize(F.col("nif")).alias("nif"), F.trim(F.coalesce("nombre", F.lit(""))).alias("nombre"), F.col("doc_seq").alias("seq"))
    return head.filter((F.col("clave") != "") & taxid.is_valid(F.col("nif")))


def learned_count(lines: DataFrame, memory: DataFrame) -> DataFrame:
    """One row (aprendidas): readings that a batch's invoices leave in the memory; what a person wrote takes none."""
    return counted_of(learnable(lines), memory)


def counted_of(news: DataFrame, memory: DataFrame) -> DataFrame:
    by_hand = memory.filter("manual").select("clave")
    return news.join(by_hand, "clave", "left_anti").agg(F.count("*").alias("aprendidas"))


def upsert_providers(memory: DataFrame, news: DataFrame, manual: bool = False) -> DataFrame:
    """memory (clave, nif, nombre, manual) with news (clave, nif, nombre, seq). What a person wrote is never replaced by what was
    read; otherwise the last wins, an empty name keeps the old one, and the manual mark stays."""
    last = news.filter("clave <> '' and coalesce(nif, '') <> ''").groupBy("clave").agg(F.max_by(F.struct("nif", "nombre"), "seq").alias("new"), F.max_by("nombre", F.when(F.col("nombre") != "", F.col("seq"))).alias("named"))
    both = memory.withColumnsRenamed({"nif": "o_nif", "nombre": "o_nombre", "manual": "o_manual"}).join(last, "clave", "full_outer")
    kept = F.coalesce("o_manual", F.lit(False)) & F.lit(not manual) | F.col("new").isNull()
    return both.select(
        "clave", F.when(kept, F.col("o_nif")).otherwise(F.col("new.nif")).alias("nif"),
        F.when(kept, F.col("o_nombre")).otherwise(F.coalesce("named", "o_nombre", F.lit(""))).alias("nombre"),
        (F.coalesce("o_manual", F.lit(False)) | (F.lit(manual) & F.col("new").isNotNull())).alias("manual"),
    )


def upsert_clients(memory: DataFrame, news: DataFrame) -> DataFrame:
    """memory and news (nif, recargo_equivalencia, nombre): news win, an empty name keeps the old one."""
    n = news.select(taxid.alnum_key(F.col("nif")).alias("nif"), F.col("recargo_equivalencia").alias("n_re"), F.nullif("nombre", F.lit("")).alias("n_nombre")).filter("nif <> ''")
    return memory.join(n, "nif", "full_outer").select("nif", F.coalesce("n_re", "recargo_equivalencia").alias("recargo_equivalencia"), F.coalesce("n_nombre", "nombre", F.lit("")).alias("nombre"))


def in_surcharge_regime(df: DataFrame, memory: DataFrame, id_col: str) -> DataFrame:
    """df with ``recargo_equivalencia``; unknown clients are not in it."""
    m = memory.select(F.col("nif").alias("_k"), F.col("recargo_equivalencia").alias("_re"))
    return df.join(m, taxid.alnum_key(F.col(id_col)) == F.col("_k"), "left").withColumn("recargo_equivalencia", F.coalesce("_re", F.lit(False))).drop("_k", "_re")


def spread_manual_id(lines: DataFrame, doc_seq: int, nif: str) -> DataFrame:
    """An id typed for one invoice, and for others of the same provider key whose id isn't valid."""
    key = lines.filter((F.col("doc_seq") == doc_seq) & (F.col("line_no") == 0)).select(names.provider_key(F.col("nombre")).alias("_k")).limit(1)
    df = lines.join(F.broadcast(key), F.lit(True), "left")
    same = (names.provider_key(F.col("nombre")) == F.col("_k")) & (F.col("_k") != "") & ~taxid.is_valid(F.col("nif")) & taxid.is_valid(F.lit(nif))
    return df.withColumn("nif", F.when((F.col("doc_seq") == doc_seq) | F.coalesce(same, F.lit(False)), F.lit(nif)).otherwise(F.col("nif"))).select(*lines.columns)
