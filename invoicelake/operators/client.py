"""The client of a batch: the tax id that appears most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxid, texts


def detect(raw: DataFrame) -> DataFrame:
    """One row (nombre, nif): the id that emitters and receivers have most often, and its commonest name; of equals, the first seen.
    Empty texts where no record has an id."""
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("lado"), taxid.normalize(F.col("emisor_nif")).alias("nif"), texts.present(F.col("emisor_nombre")).alias("nombre")),
        F.struct(F.lit(1).alias("lado"), taxid.normalize(F.col("receptor_nif")).alias("nif"), texts.present(F.col("receptor_nombre")).alias("nombre")),
    ))
    seen = raw.select("doc_seq", sides.alias("s")).select("doc_seq", "s.*").filter("nif <> ''")
    names = seen.groupBy("nif", "nombre").agg(F.count("*").alias("n"), F.min(F.struct("doc_seq", "lado")).alias("first"))
    ids = names.groupBy("nif").agg(F.sum("n").alias("veces"), F.min("first").alias("first"), F.max_by("nombre", F.when(F.col("nombre").isNotNull(), F.struct("n", (-F.col("first.doc_seq")).alias("d"), (-F.col("first.lado")).alias("l")))).alias("nombre"))
    top = ids.orderBy(F.desc("veces"), "first").limit(1).select(F.coalesce("nombre", F.lit("")).alias("nombre"), "nif")
    none = raw.sparkSession.range(1).select(F.lit("").alias("nombre"), F.lit("").alias("nif"), F.lit(1).alias("k"))
    return none.select("k").join(top, F.lit(True), "left").select(F.coalesce("nombre", F.lit("")).alias("nombre"), F.coalesce("nif", F.lit("")).alias("nif"))
