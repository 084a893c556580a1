"""Missing and misread tax ids, from sibling invoices and from the provider memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import joins
from .. import messages as M
from ..functions import names, taxid, texts
from ..stages import stage


def headers(lines: DataFrame, *more: str) -> DataFrame:
    """The first line of each invoice."""
    return lines.filter("line_no = 0").select("doc_seq", "nombre", "nif", *more, names.provider_key(F.col("nombre")).alias("clave"), taxid.normalize(F.col("nif")).alias("norm")).withColumn("valido", taxid.is_valid(F.col("norm")))


def apply(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes (doc_seq, _nif or null, _aviso), stored, on all lines of their invoices; ``release`` of the result deletes them."""
    out = joins.by_rows(lines, fixes, "doc_seq")
    out = out.withColumn("nif", F.coalesce("_nif", "nif")).withColumn("aviso", texts.added(F.col("aviso"), F.col("_aviso"))).select(*lines.columns)
    out._stage_path = fixes._stage_path
    return out


def fixed_headers(head: DataFrame, fixes: DataFrame) -> DataFrame:
    """The headers as the lines are after ``apply``: an id that was taken over is normalised and judged like one that was read."""
    out = joins.by_rows(head, fixes.select("doc_seq", "_nif"), "doc_seq").withColumn("_norm", taxid.normalize(F.col("_nif")))
    new = F.col("_nif").isNotNull()
    out = out.withColumns({"nif": F.coalesce("_nif", "nif"), "norm": F.when(new, F.col("_norm")).otherwise(F.col("norm")), "valido": F.when(new, taxid.is_valid(F.col("_norm"))).otherwise(F.col("valido"))})
    return out.select(*head.columns)


def sibling_fixes(lines: DataFrame) -> DataFrame:
    head = stage(headers(lines))
    return stage(sibling_fixes_of(head), head)


def sibling_fixes_of(head: DataFrame) -> DataFrame:
    """Fixes of stored headers."""
    # pages that can't be read share one name and have no id: they are no siblings, however many they are
    head = head.filter((F.col("clave") != "") & (F.col("clave") != names.provider_key(F.lit(M.UNREADABLE))))
    valid = head.filter("valido").groupBy("clave", "norm").agg(F.min(F.struct("doc_seq", "nombre")).alias("donor"))
    per_name = valid.groupBy("clave").agg(F.count("*").alias("n"), F.min("norm").alias("bueno"), F.min_by("donor.nombre", "norm").alias("de"), F.array_join(F.array_sort(F.collect_list("norm")), ", ").alias("ids"))
    read = F.regexp_replace(F.coalesce("nif", F.lit("")), r"(?U)^\s+|\s+$", "")
    why = F.when(read != "", texts.filled(M.WHY_COPIED_BAD, read=read)).otherwise(M.WHY_COPIED_NONE)
    asking = joins.lookup(head.filter("not valido"), per_name, ["clave"], spread=F.xxhash64("doc_seq"))
    return asking.select(
        "doc_seq", F.when(F.col("n") == 1, F.col("bueno")).alias("_nif"),
        F.when(F.col("n") == 1, texts.filled(M.WARN_COPIED, name=F.col("de"), stored=F.col("bueno"), why=why)).otherwise(texts.filled(M.WARN_SEVERAL, n=F.col("n"), ids=F.col("ids"))).alias("_aviso"),
    )


def from_siblings(lines: DataFrame) -> DataFrame:
    """Invoices without a valid id take the one valid id that others of exactly the same name words have. With several, none is
    taken and a warning says so. A valid id is never replaced. Keys are summed up before the join, and the invoices of a common name are
    dealt out in it, so it is no large group. ``lines`` are read twice."""
    return apply(lines, sibling_fixes(lines))


def from_memory(lines: DataFrame, memory: DataFrame) -> DataFrame:
    """The stored id for invoices without a valid one; a warning where a valid id differs from the stored one."""
    return apply(lines, memory_fixes(lines, memory))


def counted(fixes: DataFrame) -> DataFrame:
    """One row (completadas, avisadas): invoices that got an id, and those with a warning alone."""
    return fixes.agg(F.count("_nif").alias("completadas"), F.count_if(F.col("_nif").isNull()).alias("avisadas"))


def sibling_counts(lines: DataFrame) -> DataFrame:
    return counted(sibling_fixes(lines))


def memory_counts(lines: DataFrame, memory: DataFrame) -> DataFrame:
    return counted(memory_fixes(lines, memory))


def memory_fixes(lines: DataFrame, memory: DataFrame) -> DataFrame:
    head = stage(headers(lines))
    return stage(memory_fixes_of(head, memory), head)


def memory_fixes_of(head: DataFrame, memory: DataFrame) -> DataFrame:
    """Fixes of stored headers."""
    known = memory.filter("clave <> '' and coalesce(nif, '') <> ''").select("clave", F.col("nif").alias("guardado"))
    read = F.regexp_replace(F.coalesce("nif", F.lit("")), r"(?U)^\s+|\s+$", "")
    why = F.when(read != "", texts.filled(M.WHY_MEMORY_BAD, read=read)).otherwise(M.WHY_MEMORY_NONE)
    differs = texts.filled(M.WARN_MEMORY_DIFFERS, name=F.col("nombre"), stored=F.col("guardado"), read=F.col("norm"))
    filled = texts.filled(M.WARN_FROM_MEMORY, stored=F.col("guardado"), name=F.col("nombre"), why=why)
    fixes = joins.lookup(head.filter("clave <> ''"), known, ["clave"], spread=F.xxhash64("doc_seq")).filter("not valido or norm <> guardado")
    return fixes.select("doc_seq", F.when(~F.col("valido"), F.col("guardado")).alias("_nif"), F.when(F.col("valido"), differs).otherwise(filled).alias("_aviso"))
