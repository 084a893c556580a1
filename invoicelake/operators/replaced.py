"""Invoices that another one of the batch says it replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import joins
from .. import messages as M
from ..functions import taxid, texts
from ..stages import stage


def heads(lines: DataFrame) -> DataFrame:
    """Document numbers are compared by letters and digits alone."""
    return lines.filter("line_no = 0").select("doc_seq", "num_factura", taxid.alnum_key(F.col("num_factura")).alias("k"), taxid.alnum_key(F.col("sustituye_a")).alias("target"))


def by_target(heads: DataFrame) -> DataFrame:
    """(k, news): for each number that invoices say they replace, those invoices as array<struct<new, num>> by document. Summed up once for
    each number, however many invoices have it."""
    new = heads.filter("target <> ''").groupBy(F.col("target").alias("k"))
    return new.agg(F.array_sort(F.collect_list(F.struct(F.col("doc_seq").alias("new"), F.col("num_factura").alias("num")))).alias("news"))


def mark(lines: DataFrame) -> DataFrame:
    """A warning for each replacement, and the last one's number in ``sustituida_por``. An invoice doesn't replace itself. Invoices of a common number are
    dealt out over tasks. ``release`` of the result deletes what it stored."""
    head = stage(heads(lines))
    per = stage(replacements(head), head)
    out = joins.by_rows(lines, per, "doc_seq")
    out = out.withColumn("sustituida_por", F.coalesce("_por", "sustituida_por")).withColumn("aviso", texts.added(F.col("aviso"), F.col("_msg"))).select(*lines.columns)
    out._stage_path = per._stage_path
    return out


def replacements(heads: DataFrame) -> DataFrame:
    """(doc_seq, _por, _msg) of stored heads: for each invoice that others replace the last one's number, and the warnings."""
    old = heads.filter("k <> ''").select("doc_seq", "k")
    per = joins.lookup(old, by_target(heads), ["k"], spread=F.xxhash64("doc_seq")).select("doc_seq", F.filter("news", lambda n: n["new"] != F.col("doc_seq")).alias("_news")).filter("size(_news) > 0")
    return per.select("doc_seq", F.element_at("_news", -1)["num"].alias("_por"), F.array_join(F.transform("_news", lambda n: texts.filled(M.WARN_REPLACED, new=n["num"])), " ").alias("_msg"))


def counted(lines: DataFrame) -> DataFrame:
    """One row (marcadas): replacements found. Counts of each number are multiplied, so pairs aren't made; those of an invoice with itself are taken off."""
    return counted_of(heads(lines))


def counted_of(heads: DataFrame) -> DataFrame:
    each = heads.select(F.explode(F.array(F.struct(F.col("k").alias("k"), F.lit(1).alias("old"), F.lit(0).alias("new"), F.lit(0).alias("own")), F.struct(F.col("target").alias("k"), F.lit(0).alias("old"), F.lit(1).alias("new"), (F.col("target") == F.col("k")).cast("int").alias("own")))).alias("x"))
    per = each.select("x.*").filter("k <> ''").groupBy("k").agg(F.sum("old").alias("old"), F.sum("new").alias("new"), F.sum("own").alias("own"))
    return per.agg(F.coalesce(F.sum(F.expr("old * new - own")), F.lit(0)).alias("marcadas"))
