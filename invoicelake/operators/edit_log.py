"""Edits and deletions as an append-only log, with undo: any version of a batch can be read.

An entry (seq, accion, doc_seq, line_no, campo, valor, deshace) is what a person did, in the order of ``seq``:

    edita     the cell ``campo`` of a line gets the typed text ``valor``
    borra     the line is deleted: a tombstone
    deshace   the entry ``deshace`` no longer counts; undoing an undo brings its entry back

Nothing is ever changed in the log. A version is the log up to a number; a cell shows the last of its edits that still count, a line is gone if
a deletion of it does. The log is folded by aggregates on the cell and on the entry undone, so its length costs one shuffle, and a busy
cell no large group. Chains of undos are resolved by halving: an entry counts unless the last undo that names it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records
from ..stages import release, stage
from . import edits

EDIT, DELETE, UNDO = "edita", "borra", "deshace"
LOG = "seq long, accion string, doc_seq long, line_no int, campo string, valor string, deshace long"


def append(entries: DataFrame, path: str) -> None:
    """Adds entries to the log at ``path``. Writers give numbers of their own; an entry that is written twice counts once."""
    entries.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in LOG.split(", "))).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, empty where there is none yet."""
    if not records.is_folder(spark, path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def counting(log: DataFrame, version: int | None = None) -> DataFrame:
    """The edits and deletions that count at a version: all entries up to that number, or all. Repeated numbers are one entry: the first by its text.

    An undo that names no earlier entry undoes nothing. Whether an undo counts depends on those that name it, so links from each entry to the last
    undo that names it are followed to their end; each round doubles their reach, so a chain of n undos takes log n rounds.
    """
    upto = log if version is None else log.filter(F.col("seq") <= version)
    whole = [c.split()[0] for c in LOG.split(", ")]
    entries = stage(upto.filter("seq is not null").groupBy("seq").agg(F.min(F.struct(*whole)).alias("e")).select("e.*"))
    undos = entries.filter((F.col("accion") == UNDO) & (F.col("deshace") < F.col("seq")))
    # undos of one entry act in turn: each later one that counts undoes it anew, so it counts only if none of them does
    named = stage(undos.select(F.col("deshace").alias("of"), F.col("seq").alias("by")))
    state = stage(entries.select("seq", F.lit(None).cast("boolean").alias("counts")))
    known = -1
    while True:
        # an entry is settled once all undos that name it are: out if one of them counts
        votes = named.join(state.select(F.col("seq").alias("by"), F.col("counts").alias("by_counts")), "by").groupBy("of").agg(
            F.max("by_counts").alias("undone"), F.count_if(F.col("by_counts").isNull()).alias("open")
        )
        new = state.join(votes.withColumnRenamed("of", "seq"), "seq", "left")
        settled = F.when(F.coalesce("undone", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        new = stage(new.select("seq", F.coalesce("counts", settled).alias("counts")), state)
        state, before = new, known
        known = state.filter("counts is not null").count()
        if known == before or not state.filter("counts is null").limit(1).count():
            break
    out = stage(entries.join(state.filter("counts").select("seq"), "seq", "left_semi").filter(F.col("accion") != UNDO), named, state)
    release(entries)
    return out


def at_version(lines: DataFrame, log: DataFrame, version: int | None = None) -> DataFrame:
    """The lines as they are shown at a version: edited cells, without deleted lines. Entries of lines that aren't there change nothing."""
    kept = counting(log, version)
    gone = kept.filter(F.col("accion") == DELETE).select("doc_seq", "line_no").distinct()
    typed = kept.filter(F.col("accion") == EDIT).select("doc_seq", "line_no", "campo", "valor", F.col("seq").alias("orden"))
    out = edits.without_rows(edits.apply(lines, typed), gone)
    out._stage_path = kept._stage_path
    return out


def changes(log: DataFrame, older: int, newer: int) -> DataFrame:
    """(doc_seq, line_no, campo, antes, despues): cells that differ between two versions, and deletions (campo borra, texts no and sí)."""

    def cells(version: int) -> DataFrame:
        kept = counting(log, version)
        typed = kept.filter(F.col("accion") == EDIT).groupBy("doc_seq", "line_no", "campo").agg(F.max_by("valor", "seq").alias("valor"))
        gone = kept.filter(F.col("accion") == DELETE).select("doc_seq", "line_no", F.lit(DELETE).alias("campo"), F.lit("sí").alias("valor")).distinct()
        return typed.unionByName(gone)

    both = cells(older).withColumnRenamed("valor", "antes").join(cells(newer).withColumnRenamed("valor", "despues"), ["doc_seq", "line_no", "campo"], "full_outer")
    fill = lambda c: F.when(F.col("campo") == DELETE, F.coalesce(c, F.lit("no"))).otherwise(F.col(c)).alias(c)
    return both.filter(~F.col("antes").eqNullSafe(F.col("despues"))).select("doc_seq", "line_no", "campo", fill("antes"), fill("despues"))
