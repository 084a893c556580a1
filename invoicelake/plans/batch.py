"""A batch of records to validated lines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import joins
from ..functions import texts
from ..operators import build, client, duplicates, edits, fill, gross, memory, periods, replaced, summary, validate
from ..stages import free_shuffles, release, stage

_LAST = ("issues", "estado", "dup_doc", "dup_line")


class Batch:
    """client: one row; lines: validated lines with estado, dup_doc, dup_line; memory: the provider memory after the batch; counts: one row
    of what the steps did. Each is computed when it is first asked for, with the steps that it needs, and read from stored tables; ``close`` deletes those once
    the results are written. Lines are validated as they are read: messages that nobody asks for aren't written.

    What the fills and replacements do is found on the records' headers. Whole lines take it in one join."""

    def __init__(self, raw: DataFrame, providers: DataFrame, collapse: bool, period: int | None, changes: DataFrame | None):
        self._given, self._providers, self._collapse, self._period, self._changes = raw, providers, collapse, period, changes
        self._kept: list[DataFrame] = []

    def close(self) -> None:
        release(*self._kept)

    def _keep(self, df: DataFrame) -> DataFrame:
        out = stage(df)
        free_shuffles(df.sparkSession)
        self._kept.append(out)
        return out

    @cached_property
    def _raw(self) -> DataFrame:
        """The records, which the client, the headers and the lines are read from."""
        return self._keep(self._given)

    @cached_property
    def client(self) -> DataFrame:
        return self._keep(client.detect(self._raw))

    @cached_property
    def _read(self) -> DataFrame:
        """Headers as they were read."""
        return self._keep(fill.headers(build.heads(self._raw, self.client), "num_factura", "sustituye_a"))

    @cached_property
    def _copied(self) -> DataFrame:
        return self._keep(fill.sibling_fixes_of(self._read))

    @cached_property
    def _with_copied(self) -> DataFrame:
        return self._keep(fill.fixed_headers(self._read, self._copied))

    @cached_property
    def _remembered(self) -> DataFrame:
        return self._keep(fill.memory_fixes_of(self._with_copied, self._providers))

    @cached_property
    def _news(self) -> DataFrame:
        return self._keep(memory.taught(fill.fixed_headers(self._with_copied, self._remembered)))

    @cached_property
    def _numbers(self) -> DataFrame:
        return self._keep(replaced.heads(self._read.withColumn("line_no", F.lit(0))))

    @cached_property
    def memory(self) -> DataFrame:
        return self._keep(memory.upsert_providers(self._providers, self._news))

    @cached_property
    def counts(self) -> DataFrame:
        filled = fill.counted(self._copied).toDF("copiadas", "dudosas").join(fill.counted(self._remembered).toDF("de_memoria", "distintas"), F.lit(True))
        return self._keep(filled.join(memory.counted_of(self._news, self._providers), F.lit(True)).join(replaced.counted_of(self._numbers), F.lit(True)))

    @cached_property
    def _filled(self) -> DataFrame:
        """All lines, with what the headers' steps found."""
        one = lambda c, t="string": F.lit(None).cast(t).alias(c)
        notes = self._copied.select("doc_seq", F.col("_nif").alias("_nif1"), F.col("_aviso").alias("_aviso1"), one("_nif2"), one("_aviso2"), one("_por"), one("_msg"))
        notes = notes.unionByName(self._remembered.select("doc_seq", F.col("_nif").alias("_nif2"), F.col("_aviso").alias("_aviso2")), allowMissingColumns=True)
        notes = notes.unionByName(replaced.replacements(self._numbers), allowMissingColumns=True)
        notes = notes.groupBy("doc_seq").agg(*(F.max(c).alias(c) for c in notes.columns if c != "doc_seq"))
        built = build.build(self._raw, self.client)
        out = joins.by_rows(built, self._keep(notes), "doc_seq")
        for c in ("_aviso1", "_aviso2", "_msg"):
            out = out.withColumn("aviso", texts.added(F.col("aviso"), F.col(c)))
        out = out.withColumns({"nif": F.coalesce("_nif2", "_nif1", "nif"), "sustituida_por": F.coalesce("_por", "sustituida_por")}).select(*built.columns)
        if self._collapse:
            out = gross.collapse(self._keep(out))
        return self._keep(out if self._changes is None else edits.apply(out, self._changes))

    @cached_property
    def lines(self) -> DataFrame:
        lines, period = duplicates.mark(self._filled), self._period
        if period is None:
            lines = lines.join(F.broadcast(periods.detect(self._filled)), F.lit(True))
            checked = validate.validate(lines, F.col("periodo"))
        else:
            checked = validate.validate(lines.withColumn("periodo", F.lit(period).cast("long")), F.lit(period))
        return validate.final_state(checked).select(*(c for c in checked.columns if c not in _LAST), *_LAST)


def run(raw: DataFrame, providers: DataFrame, *, collapse: bool = False, period: int | None = None, changes: DataFrame | None = None) -> Batch:
    """Client, build, sibling fill, memory fill, learning, replacement marks, gross totals if ``collapse``, edits, validation, duplicates.

    ``period`` (year * 10 + quarter): that of the batch; by default its commonest.
    """
    return Batch(raw, providers, collapse, period, changes)


def quarter_summary(lines: DataFrame, period: int) -> DataFrame:
    """Totals of one quarter by type, with the text that users see."""
    sums = summary.totals(periods.within(lines, period), "tipo")
    return sums.withColumn("texto", summary.described())
