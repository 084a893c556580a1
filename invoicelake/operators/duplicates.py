"""Lines that are in a batch twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, taxid
from ..functions.texts import let

_ORDER = ("doc_seq", "line_no")


_FILLED = "_key.num <> '' or _key.nif <> '' or _key.base <> 0 or _key.pct <> 0"


def key() -> Column:
    """What makes two lines the same: struct(num, nif, base, pct)."""
    zero = F.lit(0.0)
    return F.struct(
        taxid.dedup_key(F.col("num_factura")).alias("num"), taxid.dedup_key(F.col("nif")).alias("nif"),
        (numbers.round2(F.coalesce("base_iva", zero)) + 0.0).alias("base"), (numbers.round2(F.coalesce("pct_iva", zero)) + 0.0).alias("pct"),
    )


def key_hash(other: Column) -> Column:
    """A hash of a line's key; of ``other`` for lines without one, which are nobody's duplicates."""
    def of(k: Column) -> Column:
        filled = (k["num"] != "") | (k["nif"] != "") | (k["base"] != 0) | (k["pct"] != 0)
        return F.when(filled, digest(k)).otherwise(F.xxhash64(other))

    return let(key(), of)


def digest(k: Column) -> Column:
    return F.xxhash64(k)


def _firsts(lines: DataFrame) -> DataFrame:
    """(_key, _first): the first line of each key that several lines have. Empty keys are left out once they are summed up: a filter before that would
    compute the key anew for each of its conditions."""
    keyed = lines.select(key().alias("_key"), F.struct(*_ORDER).alias("_at"))
    return keyed.groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").filter(_FILLED).drop("_n")


def mark_in_place(lines: DataFrame, hashed: str, ways: int) -> DataFrame:
    """As ``mark``, for lines with their ``key_hash`` in the column ``hashed``, which goes: whole lines are shuffled once, into ``ways`` tasks by that hash,
    and stay where they are. Keys of equal hashes are told apart. The input is read twice, its keys and its lines."""
    firsts = _firsts(lines).groupBy(digest(F.col("_key")).alias(hashed)).agg(F.collect_list(F.struct("_key", "_first")).alias("_firsts"))
    out = lines.repartition(ways, hashed).join(firsts.repartition(ways, hashed), hashed, "left")
    own = F.when(F.col("_firsts").isNotNull(), F.get(F.filter("_firsts", lambda f: f["_key"] == key()), F.lit(0))["_first"])
    out = out.withColumn("_first", own)
    later = F.col("_first").isNotNull() & (F.struct(*_ORDER) > F.col("_first"))
    kept = [c for c in lines.columns if c != hashed]
    return out.select(*kept, F.when(later, F.col("_first.doc_seq")).alias("dup_doc"), F.when(later, F.col("_first.line_no")).alias("dup_line"))


def mark(lines: DataFrame) -> DataFrame:
    """lines with ``dup_doc``, ``dup_line``: the first line with the same number, id, base and percentage, for all others of them.
    Lines empty in all four are no duplicates. The first of a key is found by a partial aggregate, so a common key costs no large group;
    lines without a key are dealt out over all tasks of the join. The input is read twice: store it first (``stages.stage``)."""
    keyed = lines.withColumn("_key", key())
    first = _firsts(lines)
    spread = F.when(F.expr(_FILLED), F.lit(0)).otherwise(F.pmod(F.xxhash64(*_ORDER), F.lit(1 << 20)).cast("int") + 1)
    out = keyed.withColumn("_deal", spread).join(first.withColumn("_deal", F.lit(0)), ["_key", "_deal"], "left")
    later = F.col("_first").isNotNull() & (F.struct(*_ORDER) > F.col("_first"))
    return out.select(*lines.columns, F.when(later, F.col("_first.doc_seq")).alias("dup_doc"), F.when(later, F.col("_first.line_no")).alias("dup_line"))
