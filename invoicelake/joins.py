"""Joins with a table of keys that stay even where one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may meet in a task as they are, and the most keys that can have more, which bounds the list that is broadcast.
HOT_ROWS = 1_000
MOST_HOT_KEYS = 100_000
#: Up to so many rows of a table of keys (some 100 bytes each) are sent to every executor.
BROADCAST_ROWS = 100_000


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int | None = None) -> DataFrame:
    """(keys, _ways): keys that need more tasks than one, with the number of tasks. Counts are exact: partial aggregates, merged. No more
    than MOST_HOT_KEYS come out, since each has more than that part of all rows. ``rows`` are read twice."""
    most = max(hot_rows or HOT_ROWS, -(-rows.count() // MOST_HOT_KEYS))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return counts.select(*keys, F.expr(f"cast((_n + {most - 1}) div {most} as int)").alias("_ways"))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", *, spread: Column, hot_rows: int | None = None) -> DataFrame:
    """rows joined with ``table``, which has each of the keys once or a few times. ``how``: inner, left, left_semi or left_anti.

    Rows of hot keys are dealt out by ``spread``, a number of their own that a task which runs again computes anew; the table's rows of
    such keys are there once for each way. Null keys meet nothing: in a left join such rows are dealt out too. Both sides' other columns
    need names of their own. ``rows`` are read three times: store what is costly to compute (``stages.stage``).
    """
    few = F.broadcast(hot_keys(rows.dropna(subset=keys), keys, hot_rows))
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    ways = F.when(alone, F.lit(1 << 20)).otherwise(F.coalesce("_ways", F.lit(1)))
    dealt = rows.join(few, keys, "left").withColumn("_way", F.pmod(spread, ways).cast("int")).drop("_ways")
    copied = table.join(few, keys, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copied, [*keys, "_way"], how).drop("_way")


def by_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """A left join with a stored table that has as many rows as ``rows`` may have, by a shuffle of both. Stored files are compressed, often a
    hundredfold, and by their size alone the planner would send such a table through the driver to every executor."""
    return rows.join(stored.hint("merge"), key, "left")
