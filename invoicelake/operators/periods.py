"""The quarter that a batch is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period


def detect(lines: DataFrame) -> DataFrame:
    """One row (periodo): the commonest quarter of the lines, of equals the latest; null for none."""
    counts = lines.select(period(F.col("fecha")).alias("p")).filter("p is not null").groupBy("p").agg(F.count("*").alias("n"))
    return counts.agg(F.max(F.struct("n", "p")).alias("m")).select(F.col("m.p").alias("periodo"))


def within(lines: DataFrame, p: int) -> DataFrame:
    return lines.filter(period(F.col("fecha")).eqNullSafe(F.lit(p)))
