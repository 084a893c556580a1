"""Printed dates to tax quarters. A period is one number, year * 10 + quarter, so it sorts and compares as a pair would."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of dates, and how each becomes y-m-d. Two-digit years from 69 are of the last century.
_SHAPES = (
    (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$", "$4-$3-$1"), (r"^(\d{1,2})/(\d{1,2})/(69|[78]\d|9\d)$", "19$3-$2-$1"), (r"^(\d{1,2})/(\d{1,2})/([0-5]\d|6[0-8])$", "20$3-$2-$1"),
)


def period(c: Column) -> Column:
    """Of d/m/y, d-m-y, d.m.y, y-m-d and d/m/yy; null for what isn't a date. Two-digit years from 69 are of the last century."""
    t = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    for shape, form in _SHAPES:
        t = F.regexp_replace(t, shape, form)
    date = F.regexp_extract(t, r"^\d{4}-\d{1,2}-\d{1,2}$", 0).try_cast("date")
    return (F.year(date) * 10 + F.quarter(date)).cast("long")


def period_text(p: Column) -> Column:
    """20262 -> 2T 2026"""
    return F.coalesce(F.concat((p % 10).cast("string"), F.lit("T "), F.floor(p / 10).cast("string")), F.lit("—"))
