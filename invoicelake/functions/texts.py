"""Messages with values in them, and warnings that add up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, **values: Column) -> Column:
    """A template's {names} replaced by columns; a null value reads None."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("None")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def added(warning: Column, more: Column) -> Column:
    """A warning with another one behind it; nulls and empty texts add nothing."""
    return F.trim(F.concat_ws(" ", F.nullif(warning, F.lit("")), F.nullif(more, F.lit(""))))


def present(c: Column) -> Column:
    """Null for the empty text; white space counts as present."""
    return F.nullif(c, F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once: without it, a value that f uses many times is written out as often, and the optimizer
    drags all copies through every filter that it pushes down."""
    return F.element_at(F.transform(F.array(value), f), 1)
