"""JSON as language models write it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import let

_TRAILING = re.compile(r",\s*([}\]])")
_BRACED = re.compile(r"\{.*\}", re.S)


#: No JSON begins with these; to see that costs less than a parser's exception.
_PROSE = "^[`A-HJ-MO-Z]"


def _valid(t: Column) -> Column:
    return ~t.rlike(_PROSE) & F.try_parse_json(t).isNotNull()


def with_repaired(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``name``: the text if it is JSON; else what stands between the first brace and the last, without code fences and trailing commas, if
    that is; else null. Each step is a column of its own, so that none is computed again for every use of it. ``let``
    keeps the steps from being fused into one method, too long for Java to compile."""
    t, bare, braced, cut = F.col(text), F.col("_bare"), F.col("_braced"), F.col("_cut")
    out = df.withColumn("_valid", let(F.coalesce(_valid(t), F.lit(False)), lambda v: v))
    out = out.withColumn("_bare", F.when(~F.col("_valid"), F.regexp_replace(F.regexp_replace(F.trim(t), r"^```(?:json)?", ""), r"```\s*$", "")))
    out = out.withColumn("_braced", F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    out = out.withColumn("_cut", F.regexp_replace(F.coalesce(F.nullif(braced, F.lit("")), bare), r",\s*([}\]])", "$1"))
    return out.withColumn(name, let(F.when(F.col("_valid"), t).when(_valid(cut), cut), lambda v: v)).drop("_valid", "_bare", "_braced", "_cut")


def repaired(t: Column) -> Column:
    """``with_repaired`` for one column."""
    s = F.regexp_replace(F.regexp_replace(F.trim(t), r"^```(?:json)?", ""), r"```\s*$", "")
    s = F.coalesce(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), s)
    s = F.regexp_replace(s, r",\s*([}\]])", "$1")
    return F.when(_valid(t), t).when(_valid(s), s)


def readable(text: str | None) -> bool:
    """Whether a text that has just come from a client can be repaired: ``repaired`` for one value, outside a plan."""
    bare = (text or "").strip()
    found = _BRACED.search(bare)
    for candidate in (bare, _TRAILING.sub(r"\1", found[0]) if found else ""):
        try:
            if isinstance(json.loads(candidate), dict):
                return True
        except ValueError:
            continue
    return False
