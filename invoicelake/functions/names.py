"""Names of people and firms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import nfd
from .texts import let

# What name comparison drops, words a cut name doesn't end with.
_DROPPED = (",", ".", "(", ")", " SL", " S L", " SLU", " SA", " SAU", " CB")
_CONNECTORS = ("DE", "DEL", "LA", "EL", "LOS", "LAS", "Y", "E")
NAME_LENGTH = 40


def strip_accents(c: Column) -> Column:
    """Letters of any script without their marks, combining marks gone. Signs that decompose into several others, as Hangul syllables do, stay
    (``nfd.without_marks`` takes them apart)."""
    return F.regexp_replace(F.translate(c, *nfd.bases()), r"\p{Mn}", "")


def tokens(c: Column) -> Column:
    """The distinct words of three letters and more, ascending; company forms and punctuation are dropped as substrings."""
    t = F.upper(strip_accents(c))
    for piece in _DROPPED:
        t = F.replace(t, F.lit(piece), F.lit(" "))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) >= 3)
    return F.coalesce(F.array_sort(F.array_distinct(words)), F.array().cast("array<string>"))


def same_name(a: Column, b: Column) -> Column:
    """Two words in common at least, and 60 % of the shorter name's."""
    def alike(s: Column) -> Column:
        both, least = F.size(F.array_intersect(s["a"], s["b"])), F.least(F.size(s["a"]), F.size(s["b"]))
        return (both >= 2) & (both / F.greatest(least, F.lit(1)) >= 0.6)

    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), alike)


def provider_key(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def trimmed(c: Column) -> Column:
    """At most 40 characters: cut at a word's end if that costs six at most, and not after a connector."""
    return let(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), lambda s: F.when(F.length(s) <= NAME_LENGTH, s).otherwise(_cut(s)))


def _cut(s: Column) -> Column:
    cut = F.substring(s, 1, NAME_LENGTH)
    gap = NAME_LENGTH - F.locate(" ", F.reverse(cut))  # of the last space, from 0
    back = (F.substring(s, NAME_LENGTH + 1, 1) != " ") & (F.locate(" ", cut) > 0) & (gap >= NAME_LENGTH - 6)
    cut = F.regexp_replace(F.when(back, F.substring(cut, F.lit(1), gap)).otherwise(cut), "[ ,.-]+$", "")
    return F.regexp_replace(F.regexp_replace(cut, f"(?i) ({'|'.join(_CONNECTORS)})$", ""), "[ ,.-]+$", "")
