"""Canonical decomposition (NFD) of texts by built-in functions, as Unicode's own data has it.

A whole text is translated at once: one hash lookup for each sign, however many there are. What becomes one sign or none is done by that. A sign that becomes
several is translated to a private one, whose number is an index into an array of decompositions, and only such signs are taken one by one. Hangul syllables
are arithmetic. Then marks behind a base sign are put in the order of their combining classes; that is done for each base sign with its marks alone, and only
in texts that have two marks in a row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

#: Private signs begin here; decompositions are some thousands.
_PRIVATE, _PRIVATE_LAST = 0xF0000, 0xF0FFF
_HANGUL, _HANGUL_LAST = 0xAC00, 0xD7A3
_OWN = f"\\x{{{_PRIVATE:X}}}-\\x{{{_PRIVATE_LAST:X}}}"
_SEVERAL = f"\\x{{{_HANGUL:X}}}-\\x{{{_HANGUL_LAST:X}}}{_OWN}"


@cache
def _tables() -> tuple[str, list[str], str, list[int]]:
    """Signs that decompose and what they become; marks and their combining classes. From the interpreter's Unicode data."""
    whole, parts, marks, classes = [], [], [], []
    for n in range(sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF or _HANGUL <= n <= _HANGUL_LAST:
            continue
        d = unicodedata.normalize("NFD", c)
        if d != c:
            whole.append(c)
            parts.append(d)
        if unicodedata.combining(c):
            marks.append(c)
            classes.append(unicodedata.combining(c))
    return "".join(whole), parts, "".join(marks), classes


@cache
def bases() -> tuple[str, str]:
    """Signs whose decomposition without nonspacing marks is one other sign, and these."""
    kept = [(c, d) for c, d in _bare() if len(d) == 1]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


@cache
def _bare() -> list[tuple[str, str]]:
    """Signs that decompose and what they become without nonspacing marks."""
    whole, parts, _, _ = _tables()
    return [(c, "".join(x for x in d if unicodedata.category(x) != "Mn")) for c, d in zip(whole, parts)]


@cache
def _nonspacing() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Mn")


def _index(sign: Column, signs: str) -> Column:
    """The place of a sign among ``signs``, from 1; null for any other, private ones included."""
    private = "".join(chr(_PRIVATE + k) for k in range(len(signs)))
    at = F.ascii(F.translate(sign, signs, private)) - _PRIVATE + 1
    return F.when((F.ascii(sign) < _PRIVATE) & (at >= 1), at)


def _at(values: Column, place: Column, other: Column) -> Column:
    """The value at a place; ``other`` where that is null (an element at a null place counts as never null in plans)."""
    return let(place.cast("int"), lambda k: F.when(k.isNull(), other).otherwise(F.element_at(values, F.coalesce(k, F.lit(1)))))


def _listed(values: list) -> Column:
    """An array of values without commas as one literal, which the optimizer splits once."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _hangul(n: Column) -> Column:
    s = n - _HANGUL
    heads = _listed([chr(0x1100 + k // 21) + chr(0x1161 + k % 21) for k in range(19 * 21)])
    tails = _listed(["", *(chr(0x11A8 + k) for k in range(27))])
    return F.concat(F.element_at(heads, F.call_function("div", s, F.lit(28)).cast("int") + 1), F.element_at(tails, s % 28 + 1))


def _spread(text: Column, signs: str, parts: list[str], single: tuple[str, str] = ("", ""), dropped: str = "") -> Column:
    """A text with each of ``signs`` and each Hangul syllable taken apart, each of ``single`` replaced by its other sign, and none of ``dropped``. What private
    signs a text has of its own are set aside before."""
    assert len(signs) <= _PRIVATE_LAST - _PRIVATE
    private = "".join(chr(_PRIVATE + k) for k in range(len(signs)))

    def apart(c: Column) -> Column:
        n = F.ascii(c)
        known = F.element_at(_listed(parts), n - _PRIVATE + 1)
        return F.when(n.between(_HANGUL, _HANGUL_LAST), _hangul(n)).when(n.between(_PRIVATE, _PRIVATE + len(signs) - 1), known).otherwise(c)

    def rest(t: Column) -> Column:
        each = F.transform(F.regexp_extract_all(t, F.lit(f"[{_SEVERAL}]|[^{_SEVERAL}]+"), F.lit(0)), apart)
        return F.when(~t.rlike(f"[{_SEVERAL}]"), t).otherwise(F.array_join(each, ""))

    def translated(t: Column) -> Column:
        return let(F.translate(t, signs + single[0] + dropped, private + single[1]), rest)

    aside = F.when(text.rlike(f"[{_OWN}]"), F.regexp_extract_all(text, F.lit(f"[{_OWN}]+|[^{_OWN}]+"), F.lit(0))).when(text.isNotNull(), F.array(text))
    return F.array_join(F.transform(aside, lambda t: F.when(F.ascii(t).between(_PRIVATE, _PRIVATE_LAST), t).otherwise(translated(t))), "")


def _ordered(cluster: Column) -> Column:
    """A base sign and its marks, or marks alone, with the marks in order; equal classes stay as they were."""
    _, _, marks, classes = _tables()
    of = lambda c: _at(_listed(classes).cast("array<int>"), _index(c, marks), F.lit(0))
    each = F.transform(F.split(cluster, ""), lambda c, k: F.struct(of(c).alias("ccc"), k.alias("k"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["c"]), "")


def nfd(text: Column) -> Column:
    """The canonical decomposition; null stays null."""
    whole, parts, marks, _ = _tables()
    mark = f"[{_ranges(marks)}]"

    def order(t: Column) -> Column:
        clusters = F.regexp_extract_all(t, F.lit(f"(?s)({mark}+|.{mark}*)"), F.lit(1))
        in_a_row = F.translate(t, marks, marks[0] * len(marks)).contains(marks[0] * 2)
        return F.when(~in_a_row, t).otherwise(F.array_join(F.transform(clusters, lambda c: F.when(c.rlike(mark + mark), _ordered(c)).otherwise(c)), ""))

    return let(text, lambda t: F.when(_plain(t), t).otherwise(let(_spread(t, whole, parts), order)))


def without_marks(text: Column) -> Column:
    """The decomposition without nonspacing marks. What order these had doesn't matter, so the whole decomposition is made only for texts in which two
    other marks have come together, which may have to change places."""
    _, _, marks, _ = _tables()
    gone = _nonspacing()
    several = [(c, d) for c, d in _bare() if len(d) > 1]
    other = sorted(set(marks) - set(gone))
    reach = f"\\x{{{ord(other[0]):X}}}-\\x{{{ord(other[-1]):X}}}"  # one test for most signs
    dropped = gone + "".join(c for c, d in _bare() if not d)

    def bare(t: Column) -> Column:
        short = _spread(t, "".join(c for c, _ in several), [d for _, d in several], bases(), dropped)
        return let(short, lambda s: F.when(~s.rlike(f"[{reach}&&[{_ranges(''.join(other))}]]{{2}}"), s).otherwise(F.translate(nfd(t), gone, "")))

    return let(text, lambda t: F.when(_plain(t), t).otherwise(bare(t)))


def _plain(t: Column) -> Column:
    """Nothing in the text decomposes. A text of single bytes is known by its lengths, without a look at its signs."""
    return (F.octet_length(t) == F.length(t)) | ~t.rlike(r"[^\x00-\x{BF}]")


def _ranges(signs: str) -> str:
    """A character class of the signs, as ranges of code points."""
    out: list[list[int]] = []
    for n in sorted(map(ord, signs)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)
