"""Numbers as invoices print them, and as the books want them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def fixed2(x: Column) -> Column:
    """Two decimals as text. ``format_number`` with a pattern rounds the exact binary value half-even, as C's printf does;
    ``round`` and ``bround`` round the shortest decimal form and differ on 3 % of amounts."""
    return F.replace(F.call_function("format_number", x.cast("double"), F.lit("0.00")), F.lit(","), F.lit(""))


def round2(x: Column) -> Column:
    """Cents far from a half need no text: their nearest double is what the text would give. The others, and those that may become a negative zero, go through it."""
    cents = x.cast("double") * 100.0
    clear = (F.abs(cents) >= 1) & (F.abs(cents) < 1e11) & (F.abs(cents - F.floor(cents) - 0.5) > 1e-4)
    return F.when(clear, F.floor(cents + 0.5) / 100.0).otherwise(fixed2(x).cast("double"))


def _guarded(t: Column) -> Column:
    return let(t, lambda x: F.when(x.rlike(_DECIMAL), x.try_cast("double")))


def _bare(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit("€"), F.lit("")), F.lit(" "), F.lit(""))


def parse_number(c: Column) -> Column:
    """Printed amounts: a comma is the decimal sign, dots beside a comma group thousands, a minus sign may follow. Else null;
    text of infinities and NaN is null too."""
    text = c.cast("string")
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    # conditions look at the text itself and each value is used once, so nothing needs ``let``, which would take it out of the generated code
    digits = F.when(text.contains(","), F.translate(bare, ",.€ ", ".")).otherwise(F.translate(bare, "€ ", ""))
    number = lambda end: F.regexp_extract(digits, rf"^({_DECIMAL[1:-1]})(\r?\n|\r)?{end}\z", 1).try_cast("double")
    simple = F.translate(text, ",", ".").try_cast("double")
    return F.when(text.rlike(r"^[0-9]+([.,][0-9]+)?\z"), simple).when(text.rlike(r"(?U)-[€\s]*$"), -number("-")).otherwise(number(""))


def parse_typed_number(c: Column) -> Column:
    """Amounts that a person types: without a comma, several dots, or one before exactly three characters, group thousands."""
    return let(_bare(c), _typed)


def _typed(t: Column) -> Column:
    plain = F.replace(t, F.lit("."), F.lit(""))
    groups = t.rlike(r"[.].*[.]") | t.rlike(r"^[^.]*[.][^.]{3}$")
    return _guarded(F.when(t.contains(","), F.replace(plain, F.lit(","), F.lit("."))).when(groups, plain).otherwise(t))


def plain_text(x: Column) -> Column:
    """A number as messages show it: the shortest digits that give it back, from 1e-4 to 1e16 without an exponent, one decimal at least."""
    short = x.cast("double").cast("string")
    wide = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,20)").cast("string"), "0+$", ""), "[.]$", ".0")
    size = F.abs(x)
    return F.when(short.contains("E") & (size >= 1e-4) & (size < 1e16), wide).otherwise(short)


def amount_text(x: Column) -> Column:
    """1234.5 -> 1234,50"""
    return F.replace(fixed2(x), F.lit("."), F.lit(","))


def cell_text(x: Column) -> Column:
    return F.coalesce(amount_text(x), F.lit(""))


def percent_text(x: Column) -> Column:
    """Whole percentages without decimals, others with up to six significant digits and a comma."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)))).cast("int")
    short = F.regexp_replace(F.regexp_replace(F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), x.cast("double")), r"([.][0-9]*?)0+$", "$1"), r"[.]$", "")
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).when(x.isNotNull(), F.replace(short, F.lit("."), F.lit(",")))


def euros(x: Column) -> Column:
    """-1234.5 -> -1.234,50 €"""
    text = F.translate(F.call_function("format_number", F.abs(x.cast("double")), F.lit("#,##0.00")), ",.", ".,")
    return F.concat(F.when(x < 0, "-").otherwise(""), text, F.lit(" €"))
