"""Spanish tax ids: normal forms and check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

# Check letters of personal ids by remainder, control letters of company ids by digit, first letters.
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
COMPANY_KINDS = "ABCDEFGHJNPQRSUVW"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Upper case without dots, spaces and hyphens; null gives an empty text."""
    return F.coalesce(F.regexp_replace(F.upper(_trimmed(c)), "[. -]", ""), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Letters and digits in upper case: document numbers, client ids."""
    return F.coalesce(F.upper(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]", "")), F.lit(""))


def dedup_key(c: Column) -> Column:
    return F.coalesce(F.upper(_trimmed(c)), F.lit(""))


def is_valid(c: Column) -> Column:
    """Whether the check digit or letter holds. Dots aren't dropped here."""
    t = F.regexp_replace(F.upper(_trimmed(c)), "[ -]", "")
    return F.coalesce(let(F.concat(F.translate(F.substring(t, 1, 1), "XYZ", "012"), F.substring(t, 2, 100)), _checks), F.lit(False))


def _checks(t: Column) -> Column:
    person = F.element_at(F.split(F.lit(PERSON_LETTERS), ""), (F.substring(t, 1, 8).try_cast("int") % 23 + 1).cast("int")) == F.substring(t, 9, 1)
    digit = lambda i: F.substring(t, i, 1).try_cast("int")
    doubled = lambda i: F.when(digit(i) * 2 < 10, digit(i) * 2).otherwise(digit(i) * 2 - 9)
    total = digit(3) + digit(5) + digit(7) + doubled(2) + doubled(4) + doubled(6) + doubled(8)
    control, last = (10 - total % 10) % 10, F.substring(t, 9, 1)
    company = F.when(last.rlike("^[0-9]$"), last.try_cast("int") == control).otherwise(last == F.substring(F.lit(COMPANY_LETTERS), control + 1, F.lit(1)))
    return F.when(t.rlike(r"^[0-9]{8}\p{L}$"), person).when(t.rlike(f"^[{COMPANY_KINDS}][0-9]{{7}}.$"), company)
