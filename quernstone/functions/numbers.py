"""Numbers written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Text without outer white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    """A reference as compared: no outer white space, no letter case; null if nothing is left."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


_GAP = " \u00a0\u2009\u202f"
_TICK = "'\u2019"
#: Digits in groups: by commas, blanks or apostrophes of three, by underscores of any size.
_GROUPED = rf"^[+-]?(?:[0-9]{{1,3}}(?:(?:,[0-9]{{3}})+|(?:[{_GAP}][0-9]{{3}})+|(?:[{_TICK}][0-9]{{3}})+)|[0-9]+(?:_[0-9]+)+)(?:\.0*)?$"


def whole_number(c: Column) -> Column:
    """The whole number that a text evidently holds, as BIGINT, else null.

    Taken: a sign, digits in groups of three (comma, blank, no-break blank, apostrophe, two or more
    dots) or with underscores, a fraction of zeros, an exponent that leaves a whole number, `0x`
    for hexadecimal, a byte unit (B, byte, bytes). Null, empty text, other text, real fractions and
    what exceeds 64 bits with sign give null.
    """
    # most are plain; the others are bound once by a lambda, which keeps the generated code short
    return F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("bigint")).otherwise(F.transform(F.array(stripped(c)), _written)[0])


def digits(c: Column) -> Column:
    """Text of ASCII digits alone as BIGINT; null for other text and beyond 64 bits with sign."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def _written(s: Column) -> Column:
    hexa = F.conv(F.regexp_extract(s, r"^[+-]?0[xX]0*([0-9a-fA-F]{1,16})$", 1), 16, 10).try_cast("decimal(38,0)")
    return F.when(s.rlike(r"^[+-]?0[xX]"), F.when(s.startswith("-"), -hexa).otherwise(hexa).try_cast("bigint")).otherwise(F.transform(F.array(F.regexp_replace(s, r"(?iU)\s*(bytes?|b)$", "")), _decimal)[0])


def _decimal(s: Column) -> Column:
    plain = (
        F.when(s.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.substring_index(s, ".", 1))
        .when(s.rlike(_GROUPED), F.substring_index(F.translate(s, f",_{_TICK}{_GAP}", ""), ".", 1))
        .when(s.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3}){2,}$"), F.replace(s, F.lit(".")))
    )
    power = F.when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+$"), s.try_cast("decimal(38,18)"))
    return F.coalesce(plain.try_cast("bigint"), F.when(power == F.floor(power), power).try_cast("bigint"))
