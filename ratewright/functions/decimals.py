"""Numbers as decimal text: whether they are whole, and within the whole numbers that doubles keep apart, without making doubles of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest whole number up to which doubles hold each one, 2^53 - 1.
SAFE = "9007199254740991"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_number(text: Column) -> Column:
    """Whether a text is a decimal number, with or without exponent; null counts as none."""
    return F.coalesce(F.trim(text).rlike(NUMBER), F.lit(False))


def taken_apart(text: Column) -> tuple[Column, Column]:
    """(digits without zeros in front, the power of ten of the last one) of a number's text.

    An exponent of more than 9 digits counts as one of 9: no text is so long that this matters.
    """
    bare = F.regexp_replace(F.trim(text), r"^[+-]", "")
    mantissa = F.regexp_extract(bare, r"^([0-9]*\.?[0-9]*)", 1)
    power = F.regexp_extract(bare, r"[eE]([+-]?)0*([0-9]*)$", 2)
    size = F.when(F.length(power) > 9, F.lit(999_999_999)).otherwise(F.coalesce(power.try_cast("int"), F.lit(0)))
    exponent = F.when(F.regexp_extract(bare, r"[eE]([+-]?)", 1) == "-", -size).otherwise(size)
    fraction = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1))
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
    return digits, exponent - fraction


def is_whole(text: Column) -> Column:
    """Whether the number that a text stands for is whole: 1.00e1 is, 1.00000000000000001 isn't. False for other texts."""
    digits, power = taken_apart(text)
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    return is_number(text) & ((digits == "") | (power + zeros >= 0))


def is_unsafe(text: Column) -> Column:
    """Whether a number lies beyond 2^53 - 1 on either side, by its digits: 9007199254740991.0000001 does. False for other texts."""
    digits, power = taken_apart(text)
    before = F.length(digits) + power  # digits before the point
    whole, rest = F.rpad(F.substring(digits, 1, 16), 16, "0"), F.regexp_replace(F.substring(digits, 17, 1_000_000), "0+$", "")
    return is_number(text) & (digits != "") & ((before > 16) | ((before == 16) & ((whole > SAFE) | ((whole == SAFE) & (rest != "")))))
