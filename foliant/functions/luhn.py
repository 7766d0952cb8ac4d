"""Mod-10 checksum as a Spark SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checksum(digits: Column) -> Column:
    chars = F.split(F.reverse(digits), "(?!^)(?!$)")
    parts = F.transform(chars, lambda c, i: _doubled(c.try_cast("int"), i))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x) % 10


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def luhn_valid(value: Column) -> Column:
    """True if the digits pass; blanks and dashes are ignored, anything else fails."""
    digits = F.regexp_replace(value, r"[\s-]", "")
    return F.coalesce(digits.rlike("^[0-9]+$") & F.call_function("luhn_check", digits), F.lit(False))


def luhn_check_digit(partial: Column) -> Column:
    """The digit that completes a number, NULL for anything but digits."""
    full = F.concat(partial, F.lit("0"))
    return F.when(partial.rlike("^[0-9]+$"), ((10 - _checksum(full)) % 10).cast("string"))
