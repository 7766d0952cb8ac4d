"""Parsing and normalising text values into dates, amounts, phones and e-mails."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split and str.strip see it; Java's \s is ASCII only.
WS_CHARS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The outer ranges hold them all; other characters of plain text are told by these two alone.
WS = rf"[\x00-\x20\x{{85}}-\x{{3000}}&&[{WS_CHARS}]]"
#: The same characters one by one.
WS_TEXT = "".join(chr(c) for c in (*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000))
_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%B": "MMMM", "%b": "MMM", "%H": "H", "%M": "m", "%S": "s"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# One day, before or after the month's name, and then the year.
_NAMED_RE = (r"(?i)^(?=\D*\d{1,2}\D+\d{4}$)(?:(\d{1,2})\s+)?(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?"
             r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?:\s+(\d{1,2}))?,?\s+(\d{4})$")
_ISO = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
# Two numbers and a year; a first number that is no month is the day.
_NUMBERS = r"^(?:(1[3-9]|[2-9]\d)[/-](\d{1,2})|(\d{1,2})[/-](\d{1,2}))[/-](\d{4})$"
_MDY2 = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"


def strip(c: Column) -> Column:
    """Without white space at the ends; from both ends inwards, so that the text between is not looked at."""
    return F.btrim(c, F.lit(WS_TEXT))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{WS_CHARS}]")


def to_date(c: Column) -> Column:
    """yyyy-MM-dd with or without a time, M/d/yyyy, M-d-yyyy, M/d/yy, MMMM d, yyyy and d MMMM yyyy; NULL if none fits.

    Numbers are read month first, and day first where there is no such month.
    """
    v = F.trim(c)
    part = lambda form: F.regexp_replace(v, _NAMED_RE, form)
    number = F.find_in_set(F.lower(F.substring(part("$2"), 1, 3)), F.lit(",".join(MONTHS)))
    iso = (
        F.when(v.rlike(_ISO), F.regexp_extract(v, _ISO, 1))
        .when(v.rlike(_NUMBERS), F.regexp_replace(v, _NUMBERS, "$5-$2$3-$1$4"))
        .when(v.rlike(_MDY2), F.regexp_replace(v, _MDY2, "20$3-$1-$2"))
        .when(v.rlike(_NAMED_RE), F.concat(part("$4-"), number.cast("string"), part("-$1$3")))
    )
    return iso.try_cast("date")


def date_by_format(c: Column, fmt: str) -> Column:
    """A date by a format of % codes (Y, y, m, d, B, b, H, M, S); NULL if the text does not fit.

    A text that lacks the format's signs is not parsed: an attempt that fails costs far more than a look.
    """
    v, parts = F.trim(c), re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", fmt)
    pattern = "".join(_CODES.get(part, part) if part.startswith("%") else f"'{part}'" if part.isalpha() else part for part in parts)
    return F.when(v.rlike("(?is)^" + "".join(map(_shape, parts)) + "$"), F.to_date(F.try_to_timestamp(v, F.lit(pattern))))


def _shape(part: str) -> str:
    """A pattern that every text of this part of a format fits."""
    if part in _CODES:
        return ".+" if part in ("%B", "%b") else "[+-]?[0-9]+"
    return ".*" if re.search(r"[%\[\]{}#']", part) else re.sub(r"([^A-Za-z0-9_])", r"\\\1", part)


def amount_text(c: Column) -> Column:
    """The number a money text holds: everything but digits, dots, commas and minus dropped, then the commas."""
    return F.regexp_replace(c, r"[^\d.\-]", "")


def to_amount(c: Column, kind: str = "decimal(28,6)") -> Column:
    return amount_text(c).try_cast(kind)


def to_money(c: Column) -> Column:
    """Money with currency signs, blanks and commas removed; other characters make it NULL."""
    return F.regexp_replace(c, r"[$£€¥\s,]", "").try_cast("decimal(28,6)")


def to_phone(c: Column) -> Column:
    """E.164 for 10 digits, or 11 starting with 1; any other text stays as it is."""
    digits = F.regexp_replace(c, r"\D", "")
    return (
        F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise(c)
    )


def to_email(c: Column) -> Column:
    """Domain in lower case when the text is an address; any other text stays as it is."""
    at = F.instr(c, "@")
    return F.when(
        c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
        F.concat(F.substr(c, F.lit(1), at), F.lower(F.substr(c, at + 1))),
    ).otherwise(c)


def cell_value(c: Column, field_type: str) -> Column:
    """A table cell as normalised text: numbers and dates parsed, blanks NULL, failures unchanged."""
    v = strip(c)
    if field_type == "currency":
        parsed = to_amount(v, "double").cast("string")
    elif field_type == "number":
        parsed = F.regexp_replace(v, ",", "").try_cast("double").cast("string")
    elif field_type == "date":
        parsed = to_date(v).cast("string")
    else:
        parsed = v
    return F.when(~is_blank(c), F.coalesce(parsed, v))


def normalized(field_name: Column, value: Column, dates: list[str], amounts: list[str]) -> dict[str, Column]:
    """The three typed columns of a field value; only named fields have a normaliser."""
    return {
        "norm_date": F.when(field_name.isin(*dates), to_date(value)),
        "norm_amount": F.when(field_name.isin(*amounts), to_amount(value)),
        "norm_text": F.when(field_name == "phone", to_phone(value)).when(field_name == "email", to_email(value)),
    }
