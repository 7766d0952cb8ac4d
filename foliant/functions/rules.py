"""Validation rules as column builders.

A rule takes a :class:`Value` and gives a boolean column, true where the value passes. Schema rules
are looked up by name with an optional ``name:parameter``; callers may register their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config
from foliant.functions import parse
from foliant.functions.luhn import luhn_valid


@dataclass(frozen=True)
class Value:
    """A field value with its normalised forms; ``as_of`` stands for today."""

    raw: Column
    date: Column
    amount: Column
    as_of: Column
    invoice_date: Column | None = None
    effective_date: Column | None = None

    @property
    def text(self) -> Column:
        """What the rules look at: the normalised value where it is set and not zero, else the raw text."""
        return F.coalesce(
            self.date.cast("string"),
            F.when(self.amount != 0, parse.amount_text(self.raw)),
            self.raw,
        )


def value_of(raw: Column, as_of, **other) -> Value:
    return Value(raw, parse.to_date(raw), F.lit(None).cast("decimal(28,6)"), F.lit(as_of).cast("date"), **other)


def _truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def not_empty(v: Value, _=None) -> Column:
    return ~parse.is_blank(v.text)


def min_length(v: Value, n) -> Column:
    return _truthy(v.text) & (F.length(v.text) >= int(n))


def max_length(v: Value, n) -> Column:
    return ~_truthy(v.text) | (F.length(v.text) <= int(n))


def alphanumeric(v: Value, _=None) -> Column:
    return _truthy(v.text) & v.text.rlike(config.ALNUM_PATTERN)


def _as_date(v: Value) -> Column:
    return F.coalesce(v.date, parse.to_date(v.raw))


def valid_date(v: Value, _=None) -> Column:
    return _as_date(v).isNotNull()


def past_date(v: Value, _=None) -> Column:
    return F.coalesce(_as_date(v) <= v.as_of, F.lit(False))


def future_date(v: Value, _=None) -> Column:
    return F.coalesce(_as_date(v) >= v.as_of, F.lit(False))


def _number(v: Value) -> Column:
    return parse.to_amount(v.raw, "double")


def positive_amount(v: Value, _=None) -> Column:
    return F.coalesce(_number(v) > 0, F.lit(False))


def non_negative_amount(v: Value, _=None) -> Column:
    return F.coalesce(_number(v) >= 0, F.lit(False))


def currency_format(v: Value, _=None) -> Column:
    return _truthy(v.text) & F.trim(v.text).rlike(config.CURRENCY_PATTERN)


def valid_email(v: Value, _=None) -> Column:
    return _truthy(v.text) & v.text.rlike(config.EMAIL_PATTERN)


def valid_phone(v: Value, _=None) -> Column:
    return _truthy(v.text) & F.regexp_replace(v.text, r"[\s\-().]", "").rlike(config.PHONE_PATTERN)


def valid_payment_method(v: Value, _=None) -> Column:
    low = F.lower(v.text)
    hit = F.lit(False)
    for m in config.PAYMENT_METHODS:
        hit = hit | low.contains(m)
    return _truthy(v.text) & hit


RULES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (not_empty, min_length, max_length, alphanumeric, valid_date, past_date, future_date, positive_amount,
              non_negative_amount, currency_format, valid_email, valid_phone, valid_payment_method)
}

# Rules the schemas name but do not define; only applied in strict mode.
STRICT_RULES: dict[str, Callable[..., Column]] = {
    "positive_number": positive_amount,
    "between_0_and_1": lambda v, _=None: F.coalesce(_number(v).between(0, 1), F.lit(False)),
    "alphabetic": lambda v, _=None: v.text.rlike(r"^[\p{L}\s'\-]+$"),
    "reasonable_age": lambda v, _=None: F.coalesce(
        F.floor(F.months_between(v.as_of, _as_date(v)) / 12).between(0, 120), F.lit(False)),
    "valid_gender": lambda v, _=None: F.lower(F.trim(v.text)).isin(*config.GENDERS),
    "valid_height": lambda v, _=None: v.text.rlike(r"^\d{1,3}\s*('|ft|cm|in|-)?\s*\d{0,2}\s*(\"|in)?$"),
    "valid_weight": lambda v, _=None: F.lower(v.text).rlike(r"^\d{2,3}\s*(lb|lbs|kg)?$"),
    "valid_eye_color": lambda v, _=None: F.lower(F.trim(v.text)).isin(*config.EYE_COLORS),
    "valid_language_code": lambda v, _=None: F.lower(F.trim(v.text)).isin(*config.LANGUAGE_CODES),
    "future_date_from_invoice": lambda v, _=None: F.coalesce(_as_date(v) >= v.invoice_date, F.lit(True)),
    "after_effective_date": lambda v, _=None: F.coalesce(_as_date(v) > v.effective_date, F.lit(True)),
}


def schema_rule(rule: str, v: Value, strict: bool = False, custom: dict[str, Callable[..., Column]] | None = None) -> Column | None:
    """The pass condition of a schema rule, or None for names without a rule.

    ``custom`` has rules of the caller's own, which come first; they take a Value and the text after the colon (or None).
    """
    name, _, param = rule.partition(":")
    fn = (custom or {}).get(name) or RULES.get(name) or (STRICT_RULES.get(name) if strict else None)
    return None if fn is None else fn(v, param or None)


# ---- single-rule checks that report a message, severity and suggestion; the words of the messages are fixed values ----

def _result(rule: str, valid: Column, message: Column, suggested: Column | None = None) -> Column:
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(
        valid.alias("is_valid"),
        F.when(valid, "info").otherwise("error").alias("severity"),
        message.alias("message"),
        F.lit(rule).alias("rule_name"),
        (F.lit(None).cast("string") if suggested is None else suggested).alias("suggested_value"),
    )


def _empty_or(value: Column, empty_message: str, rule: str, otherwise: Column) -> Column:
    return F.when(value.isNull() | (value == ""), _result(rule, F.lit(False), F.lit(empty_message))).otherwise(otherwise)


def check_pattern(pattern: str) -> str:
    """Validate a pattern on the driver; anchored at the start only, like a prefix match."""
    re.compile(pattern)
    return f"^(?:{pattern})"


def regex_ok(value: Column, pattern: str) -> Column:
    """Whether a value fits; NULL for a pattern that is none."""
    try:
        return parse.strip(value).rlike(check_pattern(pattern))
    except re.error:
        return F.lit(None).cast("boolean")


def regex_report(value: Column, pattern: str, ok: Column) -> Column:
    try:
        check_pattern(pattern)
    except re.error as e:
        return _result("regex", F.lit(False), F.lit(f"Invalid regex pattern: {e}"))
    message = F.concat(F.lit("Regex validation "), F.when(ok, "passed").otherwise("failed"), F.lit(f": {pattern}"))
    return _empty_or(value, "Empty value for regex validation", "regex", _result("regex", ok, message))


def rule_regex(value: Column, pattern: str) -> Column:
    return regex_report(value, pattern, regex_ok(value, pattern))


def rule_luhn(value: Column) -> Column:
    ok = luhn_valid(value)
    return _result("luhn", ok, F.concat(F.lit("Luhn validation "), F.when(ok, "passed").otherwise("failed"), F.lit(" for: "), value))


def rule_date_format(value: Column, expected_formats: tuple[str, ...] = ()) -> Column:
    """Any date that can be read, and then the expected formats one after the other."""
    return date_report(value, date_found(value, expected_formats), expected_formats)


def date_found(value: Column, expected_formats: tuple[str, ...] = ()) -> Column:
    """What is to be said of the date that a value holds, the date last; NULL without one."""
    found = [(parse.to_date(value), "Date parsed successfully: "), *((parse.date_by_format(value, f), f"Date parsed with format {f}: ") for f in expected_formats)]
    return F.coalesce(*[F.concat(F.lit(text), F.date_format(x, "yyyy-MM-dd")) for x, text in found])


def date_report(value: Column, found: Column, expected_formats: tuple[str, ...] = ()) -> Column:
    """``found`` is :func:`date_found` of the value. It stands where it is always asked for, so that Spark computes it once for all columns."""
    tried = f". Tried formats: {list(expected_formats)}" if expected_formats else ""
    failed = F.when(value.isNull() | (value == ""), "Empty date value").otherwise(f"Date format validation failed{tried}")
    return _result("date_format", found.isNotNull(), F.coalesce(found, failed), F.substring_index(found, ": ", -1))


def rule_date_range(value: Column, min_date=None, max_date=None) -> Column:
    d = parse.to_date(value)
    iso = F.date_format(d, "yyyy-MM-dd")
    parts = []
    if min_date is not None:
        parts.append(F.when(d < F.lit(min_date).cast("date"), F.concat(F.lit("Date "), iso, F.lit(f" is before minimum {min_date}"))))
    if max_date is not None:
        parts.append(F.when(d > F.lit(max_date).cast("date"), F.concat(F.lit("Date "), iso, F.lit(f" is after maximum {max_date}"))))
    errors = F.concat_ws("; ", *parts) if parts else F.lit("")
    ok = d.isNotNull() & (errors == "")
    message = (
        F.when(d.isNull(), F.concat(F.lit("Cannot parse date for range validation: "), F.coalesce(value, F.lit("None"))))
        .when(errors == "", "Date range validation passed").otherwise(errors)
    )
    return _result("date_range", ok, message)


def rule_numeric_range(value: Column, low: float = config.NUMERIC_RANGE[0], high: float = config.NUMERIC_RANGE[1]) -> Column:
    return range_report(value, parse.to_money(value), low, high)


def range_report(value: Column, n: Column, low: float, high: float) -> Column:
    """``n`` is the value as a number where it is one."""
    ok = n.between(low, high)
    message = (
        F.when(n.isNull(), F.concat(F.lit("Not a number: "), F.coalesce(value, F.lit("None"))))
        .when(ok, "Numeric range validation passed")
        .otherwise(F.concat(F.lit("Value "), value, F.lit(f" not in range [{low}, {high}]")))
    )
    return _result("numeric_range", ok, message)


def rule_currency(value: Column) -> Column:
    n = parse.to_money(value)
    normal = F.concat(F.lit("$"), F.round(n, 2).cast("decimal(28,2)").cast("string"))
    message = F.when(n.isNotNull(), F.concat(F.lit("Currency validated and normalized: "), normal)).otherwise(
        F.concat(F.lit("Invalid currency format: "), value))
    return _empty_or(value, "Empty currency value", "currency_format", _result("currency_format", n.isNotNull(), message, normal))


def rule_email(value: Column) -> Column:
    ok = value.rlike(config.EMAIL_PATTERN)
    message = F.concat(F.lit("Email validation "), F.when(ok, "passed").otherwise("failed"), F.lit(": "), value)
    return _empty_or(value, "Empty email value", "email_format", _result("email_format", ok, message))


def rule_phone(value: Column) -> Column:
    ok = F.regexp_replace(value, r"[\s\-().]", "").rlike(config.PHONE_PATTERN)
    message = F.concat(F.lit("Phone validation "), F.when(ok, "passed").otherwise("failed"), F.lit(" (basic): "), value)
    return _empty_or(value, "Empty phone number", "phone_format", _result("phone_format", ok, message))


def rule_length(value: Column, low: int, high: int) -> Column:
    """NULL where the length fits: this rule only reports failures."""
    n = F.length(value)
    bad = ~n.between(low, high)
    return F.when(bad, _result("length", F.lit(False), F.concat(F.lit("Length "), n.cast("string"), F.lit(f" not in range [{low}, {high}]"))))


def rule_required(name: Column, value: Column) -> Column:
    """NULL where a value is there: this rule only reports failures."""
    return F.when(parse.is_blank(value), _result("required", F.lit(False), F.concat(F.lit("Required field '"), name, F.lit("' is empty"))))
