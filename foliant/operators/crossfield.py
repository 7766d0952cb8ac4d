"""Rules over several fields of a document: dates in order, totals that add up; labels and message texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.functions import parse


def result(field: str, valid: Column, severity_bad: str, message: Column, rule: str, suggested: Column | None = None) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"), valid.alias("is_valid"), F.when(valid, "info").otherwise(severity_bad).alias("severity"),
        message.alias("message"), F.lit(rule).alias("rule_name"),
        (F.lit(None).cast("string") if suggested is None else suggested.cast("string")).alias("suggested_value"))


def as_text(v: Column) -> Column:
    """A decimal as text without trailing zeros after the second place."""
    return v.cast("decimal(28,2)").cast("string")


def date_sequence(d1: Column, d2: Column, name1: str, name2: str, rule: str = "date1_before_date2", rule_name: str = "cross_field_date") -> Column:
    """Both texts must parse; equal dates are in order."""
    a, b = parse.to_date(d1), parse.to_date(d2)
    if rule == "date1_before_date2":
        ok, words = a <= b, "before or equal to"
    elif rule == "date1_after_date2":
        ok, words = a >= b, "after or equal to"
    else:
        return result(f"{name1}+{name2}", F.lit(False), "error", F.lit(f"Unknown date sequence rule: {rule}"), rule_name)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    message = F.coalesce(
        F.concat(F.lit(f"{name1} ("), iso(a), F.lit(f") should be {words} {name2} ("), iso(b), F.lit(")")),
        F.lit("Date sequence validation error"))
    return result(f"{name1}+{name2}", F.coalesce(ok, F.lit(False)), "error", message, rule_name)


FORMULAS = {
    "total = subtotal + tax": ("subtotal", "tax"),
    "total = subtotal + tax - discount": ("subtotal", "tax", "discount"),
}


def amount_consistency(amounts: dict[str, Column], formula: str, rule_name: str = "cross_field_amount") -> Column:
    """Total against its parts, off by less than one cent; absent amounts count as zero, unreadable ones are errors."""
    if formula not in FORMULAS:
        return result("amount_consistency", F.lit(False), "error", F.lit(f"Unknown formula: {formula}"), rule_name)
    zero = F.lit(0).cast("decimal(28,6)")
    value = {k: parse.to_money(v) for k, v in amounts.items()}
    get = lambda k: value.get(k, zero)
    expected = get("subtotal") + get("tax")
    if "discount" in FORMULAS[formula]:
        expected = expected - get("discount")
    ok = F.abs(expected - get("total")) < F.lit("0.01").cast("decimal(4,2)")
    right = formula.split(" = ")[1]
    message = F.coalesce(
        F.concat(F.lit("Total validation: "), as_text(get("total")), F.when(ok, " == ").otherwise(" != "), as_text(expected), F.lit(f" ({right})")),
        F.lit("Amount consistency validation error"))
    return result("amount_consistency", F.coalesce(ok, F.lit(False)), "error", message, rule_name)


def total_calc(total: Column, subtotal: Column, tax: Column) -> Column:
    """Decimal columns; NULL unless total and subtotal are there and off by more than one cent."""
    expected = subtotal + F.coalesce(tax, F.lit(0).cast("decimal(28,6)"))
    bad = (total != 0) & (subtotal != 0) & (F.abs(expected - total) > F.lit("0.01").cast("decimal(4,2)"))
    message = F.concat(F.lit("Total amount ("), as_text(total), F.lit(") does not equal subtotal + tax ("), as_text(expected), F.lit(")"))
    return F.when(bad, result("total_amount", F.lit(False), "error", message, "total_equals_subtotal_plus_tax", as_text(expected)))


def due_date(invoice_date: Column, due: Column) -> Column:
    """Date columns; a due date on or before the invoice date is a warning."""
    message = F.concat(F.lit("Due date ("), due.cast("string"), F.lit(") should be after invoice date ("), invoice_date.cast("string"), F.lit(")"))
    return F.when(due <= invoice_date, result("due_date", F.lit(False), "warning", message, "due_date_after_invoice_date"))


def sum_against(items: Column, stated: Column, field: str, rule: str, what: str, target: str) -> Column:
    """Sum of table amounts against a stated figure; NULL where either is missing or they agree within a cent."""
    bad = (stated != 0) & (F.abs(items - stated) > F.lit("0.01").cast("decimal(4,2)"))
    message = F.concat(F.lit(f"{what} sum ("), as_text(items), F.lit(f") does not equal {target} ("), as_text(stated), F.lit(")"))
    return F.when(bad, result(field, F.lit(False), "error", message, rule, as_text(items)))


def line_items_sum(items: DataFrame, docs: DataFrame, key: str, stated: str, amount_col: str = "amount") -> DataFrame:
    """Long form: item amounts summed per document (map-side first), compared with the stated figure."""
    sums = items.groupBy(key).agg(F.sum(F.coalesce(parse.to_amount(F.col(amount_col)), F.lit(0).cast("decimal(28,6)"))).alias("items_total"))
    j = docs.join(sums, key)
    diff = F.abs(F.col("items_total") - F.col(stated))
    return j.withColumn("is_valid", ~((F.col(stated) != 0) & (diff > F.lit("0.01").cast("decimal(4,2)"))))


def cross_rule(rule: dict, fields: Column, aliases: dict[str, str] | None = None) -> Column:
    """A configured rule over a field map; NULL where a date rule lacks one of its fields."""
    aliases = config.FIELD_ALIASES if aliases is None else aliases

    def value(name):
        v = F.try_element_at(fields, F.lit(name))
        return F.coalesce(v, F.try_element_at(fields, F.lit(aliases[name]))) if name in aliases else v

    def present(name):
        p = F.map_contains_key(fields, name)
        return (p | F.map_contains_key(fields, aliases[name])) if name in aliases else p

    name, kind = rule.get("name", "unnamed_rule"), rule.get("type")
    if kind == "date_sequence":
        a, b = rule["field1"], rule["field2"]
        return F.when(present(a) & present(b), date_sequence(value(a), value(b), a, b, rule.get("rule", "date1_before_date2"), name))
    if kind == "amount_consistency":
        needed = rule.get("fields", [])
        missing = F.filter(F.array(*[F.when(~present(n), F.lit(n)) for n in needed]), lambda m: m.isNotNull())
        message = F.concat(F.lit("Missing fields for amount validation: ["), F.array_join(F.transform(missing, lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "), F.lit("]"))
        return F.when(F.size(missing) > 0, result(name, F.lit(False), "warning", message, name)).otherwise(
            F.struct(F.lit("amount_consistency").alias("field_name"), *[amount_consistency({n: value(n) for n in needed}, rule["formula"], name)[c].alias(c)
                     for c in ("is_valid", "severity", "message", "rule_name", "suggested_value")]))
    return result(name, F.lit(False), "error", F.lit(f"Unknown business rule type: {kind}"), name)


def union_rules(default: list[dict], custom: list[dict] | None) -> list[dict]:
    return [*default, *(custom or [])]
