"""Field validation: schema rules on extracted values, inferred rules on field maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.config import DocSchema, FieldSpec
from foliant.functions import parse, rules
from foliant.functions.status import infer_field_type
from foliant.operators import crossfield, tables
from foliant.operators.extract import by_name, by_type, explode_rows

#: Rules of the caller's own, by name.
Rules = dict[str, Callable[..., Column]] | None

RESULT = "array<struct<field_name:string,is_valid:boolean,severity:string,message:string,rule_name:string,suggested_value:string>>"


def _present(results: list[Column]) -> Column:
    if not results:
        return F.array().cast(RESULT)
    return F.filter(F.array(*results), lambda r: r.isNotNull())


def _failures(schema: DocSchema, spec: FieldSpec, v: rules.Value, strict: bool, custom: Rules) -> list[Column]:
    """The failed rules of one field of one type, each NULL where it passes."""
    out = []
    for rule in spec.rules:
        ok = rules.schema_rule(rule, v, strict, custom)
        if ok is not None:
            out.append(F.when(~F.coalesce(ok, F.lit(False)), F.struct(
                F.lit(spec.name).alias("field_name"), F.lit(False).alias("is_valid"), F.lit("error" if spec.required else "warning").alias("severity"),
                F.lit(f"Field '{spec.name}' failed validation rule '{rule}'").alias("message"), F.lit(rule).alias("rule_name"),
                F.lit(None).cast("string").alias("suggested_value"))))
    return out


def value_failures(document_type: Column, name: Column, value_of, schemas: dict[str, DocSchema], strict: bool, custom: Rules = None) -> Column:
    """The failed schema rules of one value as an array; errors for required fields, warnings for others.

    Rules are compiled per type and field, and a value meets those of its own field only. ``value_of`` gives the
    :class:`rules.Value` for a schema and field; types without a schema have no rules.
    """
    none = F.array().cast(RESULT)
    types = None
    for schema in schemas.values():
        fields = None
        for spec in schema.fields:
            failed = _failures(schema, spec, value_of(spec), strict, custom)
            if failed:
                fields = (F if fields is None else fields).when(name == spec.name, _present(failed))
        if fields is not None:
            types = (F if types is None else types).when(document_type == schema.document_type, fields.otherwise(none))
    return none if types is None else types.otherwise(none)


#: Fields that rules of other fields look at.
CONTEXT = {"invoice_date": "invoice_date", "effective_date": "effective_date"}


def with_context(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds ``__ctx`` to a long table: the values that rules of other fields look at, from the rows of the same document.

    One map-side combined aggregation over those few rows; a field that is there twice counts with its least value.
    """
    wanted = rows.where(F.col("field_name").isin(*CONTEXT))
    each = [F.min(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in CONTEXT]
    context = wanted.groupBy(*keys).agg(*each).select(*keys, F.struct(*CONTEXT).alias("__ctx"))
    return rows.join(context, list(keys), "left")


def validate_field_rows(rows: DataFrame, as_of, schemas: dict[str, DocSchema] | None = None, strict: bool = False,
                        keys: tuple[str, ...] = ("document_id",), custom: Rules = None) -> DataFrame:
    """Long form: failed rules of a (keys, document_type, field_name, value) table.

    In strict mode, and with rules of the caller's own, values see the dates of their document that they may be compared with.
    """
    schemas = config.SCHEMAS if schemas is None else schemas
    norm = parse.normalized(F.col("field_name"), F.col("value"), list(config.NORMALIZED_DATES), list(config.NORMALIZED_AMOUNTS))
    typed = with_context(rows, keys) if strict or custom else rows
    other = {n: parse.to_date(F.col(f"__ctx.{f}")) for n, f in CONTEXT.items()} if strict or custom else {}
    v = rules.Value(F.col("value"), F.col("__nd"), F.col("__na"), F.lit(str(as_of)).cast("date"), **other)
    typed = typed.withColumns({"__nd": norm["norm_date"], "__na": norm["norm_amount"]})
    return explode_rows(typed, list(keys), value_failures(F.col("document_type"), F.col("field_name"), lambda _: v, schemas, strict, custom))


def business_rules(fields: Column, tables_col: Column | None, schema: DocSchema) -> Column:
    """Results of the schema's named rules; names without a rule give nothing."""
    amount = lambda n: by_name(fields, n)["norm_amount"]
    date = lambda n: by_name(fields, n)["norm_date"]
    out = []
    for rule in schema.business_rules:
        if rule == "total_equals_subtotal_plus_tax":
            out.append(crossfield.total_calc(amount("total_amount"), amount("subtotal"), amount("tax_amount")))
        elif rule == "due_date_after_invoice_date":
            out.append(crossfield.due_date(date("invoice_date"), date("due_date")))
        elif rule in ("line_items_sum_to_subtotal", "items_sum_to_total") and tables_col is not None:
            table, column, stated, what, target = (
                ("line_items", "amount", "subtotal", "Line items", "subtotal") if rule.startswith("line")
                else ("items", "price", "total_amount", "Items", "total"))
            spec = next((t for t in schema.tables if t.name == table), None)
            if spec is not None:
                out.append(crossfield.sum_against(tables.column_sum(tables_col, spec, column), amount(stated), stated, rule, what, target))
    return _present(out)


def validate_fields(docs: DataFrame, as_of, schemas: dict[str, DocSchema] | None = None, tables_col: str | None = "tables",
                    type_col: str = "document_type", strict: bool = False, custom: Rules = None) -> DataFrame:
    """Adds ``validation_results`` to documents with ``fields``: failed schema rules, then business rules."""
    schemas = config.SCHEMAS if schemas is None else schemas
    today = F.lit(str(as_of)).cast("date")
    fields = F.col("fields")
    tabs = F.col(tables_col) if tables_col and tables_col in docs.columns else None
    other = {n: parse.to_date(by_name(fields, f)["value"]) for n, f in CONTEXT.items()}
    per_field = F.flatten(F.transform(fields, lambda f: value_failures(
        F.col(type_col), f["field_name"], lambda _: rules.Value(f["value"], f["norm_date"], f["norm_amount"], today, **other), schemas, strict, custom)))
    cross = by_type(F.col(type_col), schemas, lambda s: business_rules(fields, tabs, s))
    return docs.withColumn("validation_results", F.concat(per_field, cross))


# ---- inferred rules on field maps ----

def _in_type(document_type: Column, table: dict[str, list[str]], name: Column) -> Column:
    out = F.lit(False)
    for t, names in table.items():
        if names:
            out = out | ((F.lower(document_type) == t) & name.isin(*names))
    return out


def infer_field_config(rows: DataFrame) -> DataFrame:
    """Adds the inferred settings of each field of a long table; metadata fields are dropped."""
    kind = infer_field_type(F.col("field_name"))
    pattern = F.create_map(*[F.lit(x) for kv in config.TYPE_PATTERNS.items() for x in kv])
    return rows.where(~F.col("field_name").isin(*config.METADATA_FIELDS)).withColumn("field_type", kind).withColumns({
        "required": _in_type(F.col("document_type"), config.REQUIRED_BY_TYPE, F.col("field_name")),
        "pattern": F.try_element_at(pattern, F.col("field_type")),
        "min_length": F.when(F.col("field_type") == "text", F.lit(config.TEXT_LENGTH[0])),
        "max_length": F.when(F.col("field_type") == "text", F.lit(config.TEXT_LENGTH[1])),
        "check_date": F.col("field_type") == "date",
        "date_formats": F.when(F.col("field_type") == "date", F.array(*[F.lit(f) for f in config.DATE_FORMATS])),
        "check_range": F.col("field_type") == "currency",
    })


def _let(value: Column, build) -> Column:
    """``build`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _inferred_checks(value: Column) -> dict[str, list[Column]]:
    """Per inferred kind of field, the reports of its rules; NULL where a rule has nothing to say."""
    def fits(pattern: str) -> Column:
        return _let(rules.regex_ok(value, pattern), lambda ok: rules.regex_report(value, pattern, ok))

    checks = {k: [fits(p)] for k, p in config.TYPE_PATTERNS.items()}
    more = {
        "date": _let(rules.date_found(value), lambda found: rules.date_report(value, found)),
        "currency": _let(parse.to_money(value), lambda n: rules.range_report(value, n, *config.NUMERIC_RANGE)),
        "text": rules.rule_length(value, *config.TEXT_LENGTH),
    }
    for kind, report in more.items():
        checks.setdefault(kind, []).append(report)
    return checks


def map_results(document_type: Column, name: Column, value: Column) -> Column:
    """All results, passes included, of the inferred rules on one field; a required blank stops the rest.

    The kind of the field is inferred once and only its own rules are looked at.
    """
    required = _in_type(document_type, config.REQUIRED_BY_TYPE, name)

    def named(r: Column) -> Column:
        return F.struct(name.alias("field_name"), *[r[c].alias(c) for c in ("is_valid", "severity", "message", "rule_name", "suggested_value")])

    def by_kind(kind: Column) -> Column:
        out = None
        for k, reports in _inferred_checks(value).items():
            out = (F if out is None else out).when(kind == k, F.filter(F.array(*reports), lambda r: r.isNotNull()))
        return out

    some = F.coalesce(value != "", F.lit(False))
    return (
        F.when(required & parse.is_blank(value), F.array(named(rules.rule_required(name, value))))
        .when(some, F.coalesce(F.transform(_let(infer_field_type(name), by_kind), named), F.array().cast(RESULT)))
        .otherwise(F.array().cast(RESULT))
    )


def validate_document(docs: DataFrame, custom_rules: list[dict] | None = None, fields_col: str = "fields", type_col: str = "document_type") -> DataFrame:
    """Adds ``validation_results`` to documents with a field map: inferred rules, default and custom cross rules.

    The map is walked inside the row; passes are reported with severity info.
    """
    fields = F.col(fields_col)
    entries = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*config.METADATA_FIELDS))
    per_field = F.flatten(F.transform(entries, lambda e: map_results(F.col(type_col), e["key"], e["value"])))
    cross = [crossfield.cross_rule(r, fields) for r in crossfield.union_rules(config.DEFAULT_CROSS_RULES, custom_rules)]
    return docs.withColumn("validation_results", F.concat(per_field, _present(cross)))
