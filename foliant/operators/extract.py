"""Field extraction: document text and recognised fields to an array of field values per document.

The schemas are compiled into expressions on the driver, so the whole cascade is one narrow
projection of the document row: nothing is shuffled, and a long table is one explode away.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.config import DocSchema, FieldSpec
from foliant.functions import parse

TEXT, LOW, LABELS, ANY_DATE, ANY_MONEY, HITS = "__text", "__low", "__labels", "__any_date", "__any_money", "__hits"
#: Stands before and after each label of the labels found in a text.
EDGE = "\x01"


class LabelIndex:
    """All labels of some fields as one pattern, so that a text is looked through once for all of them.

    The labels are a tree of letters; a place in the text gives the longest label that stands there, and a shorter one that is
    followed by a blank or colon inside it is known to stand there too.
    """

    def __init__(self, specs) -> None:
        self.labels = sorted({lb.lower() for f in specs for lb in (f.name, *f.synonyms)})

    def pattern(self) -> str:
        tree: dict = {}
        for label in self.labels:
            node = tree
            for c in label:
                node = node.setdefault(c, {})
            node[""] = {}
        return rf"(?im)(?:^|(?<=\s))(?=({_branches(tree)})[:\s])"

    def found_sql(self, text: str) -> str:
        """The labels that stand in a text, in lower case, as one text with an edge around each."""
        if not self.labels:
            return "''"
        edge = text_literal(EDGE)
        return f"concat({edge}, lower(array_join(regexp_extract_all({text}, {text_literal(self.pattern())}, 1), {edge})), {edge})"

    def stands_sql(self, label: str) -> str:
        """Whether a label stands in the text whose labels are known; a search in a short text is cheaper than one in an array."""
        low = label.lower()
        ends = [EDGE, *(c for c in ": \t" if any(x.startswith(low + c) for x in self.labels))]
        return "(" + " OR ".join(f"contains({LABELS}, {text_literal(EDGE + low + c)})" for c in ends) + ")"


def _branches(tree: dict) -> str:
    """The letters that may follow, with the end of a label as the last choice."""
    ways = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) + _branches(tree[c]) for c in sorted(tree, reverse=True) if c]
    if "" in tree:
        ways.append("")
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


#: Labels of all configured schemas.
ALL_LABELS = LabelIndex([f for s in (*config.SCHEMAS.values(), config.GENERIC) for f in s.fields])


def text_literal(s: str | None) -> str:
    """A SQL string literal."""
    return "CAST(NULL AS STRING)" if s is None else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field_sql(name: str, label: str, value: str, confidence: str, source: str, method: str) -> str:
    """A field value struct as SQL text; the arguments but the method are SQL expressions."""
    return (f"named_struct('field_name', {name}, 'matched_label', {label}, 'value', {value}, 'confidence', CAST({confidence} AS DOUBLE), "
            f"'source_text', {source}, 'method', '{method}')")


def label_pattern(label: str, field_type: str) -> str:
    value = config.LABEL_VALUE_PATTERNS.get(field_type, config.LABEL_VALUE_PATTERNS["text"])
    return rf"(?im)(?:^|\s)(\Q{label}\E)[:\s]+{value}"


def structured_sql(spec: FieldSpec, ocr_fields: str) -> str:
    """Strategy 1: the first recognised field whose name equals the schema name, case ignored."""
    hit = f"filter({ocr_fields}, f -> lower(f.field_name) = {text_literal(spec.name.lower())})"
    found = field_sql(text_literal(spec.name), "CAST(NULL AS STRING)", "f.value", "coalesce(f.confidence, 1.0)", "f.value", "ocr_structured")
    return f"get(transform({hit}, f -> {found}), 0)"


def hit_sql(spec: FieldSpec, compat: bool = False, index: LabelIndex = ALL_LABELS) -> str:
    """The matched text of the first label, name and synonyms in order, with a value of the field's type.

    Only labels that the index has found in the text are looked at, and each once (``nullif`` would search twice).
    """
    text = LOW if compat else TEXT
    hit = lambda x: f"regexp_extract({text}, {text_literal(label_pattern(x, spec.field_type))}, 0)"
    arms = [f"CASE WHEN {index.stands_sql(x)} THEN get(filter(array({hit(x)}), s -> s <> ''), 0) END" for x in (spec.name, *spec.synonyms)]
    return f"coalesce({', '.join(arms)})"


def hit_field_sql(spec: FieldSpec, hit: str, compat: bool = False) -> str:
    """A matched text as field value; it is taken apart by one pattern over all labels, which only ever sees the short matched text.

    ``compat`` names the field after the label that matched and reads the text in lower case.
    """
    either = text_literal(label_pattern(r"\E|\Q".join((spec.name, *spec.synonyms)), spec.field_type))
    label = f"lower(regexp_extract({hit}, {either}, 1))"
    value = f"btrim(regexp_extract({hit}, {either}, 2), {text_literal(parse.WS_TEXT)})"
    found = field_sql(label if compat else text_literal(spec.name), label, value, str(config.CONF_LABEL), hit, "pattern_match")
    return f"CASE WHEN {hit} IS NOT NULL THEN {found} END"


def label_sql(spec: FieldSpec, compat: bool = False, index: LabelIndex = ALL_LABELS) -> str:
    """Strategy 2: name and synonyms in order; the first label with a value of the field's type."""
    return f"transform(array({hit_sql(spec, compat, index)}), s -> {hit_field_sql(spec, 's', compat)})[0]"


def third_sql(spec: FieldSpec) -> str | None:
    """Strategy 3: the text's largest amount or first date, by field type."""
    kinds = {"currency": (ANY_MONEY, config.CONF_CURRENCY, "pattern_currency"), "date": (ANY_DATE, config.CONF_DATE, "pattern_date")}
    if spec.field_type not in kinds:
        return None
    column, confidence, method = kinds[spec.field_type]
    found = field_sql(text_literal(spec.name), "CAST(NULL AS STRING)", column, str(confidence), column, method)
    return f"CASE WHEN {column} IS NOT NULL THEN {found} END"


def default_sql(spec: FieldSpec) -> str | None:
    if spec.default is None:
        return None
    return field_sql(text_literal(spec.name), "CAST(NULL AS STRING)", text_literal(spec.default), str(config.CONF_DEFAULT), "'default'", "default")


def cascade_sql(spec: FieldSpec, ocr_fields: str | None = None, compat: bool = False, index: LabelIndex = ALL_LABELS, hit: str | None = None) -> str:
    """All strategies in order over a frame prepared by :func:`with_text`; ``hit`` is a column of the matched text where that is known."""
    label = label_sql(spec, compat, index) if hit is None else hit_field_sql(spec, hit, compat)
    steps = [None if ocr_fields is None else structured_sql(spec, ocr_fields), label, third_sql(spec), default_sql(spec)]
    return f"coalesce({', '.join(s for s in steps if s)})"


def extract_structured(spec: FieldSpec, ocr_fields: str = "ocr_fields") -> Column:
    return F.expr(structured_sql(spec, ocr_fields))


def extract_by_label(spec: FieldSpec, compat: bool = False, index: LabelIndex = ALL_LABELS) -> Column:
    return F.expr(label_sql(spec, compat, index))


def extract_max_currency(spec: FieldSpec) -> Column:
    return F.expr(third_sql(spec))


def extract_first_date(spec: FieldSpec) -> Column:
    return F.expr(third_sql(spec))


def cascade(spec: FieldSpec, ocr_fields: str | None = None, compat: bool = False, index: LabelIndex = ALL_LABELS) -> Column:
    return F.expr(cascade_sql(spec, ocr_fields, compat, index))


def max_currency(text: Column) -> Column:
    """The largest dollar amount anywhere in a text, as money text."""
    found = F.regexp_extract_all(text, F.lit(config.ANY_CURRENCY), F.lit(0))
    top = F.array_max(F.transform(found, lambda m: F.regexp_replace(m, "[$,]", "").try_cast("decimal(18,2)")))
    return F.when(text.contains("$"), F.concat(F.lit("$"), F.format_number(top, 2)))


def first_date(text: Column, compat: bool = False) -> Column:
    """The first hit of three date patterns in order.

    By default a date inside a longer digit run is no hit and ISO dates are a pattern of their own;
    ``compat`` finds ``24-01-15`` in ``2024-01-15``.
    """
    slash, dash, named = config.ANY_DATES
    patterns = [slash, dash, named] if compat else [slash, r"(?<![0-9-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"(?<![0-9])" + dash, named]
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 0)) for p in patterns])


def with_text(docs: DataFrame, text_col: str, compat: bool = False, labels: LabelIndex | Column = ALL_LABELS) -> DataFrame:
    """Adds what all fields of a text share: the text, its lower case, the labels that stand in it, its first date and largest amount.

    ``labels`` is the index of the fields to come, or the column of labels where it differs from row to row.
    """
    out = docs.withColumn(TEXT, F.coalesce(text_col, F.lit(""))).withColumn(LOW, F.lower(TEXT))
    name = LOW if compat else TEXT
    found = F.expr(labels.found_sql(name)) if isinstance(labels, LabelIndex) else labels
    return out.withColumns({LABELS: found, ANY_DATE: first_date(F.col(name), compat), ANY_MONEY: max_currency(F.col(name))})


def by_type(document_type: Column, schemas: dict[str, DocSchema], build, generic: DocSchema = config.GENERIC) -> Column:
    """CASE over the document types, with the generic schema for all others."""
    out = None
    for name, schema in schemas.items():
        out = F.when(document_type == name, build(schema)) if out is None else out.when(document_type == name, build(schema))
    return build(generic) if out is None else out.otherwise(build(generic))


def extract_fields(docs: DataFrame, schemas: dict[str, DocSchema] | None = None, text_col: str = "full_text",
                   type_col: str = "document_type", ocr_fields_col: str | None = "ocr_fields", compat: bool = False) -> DataFrame:
    """Adds ``fields``: the non-null field values of the document's schema, in schema order, normalised."""
    schemas = config.SCHEMAS if schemas is None else schemas
    ocr = f"`{ocr_fields_col}`" if ocr_fields_col and ocr_fields_col in docs.columns else None

    def hits(s: DocSchema) -> Column:
        index = LabelIndex(s.fields)
        return F.expr(f"array({', '.join(hit_sql(f, compat, index) for f in s.fields)})")

    def found(s: DocSchema) -> Column:
        return F.expr(f"array({', '.join(cascade_sql(f, ocr, compat, hit=f'get({HITS}, {i})') for i, f in enumerate(s.fields))})")

    labels = by_type(F.col(type_col), schemas, lambda s: F.expr(LabelIndex(s.fields).found_sql(LOW if compat else TEXT)))
    # The labels' hits are a column of their own, outside of lambdas: Spark compiles it, and lambdas it walks through.
    text = with_text(docs, text_col, compat, labels).withColumn(HITS, by_type(F.col(type_col), schemas, hits))
    raw = by_type(F.col(type_col), schemas, found)
    fields = F.transform(F.filter(raw, lambda f: f.isNotNull()), normalize_field)
    return text.withColumn("fields", fields).drop(TEXT, LOW, LABELS, ANY_DATE, ANY_MONEY, HITS)


def normalize_field(f: Column) -> Column:
    norm = parse.normalized(f["field_name"], f["value"], list(config.NORMALIZED_DATES), list(config.NORMALIZED_AMOUNTS))
    keep = ("field_name", "matched_label", "value", "confidence", "source_text", "method")
    return F.struct(*[f[k].alias(k) for k in keep], *[c.alias(n) for n, c in norm.items()])


def field_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The long table: one row per document and field."""
    return explode_rows(docs, keys, F.col("fields"))


def explode_rows(df: DataFrame, keys: list[str], structs: Column) -> DataFrame:
    """One row per array element, its struct spread out.

    The outer form keeps the optimizer from testing the array's size below the explode, which would
    compute an expensive array twice; the empty row it makes is dropped above.
    """
    return df.select(*keys, F.explode_outer(structs).alias("__e")).where(F.col("__e").isNotNull()).select(*keys, "__e.*")


def by_name(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["field_name"] == name), F.lit(0))


def field_value(fields: Column, name: str) -> Column:
    """Normalised value as text, or the raw value; NULL without the field."""
    f = by_name(fields, name)
    return F.coalesce(f["norm_date"].cast("string"), F.when(f["norm_amount"] != 0, parse.amount_text(f["value"])), f["norm_text"], f["value"])


def field_confidence(fields: Column, name: str) -> Column:
    return F.coalesce(by_name(fields, name)["confidence"], F.lit(0.0))


def high_confidence_fields(fields: Column, threshold: float = 0.8) -> Column:
    return F.filter(fields, lambda f: f["confidence"] >= threshold)


def detected_field_map(df: DataFrame, fields: str, out: str) -> DataFrame:
    """Adds name -> (content, confidence); the last of repeated names wins. Fields are sorted by name and each run's first is kept."""
    df = df.withColumn("__sorted", F.array_sort(F.transform(fields, lambda f, i: F.struct(
        f["field_name"].alias("name"), (-i).alias("o"), F.struct(f["value"].alias("content"), f["confidence"].alias("confidence")).alias("v")))))
    last = F.filter(F.transform("__sorted", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                    lambda y: (y["i"] == 0) | ~F.get("__sorted", y["i"] - 1)["name"].eqNullSafe(y["x"]["name"]))
    return df.withColumn(out, F.map_from_entries(F.transform(last, lambda y: F.struct(y["x"]["name"], y["x"]["v"])))).drop("__sorted")
