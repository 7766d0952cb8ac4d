"""Queries of validation rules and bands over field maps of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.functions import luhn, parse, rules
from foliant.functions import status as S
from foliant.operators import validate
from foliant.plans import sql as Q
from foliant.plans.registry import query
from foliant.sources import adapters as A

TODAY = "1999-06-01"


def docs(spark, d):
    return A.field_docs(spark, d)


def val(name):
    return F.col("fields")[name]


def result_query(name, build, valid, message, suggested="null::varchar", where="true", prepare=lambda df: df):
    """A query of one reporting rule: id, verdict, severity, message, suggestion."""
    sql = f"""with {Q.FD} select document_id, coalesce({valid},false) as is_valid, case when coalesce({valid},false) then 'info' else 'error' end as severity,
      {message} as message, {suggested} as suggested_value from fd where {where}"""

    @query(name, sql)
    def _(spark, d):
        r = prepare(docs(spark, d)).select("document_id", build().alias("r")).where(F.col("r").isNotNull())
        return r.select("document_id", "r.is_valid", "r.severity", "r.message", "r.suggested_value")


def verdict(ok):
    return f"case when {ok} then 'passed' else 'failed' end"


_ALNUM = "regexp_matches(invoice_number,'^(?:[A-Za-z0-9-]+$)')"
result_query("rule_required", lambda: rules.rule_required(F.lit("invoice_number"), val("invoice_number")),
             "false", "'Required field ''invoice_number'' is empty'", where="trim(invoice_number)=''")
result_query("rule_regex", lambda: rules.rule_regex(val("invoice_number"), r"[A-Za-z0-9-]+$"), f"invoice_number<>'' and {_ALNUM}",
             f"case when invoice_number='' then 'Empty value for regex validation' else 'Regex validation '||{verdict(_ALNUM)}||': [A-Za-z0-9-]+$' end")
_LUHN = f"({Q.luhn('card')}) = 0"
result_query("rule_luhn", lambda: rules.rule_luhn(val("card")), _LUHN, f"'Luhn validation '||{verdict(_LUHN)}||' for: '||card")
_D = Q.to_date("due_date")
# Due dates as they are, day first, with the month's name and with a time.
_V = f"case key%6 when 1 then strftime({_D},'%d/%m/%Y') when 2 then strftime({_D},'%d %B %Y') when 3 then strftime({_D},'%Y-%m-%dT10:00:00') when 4 then strftime({_D},'%d.%m.%Y') else due_date end"
_VD = f"coalesce({Q.to_date(_V)}, try_strptime({_V},'%d.%m.%Y')::date)"


def with_varied_date(df):
    """The due date is read in a step of its own, once for all forms."""
    k, forms = F.col("key") % 6, {1: "dd/MM/yyyy", 2: "dd MMMM yyyy", 3: "yyyy-MM-dd'T'10:00:00", 4: "dd.MM.yyyy"}
    out = val("due_date")
    for n, f in forms.items():
        out = F.when(k == n, F.date_format("due", f)).otherwise(out)
    return df.withColumn("due", parse.to_date(val("due_date"))).withColumn("varied", out)


result_query("rule_date_format", lambda: rules.rule_date_format(F.col("varied"), ("%Y-%m-%d", "%d.%m.%Y")), f"{_VD} is not null",
             f"case when {_V} is null then 'Empty date value' when {_VD} is null then 'Date format validation failed. Tried formats: [''%Y-%m-%d'', ''%d.%m.%Y'']' when key%6=4 then 'Date parsed with format %d.%m.%Y: '||{_VD}::varchar else 'Date parsed successfully: '||{_VD}::varchar end", f"{_VD}::varchar",
             prepare=with_varied_date)
result_query("rule_date_range", lambda: rules.rule_date_range(val("due_date"), "1996-01-01", "2000-12-31"),
             f"{_D} between date '1996-01-01' and date '2000-12-31'",
             f"""case when {_D} is null then 'Cannot parse date for range validation: '||due_date when {_D}<date '1996-01-01' then 'Date '||{_D}||' is before minimum 1996-01-01'
               when {_D}>date '2000-12-31' then 'Date '||{_D}||' is after maximum 2000-12-31' else 'Date range validation passed' end""")
_N = "try_cast(regexp_replace(total_amount,'[$£€¥\\s,]','','g') as decimal(28,6))"
result_query("rule_numeric_range", lambda: rules.rule_numeric_range(val("total_amount"), 1000, 250000), f"{_N} between 1000 and 250000",
             f"case when {_N} between 1000 and 250000 then 'Numeric range validation passed' else 'Value '||total_amount||' not in range [1000, 250000]' end")
_C = "try_cast(regexp_replace(c,'[$£€¥\\s,]','','g') as decimal(28,6))"


@query("rule_currency", f"""with {Q.FD}, x as (select document_id, case when key%3=0 then email else total_amount end as c from fd), y as (select *, {_C} as n from x)
  select document_id, n is not null as is_valid, case when n is not null then 'info' else 'error' end as severity,
   case when n is null then 'Invalid currency format: '||c else 'Currency validated and normalized: $'||n::decimal(28,2) end as message, '$'||n::decimal(28,2) as suggested_value from y""")
def _(spark, d):
    v = F.when(F.col("key") % 3 == 0, val("email")).otherwise(val("total_amount"))
    return docs(spark, d).select("document_id", rules.rule_currency(v).alias("r")).select("document_id", "r.is_valid", "r.severity", "r.message", "r.suggested_value")


_EM = "regexp_matches(email,'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')"
result_query("rule_email", lambda: rules.rule_email(val("email")), _EM, f"'Email validation '||{verdict(_EM)}||': '||email")
_PH = "regexp_matches(regexp_replace(phone,'[\\s().-]','','g'),'^[+]?[1-9]?[0-9]{7,15}$')"
result_query("rule_phone", lambda: rules.rule_phone(val("phone")), _PH, f"'Phone validation '||{verdict(_PH)}||' (basic): '||phone")
result_query("rule_length", lambda: rules.rule_length(val("email"), 10, 17), "false",
             "'Length '||length(email)||' not in range [10, 17]'", where="length(email) not between 10 and 17")


@query("pattern_library", f"with {Q.FD} select field_name, pattern, count(*) as matches from (" + " union all ".join(
    f"select field_name, '{n}' as pattern from fv where regexp_matches(value, '{p}')" for n, p in config.PATTERNS.items()) + ") group by 1,2")
def _(spark, d):
    hits = F.filter(F.array(*[F.when(F.col("value").rlike(rules.check_pattern(p)), F.lit(n)) for n, p in config.PATTERNS.items()]), lambda x: x.isNotNull())
    return A.field_values(spark, d).select("field_name", F.explode(hits).alias("pattern")).groupBy("field_name", "pattern").agg(F.count(F.lit(1)).alias("matches"))


@query("luhn_check_digit", f"with {Q.FD} select document_id, case when key%4=0 then null else ((10 - ({Q.luhn(chr(40) + 'card' + chr(124)*2 + chr(39) + '0' + chr(39) + chr(41))}))%10)::bigint::varchar end as check_digit from fd")
def _(spark, d):
    v = F.when(F.col("key") % 4 == 0, val("email")).otherwise(val("card"))
    return docs(spark, d).select("document_id", luhn.luhn_check_digit(v).alias("check_digit"))


def schema_rule_query(name, rule, field, ok, strict=False):
    @query(name, f"with {Q.FD} select document_id, coalesce({ok},false) as passes from fd")
    def _(spark, d):
        v = rules.value_of(val(field), TODAY)
        return docs(spark, d).select("document_id", F.coalesce(rules.schema_rule(rule, v, strict), F.lit(False)).alias("passes"))


_DATE = Q.to_date("due_date")
_AMT = "try_cast(regexp_replace(total_amount,'[^0-9.-]','','g') as double)"
schema_rule_query("rule_not_empty", "not_empty", "invoice_number", "trim(invoice_number)<>''")
schema_rule_query("rule_min_length", "min_length:7", "invoice_number", "length(invoice_number)>=7")
schema_rule_query("rule_max_length", "max_length:6", "invoice_number", "length(invoice_number)<=6")
schema_rule_query("rule_alphanumeric", "alphanumeric", "invoice_number", "regexp_matches(invoice_number,'^[a-zA-Z0-9\\s\\-_]+$')")
schema_rule_query("rule_valid_date", "valid_date", "due_date", f"{_DATE} is not null")
schema_rule_query("rule_past_date", "past_date", "due_date", f"{_DATE} <= date '{TODAY}'")
schema_rule_query("rule_future_date", "future_date", "due_date", f"{_DATE} >= date '{TODAY}'")
schema_rule_query("rule_positive_amount", "positive_amount", "total_amount", f"{_AMT} > 0")
schema_rule_query("rule_non_negative_amount", "non_negative_amount", "phone", "try_cast(regexp_replace(phone,'[^0-9.-]','','g') as double) >= 0")
schema_rule_query("rule_currency_format", "currency_format", "total_amount", "regexp_matches(total_amount,'^\\$?[0-9,]+(?:\\.[0-9]{2})?$')")
schema_rule_query("rule_payment_method", "valid_payment_method", "payment_method", "contains(lower(payment_method),'visa') or contains(lower(payment_method),'cash')")
schema_rule_query("rule_valid_email", "valid_email", "email", _EM)
schema_rule_query("rule_valid_phone", "valid_phone", "phone", _PH)
schema_rule_query("rule_schema_extra", "reasonable_age", "due_date", f"{_DATE} <= date '{TODAY}'", strict=True)


@query("custom_rule", f"with {Q.FD} select document_id, key%13<>0 and key%5<>0 and length(invoice_number)%2=0 as passes from fd")
def _(spark, d):
    own = {"even_length": lambda v, _=None: v.text.startswith("INV-") & (F.length(v.text) % 2 == 0)}
    v = rules.value_of(val("invoice_number"), TODAY)
    return docs(spark, d).select("document_id", rules.schema_rule("even_length", v, custom=own).alias("passes"))


_TYPE = """case when contains(n,'date') then 'date' when regexp_matches(n,'amount|total|price|cost|sum') then 'currency'
  when regexp_matches(n,'number|id|code') then 'alphanumeric' when contains(n,'email') then 'email' when contains(n,'phone') then 'phone' else 'text' end"""


@query("infer_field_type", f"with {Q.FD}, x as (select lower(field_name) n from fv) select n as field_name, {_TYPE} as field_type, count(*) as n from x group by 1, 2".replace("count(*) as n", "count(*) as fields"))
def _(spark, d):
    return A.field_values(spark, d).groupBy("field_name", S.infer_field_type(F.col("field_name")).alias("field_type")).agg(F.count(F.lit(1)).alias("fields"))


@query("infer_field_config", f"""with {Q.FD}, x as (select *, lower(field_name) n from fv), y as (select *, {_TYPE} as field_type from x)
  select document_type, field_name, field_type, (document_type='invoice' and field_name='invoice_number') as required,
   case field_type when 'text' then 1 end::integer as min_length, field_type='date' as check_date, case when field_type='date' then '{",".join(config.DATE_FORMATS)}' end as date_formats, field_type='currency' as check_range, count(*) as fields
  from y group by all""")
def _(spark, d):
    out = validate.infer_field_config(A.field_values(spark, d)).withColumn("date_formats", F.array_join("date_formats", ","))
    return out.groupBy("document_type", "field_name", "field_type", "required", "min_length", "check_date", "date_formats", "check_range").agg(F.count(F.lit(1)).alias("fields"))


@query("confidence_band", f"""with {Q.RT} select task_id, case when errors>0 then 'red' when c<0.7 then 'orange' when c<0.9 then 'yellow' else 'green' end as total_band
  from (select *, (50+(key*7)%50)/100.0::double as c from tasks)""")
def _(spark, d):
    f = F.col("extracted_fields")[1]
    return A.review_tasks(spark, d).select("task_id", S.confidence_band(f["confidence"], f["violations"]).alias("total_band"))


def norm_query(name, build, sql_expr, prepare=lambda df: df):
    @query(name, f"with {Q.FD} select document_id, {sql_expr} as value from fd")
    def _(spark, d):
        return prepare(docs(spark, d)).select("document_id", build().alias("value"))


norm_query("normalize_date", lambda: parse.to_date(F.col("varied")), Q.to_date(_V), with_varied_date)
norm_query("normalize_currency", lambda: parse.to_amount(val("total_amount")).cast("double"), "try_cast(regexp_replace(total_amount,'[^0-9.-]','','g') as double)")
norm_query("normalize_phone", lambda: parse.to_phone(val("phone")), "case when key%8=0 then phone else '+1'||regexp_replace(phone,'[^0-9]','','g') end")
norm_query("normalize_email", lambda: parse.to_email(val("email")), "case when key%9=0 then email else 'c'||key||'@example.com' end")


#: A field for each strict rule: its value per key in Spark and SQL, and the SQL condition on which it fails.
STRICT = {
    "positive_number": ("quantity", lambda k: (k % 5 - 1).cast("string"), "key%5<2"),
    "between_0_and_1": ("share", lambda k: ((k % 7) / 5.0).cast("string"), "key%7>5"),
    "alphabetic": ("first_name", lambda k: A.pick(["Ann-Lee", "R2D2"], k), "key%2=1"),
    "reasonable_age": ("birth_date", lambda k: A.pick(["1850-01-01", "2050-01-01", "1980-05-05"], k), "key%3<2"),
    "valid_gender": ("gender", lambda k: A.pick(["M", "female", "robot"], k), "key%3=2"),
    "valid_height": ("height", lambda k: A.pick(["180 cm", "6 ft", "tall"], k), "key%3=2"),
    "valid_weight": ("weight", lambda k: A.pick(["150 lb", "80kg", "heavy", "1 kg"], k), "key%4>=2"),
    "valid_eye_color": ("eye_color", lambda k: A.pick(["Blue", "red", "BRO"], k), "key%3=1"),
    "valid_language_code": ("language", lambda k: A.pick(["en", "German", "xx"], k), "key%3=2"),
    "future_date_from_invoice": ("due_date", lambda _: F.col("due_date").cast("string"), "due_date < doc_date"),
    "after_effective_date": ("expiration_date", lambda _: F.date_format("due_date", "M/d/yyyy"), "due_date <= doc_date"),
}
_STRICT_SCHEMA = {"strict": config.DocSchema("strict", fields=tuple(
    config.FieldSpec(name, required=i % 2 == 0, rules=(rule, "not_empty")) for i, (rule, (name, _, _)) in enumerate(STRICT.items())))}


@query("strict_rules", f"with {Q.OD} " + " union all ".join(
    f"select document_id, '{name}' as field_name, '{rule}' as rule_name, '{'error' if i % 2 == 0 else 'warning'}' as severity from od where {fails}"
    for i, (rule, (name, _, fails)) in enumerate(STRICT.items())))
def _(spark, d):
    """All strict rules over a long table; two of them look at another field of the document."""
    values = [F.struct(F.lit(name).alias("field_name"), value(F.col("key")).alias("value")) for name, value, _ in STRICT.values()]
    values += [F.struct(F.lit(n).alias("field_name"), F.col("doc_date").cast("string").alias("value")) for n in ("invoice_date", "effective_date")]
    rows = A.order_docs(spark, d).select("document_id", F.lit("strict").alias("document_type"), F.explode(F.array(*values)).alias("f")).select("document_id", "document_type", "f.*")
    return validate.validate_field_rows(rows, TODAY, _STRICT_SCHEMA, strict=True).select("document_id", "field_name", "rule_name", "severity")
