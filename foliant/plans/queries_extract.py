"""Queries of field extraction, tables and layout over recognised documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.functions import parse
from foliant.operators import extract as X
from foliant.operators import tables as T
from foliant.plans import sql as Q
from foliant.plans.registry import query
from foliant.sources import adapters as A


def ocr(spark, d, *columns):
    return A.ocr_docs(spark, d).select("document_id", "document_type", "key", *columns)


def _pattern(label, kind):
    return X.label_pattern(label, kind).replace("'", "''")


def label_sql(spec, group):
    """First label in order with a value: group 0 is the source, 2 the value."""
    arms = " ".join(f"when regexp_matches(full_text,'{_pattern(lb, spec.field_type)}') then trim(regexp_extract(full_text,'{_pattern(lb, spec.field_type)}',{group}), E' \\t\\n\\r')"
                    for lb in (spec.name, *spec.synonyms))
    return f"case {arms} end"


def label_name_sql(spec):
    arms = " ".join(f"when regexp_matches(full_text,'{_pattern(lb, spec.field_type)}') then {Q.names([lb])}" for lb in (spec.name, *spec.synonyms))
    return f"case {arms} end"


_MAX = "list_max(list_transform(regexp_extract_all(full_text,'\\$[0-9,]+(?:\\.[0-9]{2})?'), lambda m: try_cast(replace(replace(m,'$',''),',','') as decimal(18,2))))"
_MAXTXT = f"'$'||format('{{:,.2f}}', ({_MAX})::double)"


def _date_arm(p, group=0):
    return f"when regexp_matches(full_text,'{p}') then regexp_extract(full_text,'{p}',{group})"


_FIRST_DATE = "case " + " ".join([
    _date_arm("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"), _date_arm("(?:^|[^0-9-])([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1),
    _date_arm("(?:^|[^0-9])([0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4})", 1), _date_arm("[A-Za-z]{3,9}\\s+[0-9]{1,2},?\\s+[0-9]{2,4}")]) + " end"


@query("extract_structured", f"""with {Q.OD} select document_id, '$'||case when key%3=0 then total::varchar else '1.00' end as value,
  round(case when key%3=0 then (60+(key*3)%40)/100.0 else (60+key%40)/100.0 end::double,6) as confidence, 'ocr_structured' as method from od""")
def _(spark, d):
    spec = next(f for f in config.INVOICE.fields if f.name == "total_amount")
    return ocr(spark, d, "ocr_fields").select("document_id", X.extract_structured(spec).alias("f")).select(
        "document_id", "f.value", F.round("f.confidence", 6).alias("confidence"), "f.method")


#: Each schema and the SQL for the documents that have it; the generic one is for all other types.
_TYPED = [*((s, f"document_type='{n}'") for n, s in config.SCHEMAS.items()), (config.GENERIC, "document_type not in (" + ",".join(f"'{t}'" for t in config.SCHEMAS) + ")")]


@query("extract_by_label", f"with {Q.TX} " + " union all ".join(
    f"select document_id, '{f.name}' as field_name, {label_name_sql(f)} as matched_label, {label_sql(f, 2)} as value from tx where {where} and {label_name_sql(f)} is not null"
    for s, where in _TYPED for f in s.fields))
def _(spark, d):
    t = X.with_text(ocr(spark, d, "full_text"), "full_text")
    hits = X.by_type(F.col("document_type"), config.SCHEMAS, lambda s: F.array(*[X.extract_by_label(f) for f in s.fields]))
    return X.explode_rows(t, ["document_id"], F.filter(hits, lambda f: f.isNotNull())).select("document_id", "field_name", "matched_label", "value")


@query("extract_max_currency", f"with {Q.TX} select document_id, {_MAXTXT} as value from tx where contains(full_text,'$')")
def _(spark, d):
    spec = config.GENERIC.fields[2]
    t = X.with_text(ocr(spark, d, "full_text"), "full_text")
    return t.select("document_id", X.extract_max_currency(spec).alias("f")).where("f is not null").select("document_id", "f.value")


@query("extract_first_date", f"with {Q.TX} select document_id, {_FIRST_DATE} as value from tx")
def _(spark, d):
    spec = config.GENERIC.fields[1]
    t = X.with_text(ocr(spark, d, "full_text"), "full_text")
    return t.select("document_id", X.extract_first_date(spec).alias("f")).select("document_id", "f.value")


_FIRST_DATE_COMPAT = "case " + " ".join(f"when regexp_matches(lower(full_text),'{p}') then regexp_extract(lower(full_text),'{p}',0)" for p in config.ANY_DATES) + " end"


@query("extract_first_date_compat", f"with {Q.TX} select document_id, {_FIRST_DATE_COMPAT} as value from tx")
def _(spark, d):
    t = X.with_text(ocr(spark, d, "full_text"), "full_text", compat=True)
    return t.select("document_id", X.extract_first_date(config.GENERIC.fields[1])["value"].alias("value"))


@query("extract_default", f"with {Q.TX}, x as (select document_id, {label_sql(config.FieldSpec('reference', 'text'), 2)} as v from tx) select document_id, coalesce(v,'none') as value, case when v is null then 'default' else 'pattern_match' end as method from x")
def _(spark, d):
    spec = config.FieldSpec("reference", "text", default="none")
    index = X.LabelIndex([spec])
    t = X.with_text(ocr(spark, d, "full_text"), "full_text", labels=index)
    return t.select("document_id", X.cascade(spec, index=index).alias("f")).select("document_id", "f.value", "f.method")


def cascade_sql(schema, condition):
    """The cascade without recognised fields, as a union over the fields of a schema."""
    parts = []
    for s in schema.fields:
        label = label_sql(s, 2)
        third = {"currency": f"case when contains(full_text,'$') then {_MAXTXT} end", "date": _FIRST_DATE}.get(s.field_type, "null")
        kind = {"currency": "pattern_currency", "date": "pattern_date"}.get(s.field_type, "")
        parts.append(f"""select document_id, '{s.name}' as field_name, coalesce({label}, {third})::varchar as value,
          case when {label_name_sql(s)} is not null then 'pattern_match' else '{kind}' end as method,
          case when {label_name_sql(s)} is not null then 0.8 else {0.6 if s.field_type == 'currency' else 0.7} end::double as confidence from tx where {condition}""")
    return "select * from (" + " union all ".join(parts) + ") where value is not null"


_NAMED = ",".join(f"'{t}'" for t in config.SCHEMAS)


@query("extract_fields", f"with {Q.TX} " + " union all ".join(
    cascade_sql(s, f"document_type='{n}'") for n, s in config.SCHEMAS.items() if n != "id_document") + " union all " + cascade_sql(config.GENERIC, f"document_type not in ({_NAMED})"))
def _(spark, d):
    out = X.extract_fields(ocr(spark, d, "full_text"), ocr_fields_col=None)
    return X.field_rows(out, ["document_id"]).select("document_id", "field_name", "value", "method", "confidence")


@query("generic_schema", f"with {Q.TX} select document_id, field_name, value from ({cascade_sql(config.GENERIC, 'true')})")
def _(spark, d):
    out = X.extract_fields(ocr(spark, d, "full_text"), schemas={}, ocr_fields_col=None)
    return X.field_rows(out, ["document_id"]).select("document_id", "field_name", "value")


ITEMS = config.INVOICE.tables[0]


@query("match_table", f"with {Q.OD} select document_id, case when key%6=5 then 0 else 3 end::integer as rows from od")
def _(spark, d):
    t = T.match_table(F.col("tables"), ITEMS)
    return ocr(spark, d, "tables").select("document_id", F.coalesce(F.size(t["rows"]), F.lit(0)).alias("rows"))




_CELL = "printf('%.2f', {}::double)"


@query("process_table", f"""with {Q.OD}, x as (select document_id, key, subtotal, ((((subtotal*100)::bigint+1)//2)::decimal(18,2)*0.01)::decimal(18,2) as a from od where key%6<>5),
  c as (select document_id, 1 as row, 'description' as column_name, 'Goods' as value from x union all select document_id, 1, 'quantity', {_CELL.format('(key%4+1)')} from x
   union all select document_id, 1, 'unit_price', {_CELL.format('a')} from x union all select document_id, 1, 'amount', {_CELL.format('a')} from x
   union all select document_id, 2, 'description', 'Freight' from x union all select document_id, 2, 'quantity', null from x
   union all select document_id, 2, 'unit_price', 'n/a' from x union all select document_id, 2, 'amount', {_CELL.format('(subtotal-a)')} from x)
  select document_id, row, column_name, coalesce(value,'-') as shown from c""")
def _(spark, d):
    """Every cell; numbers are shown with two places."""
    out = T.process_table(ocr(spark, d, "tables"), ITEMS, ["document_id"])
    number = F.format_string("%.2f", F.col("value").try_cast("double"))
    shown = F.when(F.col("value").try_cast("double").isNotNull(), number).otherwise(F.coalesce("value", F.lit("-")))
    return out.select("document_id", "row", "column_name", shown.alias("shown"))


@query("process_table_sums", f"with {Q.OD} select document_id, round(sum(subtotal)::double,2) as amount from od where key%6<>5 group by 1")
def _(spark, d):
    cells = T.process_table(ocr(spark, d, "tables"), ITEMS, ["document_id"]).where(F.col("column_name") == "amount")
    return cells.groupBy("document_id").agg(F.round(F.sum(F.col("value").cast("double")), 2).alias("amount"))


_KINDS = {f.name: f.field_type for f in config.INVOICE.fields if f.field_type in ("currency", "date")}


def _of_kind(kind):
    return [n for n, k in _KINDS.items() if k == kind]


@query("normalize_cell", f"""with {Q.FD} select document_id, field_name,
  case when trim(value)='' then null when field_name in ({Q.names(_of_kind('currency'))}) then coalesce(format('{{:.2f}}', try_cast(regexp_replace(value,'[^0-9.-]','','g') as double)), value)
   when field_name in ({Q.names(_of_kind('date'))}) then coalesce({Q.to_date('value')}::varchar, value) else value end as cell from fv""")
def _(spark, d):
    """All fields; amounts are shown with two places."""
    v, name = F.col("value"), F.col("field_name")
    money = parse.cell_value(v, "currency")
    shown = F.when(name.isin(_of_kind("currency")), F.coalesce(F.format_string("%.2f", money.try_cast("double")), money)).when(
        name.isin(_of_kind("date")), parse.cell_value(v, "date")).otherwise(parse.cell_value(v, "text"))
    return A.field_values(spark, d).select("document_id", "field_name", F.when(money.isNotNull(), shown).alias("cell"))


@query("grid_from_cells", f"""with {Q.OD}, x as (select document_id, key, (key%3+1) as h, (key%4+1) as w from od)
  select document_id, h::integer as rows, w::integer as columns, case when h=1 or w=1 then 'last' else 'r0c0' end as first_cell,
   case when h=1 and w=1 then 'last' when h>1 and w>1 then 'last' else 'last' end as last_cell, (h*w - case when h=1 and w=1 then 1 when h=1 or w=1 then 2 else 2 end)::integer as blanks from x""".replace(
    "case when h=1 or w=1 then 'last' else 'r0c0' end", "case when h=1 and w=1 then 'last' else 'r0c0' end").replace(
    "case when h=1 and w=1 then 'last' when h>1 and w>1 then 'last' else 'last' end", "'last'"))
def _(spark, d):
    k = F.col("key")
    cell = lambda r, c, t: F.struct(r.cast("int").alias("row_index"), c.cast("int").alias("column_index"), F.lit(t).alias("content"))
    cells = F.array(cell(F.lit(0), F.lit(0), "r0c0"), cell(k % 3, k % 4, "first"), cell(k % 3, k % 4, "last"))
    g = T.grid_from_cells(A.order_docs(spark, d).select("document_id", cells.alias("cells")), "cells", "g")
    flat = F.flatten("g")
    return g.select("document_id", F.size("g").alias("rows"), F.size(F.col("g")[0]).alias("columns"), F.col("g")[0][0].alias("first_cell"),
                    F.element_at(flat, -1).alias("last_cell"), F.size(F.filter(flat, lambda c: c == "")).alias("blanks"))


@query("polygon_to_bbox", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber=7 then 0.0 else least(l_quantity,l_discount*100)::double end as x,
  case when l_linenumber=7 then 0.0 else greatest(l_quantity,l_discount*100)-least(l_quantity,l_discount*100) end::double as width,
  case when l_linenumber=7 then 0.0 else 3.0 end::double as height from (select *, round(l_discount,2) as dd from lineitem)""".replace("l_discount*100", "round(l_discount*100,0)"))
def _(spark, d):
    a, b = F.col("l_quantity"), F.round(F.col("l_discount") * 100, 0)
    p = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    pts = F.array(p(a, 1.0), p(b, 1.0), p(b, 4.0), p(a, 4.0))
    pts = F.when(F.col("l_linenumber") == 7, F.slice(pts, 1, 3)).otherwise(pts)
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.polygon_to_bbox(pts).alias("b")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.x", "b.width", "b.height")


@query("high_confidence_fields", f"""with {Q.OD}, f as (select document_id, case when key%3=0 then 'Total_Amount' else 'other' end as field_name, (60+(key*3)%40)/100.0::double as c from od
   union all select document_id, case when key%5=0 then 'VENDOR_NAME' else 'note' end, (60+(key*7)%40)/100.0::double from od
   union all select document_id, 'total_amount', (60+key%40)/100.0::double from od) select document_id, field_name, round(c,6) as confidence from f where c>=0.8""")
def _(spark, d):
    return ocr(spark, d, "ocr_fields").select("document_id", F.explode_outer(X.high_confidence_fields(F.col("ocr_fields"))).alias("f")).where("f is not null").select(
        "document_id", "f.field_name", F.round("f.confidence", 6).alias("confidence"))


@query("table_summaries", f"with {Q.OD} select document_id, 0::integer as table_index, 3::integer as rows, 4::integer as columns, true as has_headers from od where key%6<>5")
def _(spark, d):
    return ocr(spark, d, "tables").select("document_id", F.explode(T.table_summaries(F.col("tables"))).alias("t")).select(
        "document_id", "t.table_index", "t.rows", "t.columns", "t.has_headers")


BLOCKS = Q.TX + """, ln as (select document_id, key, unnest(string_split(rtrim(full_text, chr(10)), chr(10))) as content,
   generate_subscripts(string_split(rtrim(full_text, chr(10)), chr(10)),1) - 1 as i from tx),
 bl as (select *, (70+(key+i*7)%30)/100.0::double as confidence, (key+i)%5=0 as is_handwritten, 50.0+(key%3)*i as x, i*20.0 as y, length(content)*6.0 as w, 10.0+(key+i)%3 as h from ln)"""


@query("handwritten_summary", f"""with {BLOCKS} select document_id, count(*)::integer as blocks_detected, round(avg(confidence),6) as average_confidence,
  left(arg_min(content, i),100) as sample_text from bl where is_handwritten group by 1""")
def _(spark, d):
    h = ocr(spark, d, "text_blocks").select("document_id", T.handwritten_summary(F.col("text_blocks")).alias("h")).where("h is not null")
    return h.select("document_id", "h.blocks_detected", F.round("h.average_confidence", 6).alias("average_confidence"), "h.sample_text")


@query("ocr_confidence_scores", f"""with {BLOCKS} select document_id, round(avg(confidence),6) as text, case when any_value(key)%6=5 then null else 1.0 end::double as tables,
  round(any_value(((60+(key*3)%40)+(60+(key*7)%40)+(60+key%40))/300.0::double),6) as fields from bl group by 1""")
def _(spark, d):
    s = ocr(spark, d, "text_blocks", "tables", "ocr_fields").select(
        "document_id", T.ocr_confidence_scores(F.col("text_blocks"), F.col("tables"), F.col("ocr_fields")).alias("s"))
    return s.select("document_id", F.round(F.col("s")["text"], 6).alias("text"), F.col("s")["tables"].alias("tables"), F.round(F.col("s")["fields"], 6).alias("fields"))


def words(spark, d):
    conf = (F.col("l_quantity") * 2 - 10).cast("int")
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"),
                                                F.when(F.col("l_partkey") % 10 == 0, " ").otherwise("word").alias("text"), conf.alias("conf"))


@query("page_text_stats", """with w as (select l_orderkey as doc, l_linenumber as page, l_partkey%10<>0 as word, (l_quantity*2-10)::integer as conf from lineitem)
  select doc, page, count(*) filter (word) as word_count, round(coalesce(avg(conf) filter (conf>0),0.0),6)::double as confidence, count(*) filter (conf>30) as kept_words from w group by 1,2""")
def _(spark, d):
    return T.page_text_stats(words(spark, d), ["doc", "page"]).withColumn("confidence", F.round("confidence", 6))


@query("kept_words", "select l_orderkey as doc, l_linenumber as page, (l_quantity*2-10)::integer as conf from lineitem where l_quantity*2-10 > 30")
def _(spark, d):
    return T.kept_words(words(spark, d)).select("doc", "page", "conf")


@query("detected_field_map", f"""with {Q.OD} select document_id, case when key%3=0 then 3 else 3 end::integer as names, '$1.00' as total_content, round((60+key%40)/100.0::double,6) as total_confidence from od""")
def _(spark, d):
    m = X.detected_field_map(ocr(spark, d, "ocr_fields"), "ocr_fields", "m")
    return m.select("document_id", F.size("m").alias("names"), F.col("m")["total_amount"]["content"].alias("total_content"),
                    F.round(F.col("m")["total_amount"]["confidence"], 6).alias("total_confidence"))


_ALL_FIELDS = " union all ".join(cascade_sql(s, where) for s, where in _TYPED)
#: A normalised value as text, from the raw one and the field's name.
_VALUE_SQL = f"""case when field_name in ({Q.names(config.NORMALIZED_DATES)}) then coalesce({Q.to_date('value')}::varchar, value)
  when field_name in ({Q.names(config.NORMALIZED_AMOUNTS)}) and coalesce(try_cast(regexp_replace(value,'[^0-9.-]','','g') as decimal(28,6)),0)<>0 then regexp_replace(value,'[^0-9.-]','','g') else value end"""


def every_field(build):
    """One struct (field_name, value) per field of the document's schema, from a column builder by name."""
    return X.by_type(F.col("document_type"), config.SCHEMAS, lambda s: F.array(*[F.struct(F.lit(f.name).alias("field_name"), build(f.name).alias("v")) for f in s.fields]))


@query("field_value", f"with {Q.TX}, f as ({_ALL_FIELDS}) select document_id, field_name, {_VALUE_SQL} as value from f")
def _(spark, d):
    e = X.extract_fields(ocr(spark, d, "full_text"), ocr_fields_col=None)
    rows = X.explode_rows(e, ["document_id"], every_field(lambda n: X.field_value(F.col("fields"), n)))
    return rows.where("v is not null").select("document_id", "field_name", F.col("v").alias("value"))


_NO_FIELD = " union all ".join(f"select document_id, '{f.name}' as field_name from tx where {where}" for s, where in _TYPED for f in s.fields)


@query("field_confidence", f"with {Q.TX}, f as ({_ALL_FIELDS}), e as ({_NO_FIELD}) select document_id, field_name, coalesce(confidence,0.0)::double as confidence from e left join f using (document_id, field_name)")
def _(spark, d):
    e = X.extract_fields(ocr(spark, d, "full_text"), ocr_fields_col=None)
    rows = X.explode_rows(e, ["document_id"], every_field(lambda n: X.field_confidence(F.col("fields"), n)))
    return rows.select("document_id", "field_name", F.col("v").alias("confidence"))


@query("layout_from_blocks", f"""with {BLOCKS}, a as (select document_id, count(*) n, sum(w*h) area, var_pop(x) vl, var_pop(x+w) vr, var_pop(x+w/2) vc, min(x) ml, max(x+w) mr, min(y) mt, max(y+h) mb,
   quantile_cont(h,0.33) p33, quantile_cont(h,0.67) p67 from bl group by 1),
  s as (select document_id, count(*) filter (h<=p33) sm, count(*) filter (h>p67) lg from bl join a using (document_id) group by 1)
  select document_id, n::integer as text_block_count, round(area/(612.0*792.0),6) as text_density, round(area/n,6) as average_text_block_size,
   case when vl<6.12 and vr<6.12 then 'justified' when vl<6.12 then 'left' when vr<6.12 then 'right' when vc<6.12 then 'center' else 'mixed' end as text_alignment,
   round(sm/n,6) as font_small, round(lg/n,6) as font_large, round(ml/612.0,6) as margin_left, round((612.0-mr)/612.0,6) as margin_right, round((792.0-mb)/792.0,6) as margin_bottom
  from a join s using (document_id)""")
def _(spark, d):
    out = T.layout_from_blocks(ocr(spark, d, "text_blocks"))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("document_id", "text_block_count", r("text_density"), r("average_text_block_size"), "text_alignment", r("font_small"),
                      r("font_large"), r("margin_left"), r("margin_right"), r("margin_bottom"))


# Every value of the result document, read back from the JSON text; lists become text, a line for each member.
_MONEY = "format('{{:,.2f}}', ({})::double)"
_HUNDREDTHS = "round(({})*100)::bigint"


@query("analysis_json", f"""with {BLOCKS}, b as (select document_id, string_agg(concat_ws('|', content, x::bigint, y::bigint, w::bigint, h::bigint, {_HUNDREDTHS.format('confidence')}, is_handwritten), chr(10) order by i) as text_blocks,
    count(*) filter (is_handwritten) as hand, {_HUNDREDTHS.format("sum(confidence) filter (is_handwritten)")} as hand_confidence, left(arg_min(content, i) filter (is_handwritten), 100) as hand_sample from bl group by 1),
  fl as (select document_id, 0 as i, case when key%3=0 then 'Total_Amount' else 'other' end as field_name, '$'||total as value, 60+(key*3)%40 as c from tx
    union all select document_id, 1, case when key%5=0 then 'VENDOR_NAME' else 'note' end, 'Vendor '||key, 60+(key*7)%40 from tx union all select document_id, 2, 'total_amount', '$1.00', 60+key%40 from tx),
  fs as (select document_id, string_agg(concat_ws('|', field_name, value, 'string', c), chr(10) order by i) as structured_fields,
    coalesce(string_agg(concat_ws('|', field_name, value, 'string', c), chr(10) order by i) filter (c>=80), '') as high_confidence_fields from fl group by 1),
  x as (select *, ((((subtotal*100)::bigint+1)//2)::decimal(18,2)*0.01)::decimal(18,2) as a from tx)
  select document_id, document_id as name, document_type as class, 90::bigint as classification_confidence, (key%4+1)::bigint as pages, 'en' as language, full_text, text_blocks,
    case when key%6=5 then '' else 'Description|Quantity|Unit Price|Amount'||chr(10)||'Goods|'||(key%4+1)||'|'||{_MONEY.format('a')}||'|$'||{_MONEY.format('a')}||chr(10)||'Freight| |n/a|$'||{_MONEY.format('subtotal-a')}||chr(10)||'Description|Quantity|Unit Price|Amount'||chr(10)||'90' end as tables,
    structured_fields, document_type as predicted_class, document_type as result_type, 90::bigint as result_confidence, high_confidence_fields,
    case when key%6=5 then '' else '0|3|4|true|90' end as table_summaries, case when hand>0 then hand end as hand, case when hand>0 then hand_confidence end as hand_confidence, hand_sample,
    'prebuilt-layout' as model_used, (key%90)::bigint as processing_tenths, case when key%10<>0 then 60+key%40 end as text_score, 100::bigint as table_score
  from x join b using (document_id) join fs using (document_id)""")
def _(spark, d):
    src = ocr(spark, d, "full_text", "text_blocks", "tables", "ocr_fields", "pages", "language", "model_used", "processing_time", "confidence_scores")
    j = T.analysis_json(src.withColumn("classification_confidence", F.lit(0.9))).select("document_id", F.from_json("analysis", _ANALYSIS).alias("j"))
    j = j.select("document_id", "j.document_info", "j.ocr_results", "j.classification_results", "j.custom_analysis", "j.processing_metadata")
    info, ocr_part, result, custom, run = (F.col(c) for c in ("document_info", "ocr_results", "classification_results", "custom_analysis", "processing_metadata"))
    whole = lambda c, by=100: F.round(c * by).cast("long")
    lines = lambda items, f: F.array_join(F.transform(items, f), "\n")
    field = lambda f: F.concat_ws("|", f["field_name"], f["value"], f["field_type"], whole(f["confidence"]))
    box = lambda b: [b["bbox"][n].cast("long") for n in ("x", "y", "width", "height")]
    hand = custom["handwritten_content"]
    return j.select(
        "document_id", info["name"].alias("name"), info["class"].alias("class"), whole(info["classification_confidence"]).alias("classification_confidence"),
        info["pages"].alias("pages"), info["language"].alias("language"), ocr_part["full_text"].alias("full_text"),
        lines(ocr_part["text_blocks"], lambda b: F.concat_ws("|", b["content"], *box(b), whole(b["confidence"]), b["is_handwritten"])).alias("text_blocks"),
        lines(ocr_part["tables"], lambda t: F.concat_ws("\n", lines(t["rows"], lambda r: F.array_join(r, "|")), F.array_join(t["headers"], "|"), whole(t["confidence"]))).alias("tables"),
        lines(ocr_part["structured_fields"], field).alias("structured_fields"),
        result["predicted_class"].alias("predicted_class"), result["document_type"].alias("result_type"), whole(result["confidence"]).alias("result_confidence"),
        lines(custom["high_confidence_fields"], field).alias("high_confidence_fields"),
        lines(custom["table_summaries"], lambda t: F.concat_ws("|", t["table_index"], t["rows"], t["columns"], t["has_headers"], whole(t["confidence"]))).alias("table_summaries"),
        hand["blocks_detected"].alias("hand"), whole(hand["average_confidence"] * hand["blocks_detected"]).alias("hand_confidence"), hand["sample_text"].alias("hand_sample"),
        run["model_used"].alias("model_used"), whole(run["processing_time"], 10).alias("processing_tenths"),
        whole(run["confidence_scores"]["text"]).alias("text_score"), whole(run["confidence_scores"]["tables"]).alias("table_score"))


_FIELD = "array<struct<field_name:string,value:string,field_type:string,confidence:double>>"
_ANALYSIS = f"""document_info struct<name:string,class:string,classification_confidence:double,pages:bigint,language:string>,
  ocr_results struct<full_text:string,text_blocks:array<struct<content:string,bbox:struct<x:double,y:double,width:double,height:double>,confidence:double,is_handwritten:boolean>>,
    tables:array<struct<rows:array<array<string>>,headers:array<string>,confidence:double>>,structured_fields:{_FIELD}>,
  classification_results struct<predicted_class:string,document_type:string,confidence:double>,
  custom_analysis struct<high_confidence_fields:{_FIELD},table_summaries:array<struct<table_index:int,rows:int,columns:int,has_headers:boolean,confidence:double>>,
    handwritten_content:struct<blocks_detected:bigint,average_confidence:double,sample_text:string>>,
  processing_metadata struct<model_used:string,processing_time:double,confidence_scores:map<string,double>>"""
