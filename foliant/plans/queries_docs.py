"""Queries of sources, sinks, joins, cross-field rules and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.functions import mask
from foliant.operators import crossfield as C
from foliant.operators import joins as J
from foliant.operators import extract as X
from foliant.operators import routing as R
from foliant.operators import stats, validate
from foliant.plans import documents as P
from foliant.plans import sql as Q
from foliant.plans.registry import query
from foliant.plans.sql_plan import plan_sql
from foliant.session import work_path
from foliant.sinks import writers as W
from foliant.sinks.versioned import VersionedTable
from foliant.sources import adapters as A
from foliant.sources import documents as D
from foliant.sources import metrics as M
from foliant.sources import schemas as SC

TODAY = "1999-06-01"
_PATH = f"url||'/p'||page_id||{Q.pick(['.pdf', '.PDF', '.docx', ''], 'page_id')}"


@query("scan_documents", f"select {_PATH} as path, length(html) as length from pages where page_id%4<2")
def _(spark, d):
    return D.keep_pdfs(A.blobs(spark, d)).select("path", "length")


@query("scan_new_documents", f"select {_PATH} as path from pages where page_id%4<2 and page_id%3<>0")
def _(spark, d):
    b = A.blobs(spark, d)
    return D.scan_new_documents(b, b.where(F.col("page_id") % 3 == 0)).select("path")


@query("anti_processed", f"select event_id from events where user_id not in (select c_custkey from customer where c_nationkey%2=0)")
def _(spark, d):
    done = A.table(spark, d, "customer").where(F.col("c_nationkey") % 2 == 0).select(F.col("c_custkey").alias("user_id"))
    return J.anti_processed(A.table(spark, d, "events").select("event_id", "user_id"), done, "user_id").select("event_id")


@query("scan_events", "select page_id, 'p'||page_id||(['.pdf','.PDF','.docx',''])[cast(page_id%4+1 as integer)] as name from pages where page_id%4<2 and page_id%5<>0")
def _(spark, d):
    kind = F.when(F.col("page_id") % 5 == 0, "Microsoft.Storage.BlobDeleted").otherwise(D.CREATED)
    body = F.to_json(F.struct(kind.alias("eventType"), F.struct(F.col("path").alias("url")).alias("data")))
    return D.scan_events(A.blobs(spark, d).select("page_id", body.alias("body"))).select("page_id", "name")


def schema_texts(spark, d):
    """A schema document per part, with keys left out here and there and some broken texts."""
    p = F.col("p_partkey")
    opt = lambda cond, text: F.when(cond, text).otherwise("")
    text = F.concat(
        F.lit('{"template_type":"'), F.col("p_brand"), F.lit('"'), opt(p % 3 == 0, ',"required_confidence":0.6'),
        F.lit(',"fields":[{"name":"f_a","field_type":"text"'), opt(p % 2 == 0, ',"required":true'), F.lit('},{"name":"f_b","field_type":"date"'),
        opt(p % 5 == 0, ',"confidence_threshold":0.9'), F.lit(',"synonyms":["x","y"]}]}'))
    return A.table(spark, d, "part").select("p_partkey", F.when(p % 11 == 0, "not json").otherwise(text).alias("value"))


@query("scan_schemas", """select p_partkey, p_brand as document_type, case when p_partkey%3=0 then 0.6 else 0.8 end::double as required_confidence, f as field_name,
  f='f_a' and p_partkey%2=0 as required, case when f='f_b' and p_partkey%5=0 then 0.9 else 0.7 end::double as confidence_threshold, case when f='f_b' then 2 else 0 end::integer as synonyms
  from part, (values ('f_a'),('f_b')) v(f) where p_partkey%11<>0""")
def _(spark, d):
    rows = SC.schema_field_rows(SC.parse_schemas(schema_texts(spark, d)), ("p_partkey",))
    return rows.select("p_partkey", "document_type", "required_confidence", "field_name", "required", "confidence_threshold", F.size("synonyms").alias("synonyms"))


_NAMES = " ".join(f"when '{t}' then '{','.join(f.name for f in s.fields)}'" for t, s in config.SCHEMAS.items())


@query("schema_lookup", f"with {Q.OD} select document_id, case document_type {_NAMES} else 'content' end as field_names from od")
def _(spark, d):
    return SC.schema_lookup(A.order_docs(spark, d).select("document_id", "document_type"), J.schema_fields(spark)).select(
        "document_id", F.array_join("field_names", ",").alias("field_names"))


# ---- sinks: written to the shared folder and read back ----

@query("upsert_document_metrics", f"""with {Q.DM}, n as (select 'doc_'||user_id as document_id, ts + interval 40 day as created_at, value from events),
  a as (select document_id, created_at, total_processing_time as t from dm union all select document_id, created_at, value from n)
  select document_id, round(arg_max(t, created_at),6) as total_processing_time from a group by 1""")
def _(spark, d):
    old = A.document_metrics(spark, d)
    # The new batch rewrites the documents named after users, once per event: a few hot ids.
    shift = F.make_dt_interval(days=F.lit(40))
    new = A.events_as_metrics(A.table(spark, d, "events").withColumn("event_id", F.col("user_id")))
    new = new.withColumns({"created_at": F.col("created_at") + shift, "start_time": F.col("start_time") + shift})
    table = VersionedTable(spark, work_path(spark, "document_metrics"), by="dt")
    table.replace(W.with_day(old))
    W.upsert_document_metrics(new, table)
    return table.read().select("document_id", F.round("total_processing_time", 6).alias("total_processing_time"))


@query("append_field_metrics", f"with {Q.FM} select field_name, count(*)*2 as rows from fm group by 1")
def _(spark, d):
    path = work_path(spark, "field_metrics")
    fm = A.field_metrics(spark, d)
    for batch in ("a", "b", "a"):  # a batch that comes twice counts once
        W.append_field_metrics(fm, path, batch)
    return spark.read.parquet(path).groupBy("field_name").agg(F.count(F.lit(1)).alias("rows"))


@query("sink_json", "select 'inbox/'||event_type||'/doc_'||event_id||'.pdf' as blob_name, round(value,6) as processing_time, 5::integer as stages, false as has_temp from events")
def _(spark, d):
    path = work_path(spark, "json")
    W.sink_json(A.processing_results(spark, d), path)
    kind = "blob_name string, processing_time double, stages array<struct<name:string,status:string,temp_path:string>>"
    return spark.read.schema(kind).json(path).select(
        "blob_name", F.round("processing_time", 6).alias("processing_time"), F.size("stages").alias("stages"),
        F.exists("stages", lambda s: s["temp_path"].isNotNull()).alias("has_temp"))


@query("sink_batch_json", "select '2024-02-01' as timestamp, count(*) as total_documents, count(*) filter (event_id%11<>0 and event_type<>'error') as successful, count(*) filter (event_id%11=0 or event_type='error') as failed from events")
def _(spark, d):
    path = work_path(spark, "batch")
    W.sink_batch_json(A.processing_results(spark, d), path, "2024-02-01")
    return spark.read.schema("timestamp string, total_documents long, successful long, failed long").json(f"{path}/batch_info")


@query("sink_csv_flat", """select 'inbox/'||event_type||'/doc_'||event_id||'.pdf' as blob_name, printf('%.2f', value) as field_total_amount_value,
  round((50+event_id%50)/100.0::double,6) as field_total_amount_confidence, 'INV-'||event_id as field_invoice_number_value, strftime(ts,'%Y-%m-%d') as field_date_value from events""")
def _(spark, d):
    path = work_path(spark, "csv")
    W.sink_csv_flat(A.processing_results(spark, d), path, ["total_amount", "invoice_number", "date"])
    return spark.read.option("header", True).csv(path).select(
        "blob_name", "field_total_amount_value", F.round(F.col("field_total_amount_confidence").cast("double"), 6).alias("field_total_amount_confidence"),
        "field_invoice_number_value", "field_date_value")


@query("union_columns", "select o_orderkey as k, o_orderstatus as s, null::double as v from orders union all select event_id, null, value from events")
def _(spark, d):
    return W.union_columns(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")),
                           A.table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").alias("v")))


# ---- joins ----

_REQ = ",".join(f"('{t}','{f.name}',{str(f.required).lower()},{f.threshold})" for t, s in config.SCHEMAS.items() for f in s.fields)


@query("join_fields_schema", f"with {Q.FD}, sf(document_type, field_name, required, threshold) as (values {_REQ}) select document_id, field_name, required, threshold::double as confidence_threshold from fv join sf using (document_type, field_name)")
def _(spark, d):
    return J.join_fields_schema(A.field_values(spark, d), J.schema_fields(spark)).select("document_id", "field_name", "required", "confidence_threshold")


@query("join_field_validation", f"""with {Q.EF}, f as (select document_id, field_name, max(confidence) as confidence from ef group by 1,2),
  v as (select document_id, field_name, arg_max(valid, pos) as valid from ef where confidence>0.7 group by 1,2)
  select document_id, field_name, coalesce(valid,true) as valid, round(confidence,6) as confidence from f left join v using (document_id, field_name)""")
def _(spark, d):
    ef = A.extracted_fields(spark, d)
    rows = ef.groupBy("document_id", "field_name").agg(F.max("confidence").alias("confidence"))
    out = J.join_field_validation(rows, ef.where(F.col("confidence") > 0.7), ["document_id", "field_name"])
    return out.withColumn("confidence", F.round("confidence", 6)).select("document_id", "field_name", "valid", "confidence")


@query("missing_required", f"""with {Q.OD}, {Q.EF}, sf(document_type, field_name, required, threshold) as (values {_REQ}), b as (select document_id, field_name, max(confidence) c from ef group by 1,2)
  select od.document_id, sf.field_name from od join sf using (document_type) left join b on b.document_id=od.document_id and b.field_name=sf.field_name where required and coalesce(c,0)<threshold""")
def _(spark, d):
    return J.missing_required_rows(A.order_docs(spark, d), A.extracted_fields(spark, d), J.schema_fields(spark))


@query("semi_expected", f"""with {Q.EF}, sf(document_type, field_name, required, threshold) as (values {_REQ})
  select ef.document_id, ef.field_name, ef.pos from ef semi join (select * from sf where required) s on s.document_type='invoice' and s.field_name=ef.field_name""")
def _(spark, d):
    expected = J.schema_fields(spark).where("required").select("document_type", "field_name")
    return J.semi_expected(A.extracted_fields(spark, d), expected, ["document_type", "field_name"]).select("document_id", "field_name", "pos")


@query("import_reviews", f"""with {Q.RT}, {Q.DM} select document_id, document_type, case when status='completed' then 'success' else 'needs_review' end as processing_status,
  resolution_time as end_time, 5.0::double as total_processing_time, 3::integer as field_count, case when errors>0 then 'total mismatch' else 'Required human review' end as hitl_reason, 2.5::double as cost
  from (select * replace ('doc_'||((key//64)*3*32) as document_id) from tasks) where status in ('completed','approved') and document_id not in (select document_id from dm)
  qualify row_number() over (partition by document_id order by created_at desc, task_id desc)=1""")
def _(spark, d):
    # Several reviews of one document: keys that share all but their last bits.
    tasks = A.review_tasks(spark, d).withColumn("document_id", F.concat(F.lit("doc_"), (F.floor(F.col("key") / 64) * 96).cast("string")))
    out = J.import_reviews(tasks, A.document_metrics(spark, d))
    return out.select("document_id", "document_type", "processing_status", "end_time", "total_processing_time", "field_count", "hitl_reason",
                      M.map_total(F.col("cost_breakdown")).alias("cost"))


@query("match_reviewers", f"""with {Q.RT}, r as (select 'rev_'||s_suppkey as user_id, {Q.pick(A.TYPES[:5], 's_suppkey')} as document_type, s_suppkey%7 as w, s_suppkey from supplier where s_suppkey%9<>0),
  b as (select document_type, count(*) as eligible, arg_min(user_id, w*100000000+s_suppkey) as best_reviewer from r group by 1) select task_id, eligible, best_reviewer from tasks join b using (document_type)""")
def _(spark, d):
    return J.match_reviewers(A.review_tasks(spark, d), A.reviewers(spark, d)).select("task_id", "eligible", "best_reviewer")


# ---- cross-field rules ----

def _map(name):
    return F.col("fields")[name]


@query("rule_date_sequence", f"""with {Q.FD}, x as (select document_id, invoice_date::date as a, {Q.to_date('due_date')} as b from fd)
  select document_id, coalesce(a<=b,false) as is_valid, case when coalesce(a<=b,false) then 'info' else 'error' end as severity,
  case when b is null then 'Date sequence validation error' else 'invoice_date ('||a||') should be before or equal to due_date ('||b||')' end as message from x""")
def _(spark, d):
    r = C.date_sequence(_map("invoice_date"), _map("due_date"), "invoice_date", "due_date")
    return A.field_docs(spark, d).select("document_id", r.alias("r")).select("document_id", "r.is_valid", "r.severity", "r.message")


@query("rule_amount_consistency", f"""with {Q.OD} select document_id, key%7<>0 as is_valid,
  'Total validation: '||total||(case when key%7<>0 then ' == ' else ' != ' end)||(subtotal+tax)::decimal(28,2)||' (subtotal + tax)' as message from od""")
def _(spark, d):
    r = C.amount_consistency({"total": _map("total_amount"), "subtotal": _map("subtotal"), "tax": _map("tax_amount")}, "total = subtotal + tax")
    return A.field_docs(spark, d).select("document_id", r.alias("r")).select("document_id", "r.is_valid", "r.message")


@query("rule_total_calc", f"with {Q.OD} select document_id, 'Total amount ('||total||') does not equal subtotal + tax ('||(subtotal+tax)::decimal(28,2)||')' as message, (subtotal+tax)::decimal(28,2)::varchar as suggested_value from od where key%7=0")
def _(spark, d):
    r = C.total_calc(*[F.col(c).cast("decimal(28,6)") for c in ("total", "subtotal", "tax")])
    return A.order_docs(spark, d).select("document_id", r.alias("r")).where("r is not null").select("document_id", "r.message", "r.suggested_value")


@query("rule_due_date", f"with {Q.OD} select document_id, 'warning' as severity, 'Due date ('||due_date||') should be after invoice date ('||doc_date||')' as message from od where due_date<=doc_date")
def _(spark, d):
    r = C.due_date(F.col("doc_date"), F.col("due_date"))
    return A.order_docs(spark, d).select("document_id", r.alias("r")).where("r is not null").select("document_id", "r.severity", "r.message")


_SUMS = "with {od}, s as (select l_orderkey as key, sum(case when l_partkey%11=0 then 0 else cast(l_extendedprice as decimal(18,2)) end) as items_total from lineitem group by 1) "


@query("line_items_sum", _SUMS.format(od=Q.OD) + "select document_id, items_total::double as items_total, not (abs(items_total-subtotal)>0.01) as is_valid from od join s using (key)")
def _(spark, d):
    docs = A.order_docs(spark, d).select("document_id", "key", F.col("subtotal").cast("decimal(28,6)").alias("subtotal"))
    return C.line_items_sum(A.line_items(spark, d), docs, "key", "subtotal").select("document_id", F.col("items_total").cast("double").alias("items_total"), "is_valid")


@query("items_sum", _SUMS.format(od=Q.OD) + "select document_id, not (abs(items_total-total)>0.01) as is_valid from od join s using (key)")
def _(spark, d):
    docs = A.order_docs(spark, d).select("document_id", "key", F.col("total").cast("decimal(28,6)").alias("total"))
    return C.line_items_sum(A.line_items(spark, d), docs, "key", "total").select("document_id", "is_valid")


@query("business_rules", f"""with {Q.OD} select document_id, 'total_equals_subtotal_plus_tax' as rule_name, 'error' as severity from od where document_type='invoice' and key%7=0
  union all select document_id, 'due_date_after_invoice_date', 'warning' from od where document_type='invoice' and due_date<=doc_date
  union all select document_id, 'line_items_sum_to_subtotal', 'error' from od where document_type='invoice' and key%6<>5 and key%4=0""")
def _(spark, d):
    none = F.lit(None)
    f = lambda n, dt=none, am=none: F.struct(F.lit(n).alias("field_name"), dt.cast("date").alias("norm_date"), am.cast("decimal(28,6)").alias("norm_amount"))
    # Every fourth document states a subtotal and tax moved by five dollars, so only its table disagrees.
    off = F.when(F.col("key") % 4 == 0, 5).otherwise(0)
    fields = F.array(f("invoice_date", F.col("doc_date")), f("due_date", F.col("due_date")), f("total_amount", am=F.col("total")),
                     f("subtotal", am=F.col("subtotal") + off), f("tax_amount", am=F.col("tax") - off))
    docs = A.ocr_docs(spark, d).where(F.col("document_type") == "invoice").select("document_id", "tables", fields.alias("fields"))
    r = validate.business_rules(F.col("fields"), F.col("tables"), config.INVOICE)
    return docs.select("document_id", F.explode_outer(r).alias("r")).where("r is not null").select("document_id", "r.rule_name", "r.severity")


@query("default_cross_rules", f"""with {Q.FD}, o as (select document_id, key from od)
  select document_id, 'invoice_date_before_due_date' as rule_name, coalesce(invoice_date::date<={Q.to_date('due_date')},false) as is_valid from fd
  union all select document_id, 'invoice_total_consistency', key%7<>0 from o""")
def _(spark, d):
    rules = F.array(*[C.cross_rule(r, F.col("fields")) for r in config.DEFAULT_CROSS_RULES])
    out = A.field_docs(spark, d).select("document_id", F.explode_outer(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return out.select("document_id", "r.rule_name", "r.is_valid")


@query("union_rules", f"with {Q.FD} select document_id, 'phone_before' as rule_name, false as is_valid, 'error' as severity from fd")
def _(spark, d):
    extra = [{"name": "phone_before", "type": "date_sequence", "field1": "phone", "field2": "invoice_date"}]
    out = validate.validate_document(A.field_docs(spark, d), extra)
    return out.select("document_id", F.explode_outer("validation_results").alias("r")).where("r.rule_name = 'phone_before'").select(
        "document_id", "r.rule_name", "r.is_valid", "r.severity")


_VF = {
    "not_empty_number": ("invoice", "invoice_number", "not_empty", "error", "trim(value)=''"),
    "alnum": ("invoice", "invoice_number", "alphanumeric", "error", "not regexp_matches(value,'^[a-zA-Z0-9\\s\\-_]+$')"),
    "date": ("invoice", "invoice_date", "past_date", "error", f"value::date > date '{TODAY}'"),
    "due": ("invoice", "due_date", "valid_date", "warning", f"{Q.to_date('value')} is null"),
    "pay": ("receipt", "payment_method", "valid_payment_method", "warning", "value='barter'"),
}


@query("validate_fields", f"with {Q.FD} " + " union all ".join(
    f"select document_id, field_name, '{rule}' as rule_name, '{sev}' as severity, 'Field '''||field_name||''' failed validation rule ''{rule}''' as message from fv where document_type='{t}' and field_name='{f}' and {cond}"
    for t, f, rule, sev, cond in _VF.values()))
def _(spark, d):
    return validate.validate_field_rows(A.field_values(spark, d), TODAY).select("document_id", "field_name", "rule_name", "severity", "message")


_CUR = "regexp_matches(value,'^\\$?[\\d,]+\\.?\\d{0,2}$')"


def _verdicts(parts):
    """Rows (document, field, rule, verdict, severity) of rules given as (fields' SQL, rule, verdict, source)."""
    return " union all ".join(f"""select document_id, {field} as field_name, '{rule}' as rule_name, {ok} as is_valid, case when {ok} then 'info' else 'error' end as severity from {source}"""
                              for field, rule, ok, source in parts)


_MONEY = "field_name in ('total_amount','subtotal','tax_amount')"


@query("validate_document", f"with {Q.FD}, x as (select *, lower(field_name) as n from fv) " + _verdicts([
    ("field_name", "required", "false", "x where field_name='invoice_number' and document_type='invoice' and value=''"),
    ("field_name", "regex", "regexp_matches(value,'^[A-Za-z0-9-]+$')", "x where field_name='invoice_number' and value<>''"),
    ("field_name", "regex", _CUR, f"x where {_MONEY}"), ("field_name", "numeric_range", "true", f"x where {_MONEY}"),
    ("field_name", "regex", "key%9<>0", "x where field_name='email'"), ("field_name", "regex", "key%8<>0", "x where field_name='phone'"),
    ("field_name", "date_format", f"{Q.to_date('value')} is not null", "x where n like '%date%'"),
    ("'invoice_date+due_date'", "invoice_date_before_due_date", f"coalesce(invoice_date::date<={Q.to_date('due_date')},false)", "fd"),
    ("'amount_consistency'", "invoice_total_consistency", "key%7<>0", "od")]))
def _(spark, d):
    out = validate.validate_document(A.field_docs(spark, d))
    return X.explode_rows(out, ["document_id"], F.col("validation_results")).select("document_id", "field_name", "rule_name", "is_valid", "severity")


# ---- confidence and routing ----

_CONF = "least(1.0, greatest(0.0, avg(confidence) - 0.1*count(*) filter (not valid and severity='error') - 0.05*count(*) filter (not valid and severity='warning')))"


@query("overall_confidence", f"with {Q.EF} select document_id, round({_CONF},6) as overall_confidence from ef group by 1")
def _(spark, d):
    return R.overall_confidence_rows(A.extracted_fields(spark, d)).withColumn("overall_confidence", F.round("overall_confidence", 6))


def routed_fields(spark, d):
    """Documents with three fields and one validation result each, ready for routing."""
    k = F.col("key")
    field = lambda n, m: F.struct(F.lit(n).alias("field_name"), ((F.lit(50) + (k * m) % 50) / 100.0).alias("confidence"))
    fields = F.array(field("invoice_number", 3), field("total_amount", 7), field("vendor_name", 9), field("invoice_date", 11))
    fields = F.when(k % 10 == 0, F.transform(fields, lambda f: F.struct(f["field_name"].alias("field_name"), F.lit(0.97).alias("confidence")))).otherwise(fields)
    result = F.struct((k % 6 != 1).alias("is_valid"), F.when(k % 4 == 1, "error").otherwise("warning").alias("severity"), F.lit("m").alias("message"))
    return A.order_docs(spark, d).select("document_id", "key", F.lit("invoice").alias("document_type"), fields.alias("fields"), F.array(result).alias("validation_results"))


_RF = Q.OD + """, rf as (select document_id, key, case when key%10=0 then 0.97 else (50+(key*3)%50)/100.0 end::double as a, case when key%10=0 then 0.97 else (50+(key*7)%50)/100.0 end::double as b,
   case when key%10=0 then 0.97 else (50+(key*9)%50)/100.0 end::double as c, case when key%10=0 then 0.97 else (50+(key*11)%50)/100.0 end::double as d,
   case when key%6=1 and key%4=1 then 1 else 0 end as err, case when key%6=1 and key%4<>1 then 1 else 0 end as warn from od),
 rc as (select *, least(1.0,greatest(0.0,(a+b+c+d)/4 - 0.1*err - 0.05*warn)) as conf, (a<0.9)::int+(b<0.9)::int+(c<0.8)::int+(d<0.8)::int as missing from rf),
 rr as (select *, conf<0.6 or missing>0 or err>0 or conf<0.8 as review, (a<0.8 or b<0.8 or c<0.8) or (a<0.9 or b<0.9) as weak from rc)"""


@query("requires_review", f"with {_RF} select document_id, review as requires_hitl, missing::integer as missing from rr")
def _(spark, d):
    return R.route(routed_fields(spark, d)).select("document_id", "requires_hitl", F.size("missing_required").alias("missing"))


@query("route_reason_priority", f"""with {_RF} select document_id, case when review then case when weak then 'missing_required_field' when err>0 then 'validation_error' when conf<0.6 then 'low_confidence' end end as routing_reason,
  case when review and weak then 'urgent' when review and (err>0 or conf<0.6) then 'high' else 'normal' end as priority from rr""")
def _(spark, d):
    return R.route(routed_fields(spark, d)).select("document_id", "routing_reason", "priority")


@query("auto_approve", f"with {_RF} select document_id, round(conf,6) as overall_confidence, not review and conf>=0.95 as auto_approve from rr")
def _(spark, d):
    return R.route(routed_fields(spark, d)).select("document_id", F.round("overall_confidence", 6).alias("overall_confidence"), "auto_approve")


@query("route_simple", f"""with {Q.FD}, x as (select document_id, key, concat_ws(', ', case when c_date<0.7 then 'invoice_date' end, case when c_number<0.7 then 'invoice_number' end,
   case when c_total<0.7 then 'total_amount' end, case when c_vendor<0.7 then 'vendor_name' end) as low from fd)
  select document_id, concat_ws('; ', case when key%3=0 then 'Validation failed: bad' end, case when low<>'' then 'Low confidence fields: '||low end) as reasons, key%3=0 or low<>'' as route from x""")
def _(spark, d):
    bad = F.struct((F.col("key") % 3 != 0).alias("is_valid"), F.lit("error").alias("severity"), F.lit("bad").alias("message"))
    out = R.route_simple(A.field_docs(spark, d).withColumn("validation_results", F.array(bad)))
    return out.select("document_id", F.array_join("reasons", "; ").alias("reasons"), "route")


@query("review_priority", f"""with {Q.FD}, x as (select *, (c_number<0.6)::int+(c_total<0.6)::int+(c_vendor<0.6)::int+(c_date<0.6)::int as low from fd)
  select document_id, case when (key%6=1 and key%4=1) or low>2 then 'high' when key%6=1 or low>0 then 'medium' else 'low' end as priority from x""")
def _(spark, d):
    k = F.col("key")
    r = F.struct((k % 6 != 1).alias("is_valid"), F.when(k % 4 == 1, "error").otherwise("warning").alias("severity"))
    return A.field_docs(spark, d).select("document_id", R.review_priority(F.array(r), F.col("confidence_scores")).alias("priority"))


@query("routing_bands", f"with {Q.EF} select document_id, field_name, pos, case when confidence>=0.85 then 'auto_approve' when confidence>=0.7 then 'manual_review' when confidence>=0.6 then 'high_priority' else 'critical' end as band from ef")
def _(spark, d):
    from foliant.functions.status import routing_band

    return A.extracted_fields(spark, d).select("document_id", "field_name", "pos", routing_band(F.col("confidence")).alias("band"))


_BADS = "((event_id%3=0)::int+(event_id%5=0)::int+(event_id%4=0)::int+(event_id%2<>0)::int)"


@query("run_review_flag", f"select event_id, event_id%11=0 or event_type='error' or {_BADS}>2 as needs_review from events")
def _(spark, d):
    out = A.processing_results(spark, d)
    key = F.regexp_extract("blob_name", r"doc_(\d+)", 1).cast("long")
    return out.select(key.alias("event_id"), R.run_review_flag(F.col("stages"), F.col("validation_results")).alias("needs_review"))


@query("derive_metrics_row", f"""select 'inbox_'||event_type||'_doc_'||event_id as document_id, case when event_id%11=0 or event_type='error' then 'failed' when event_type='signup' then 'needs_review' else 'success' end as processing_status,
  case when event_id%11=0 then 'preprocessing' when event_type='error' then 'ocr' end as exception_type,
  case when event_type='signup' then case when {_BADS}>0 then 'Validation failures: '||{_BADS}||' fields' else 'Low confidence scores' end end as hitl_reason,
  round(greatest(0.001,value*0.0001)+0.0001+case when event_type='signup' then 0.05 else 0 end,6)::double as cost, ts + to_microseconds(cast(round(value*1000000) as bigint)) as end_time from events""")
def _(spark, d):
    out = R.derive_metrics_row(A.processing_results(spark, d))
    return out.select("document_id", "processing_status", "exception_type", "hitl_reason", F.round(M.map_total(F.col("cost_breakdown")), 6).alias("cost"), "end_time")


@query("stage_summary", "select event_id, 5::integer as total_stages, (5-(event_id%11=0)::int-(event_type='error')::int)::integer as completed_stages, round((5-(event_id%11=0)::int-(event_type='error')::int)/5.0::double,6) as success_rate from events")
def _(spark, d):
    key = F.regexp_extract("blob_name", r"doc_(\d+)", 1).cast("long")
    return stats.stage_summary(A.processing_results(spark, d)).select(key.alias("event_id"), "total_stages", "completed_stages", F.round("success_rate", 6).alias("success_rate"))


@query("batch_summary", f"select {Q.pick(A.TYPES, 'user_id')} as document_type, count(*) as total_documents, count(*) filter (event_id%11<>0 and event_type<>'error') as successful, count(*) filter (event_id%11=0 or event_type='error') as failed, round(avg((event_id%11<>0 and event_type<>'error')::int),6) as success_rate from events group by 1")
def _(spark, d):
    return stats.batch_summary(A.processing_results(spark, d), ["document_type"]).withColumn("success_rate", F.round("success_rate", 6))


@query("validation_counts", f"select event_id, (4-{_BADS})::integer as passed, {_BADS}::integer as failed from events")
def _(spark, d):
    key = F.regexp_extract("blob_name", r"doc_(\d+)", 1).cast("long")
    return stats.validation_counts(A.processing_results(spark, d)).select(key.alias("event_id"), "passed", "failed")


@query("field_quality_proxy", f"""with {Q.EF}, x as (select document_id, field_name, pos, confidence as c, valid, case when valid then least(0.95,confidence+0.05) else greatest(0.60,confidence-0.20) end as p,
   case when valid then least(0.95,confidence+0.03) else greatest(0.65,confidence-0.15) end as r from ef) select document_id, field_name, pos, round(p,4) as precision, round(r,4) as recall,
   round(2*p*r/(p+r),4) as f1_score, round(case when valid then least(0.98,c+0.08) else greatest(0.70,c-0.10) end,4) as accuracy from x""")
def _(spark, d):
    return stats.field_quality_proxy(A.extracted_fields(spark, d)).select("document_id", "field_name", "pos", "precision", "recall", "f1_score", "accuracy")


@query("field_quality_truth", """with p as (select doc_id, 'quality' as field_name, case when n_chars>3000 then 1 else 0 end as predicted, (n_chars%100)/100.0::double as confidence from documents
   union all select doc_id, 'toxic', case when doc_id%7=0 then 1 else 0 end, (doc_id%100)/100.0::double from documents),
  t as (select doc_id, 'quality' as field_name, quality as actual from labels union all select doc_id, 'toxic', toxic from labels),
  j as (select field_name, predicted, actual, confidence from p full join t using (doc_id, field_name)),
  a as (select field_name, count(*) filter (predicted=actual) as tp, count(*) filter (predicted is not null and (actual is null or actual<>predicted)) as fp,
   count(*) filter (actual is not null and (predicted is null or actual<>predicted)) as fn, count(*) as n, avg(confidence) as ca, stddev_samp(confidence) as cs from j group by 1)
  select field_name, tp as true_positives, fp as false_positives, fn as false_negatives, round(tp/(tp+fp),6) as precision, round(tp/(tp+fn),6) as recall,
   round(ca,6) as confidence_avg, round(cs,6) as confidence_std, round(tp/n,6) as accuracy from a""")
def _(spark, d):
    docs, labels = A.documents(spark, d), A.table(spark, d, "labels")
    pred = lambda name, hit, conf: F.struct(F.lit(name).alias("field_name"), F.when(hit, 1).otherwise(0).alias("predicted"), (conf % 100 / 100.0).alias("confidence"))
    p = docs.select("doc_id", F.explode(F.array(pred("quality", F.col("n_chars") > 3000, F.col("n_chars")), pred("toxic", F.col("doc_id") % 7 == 0, F.col("doc_id")))).alias("x")).select("doc_id", "x.*")
    t = labels.select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("field_name", "actual"))
    out = stats.field_quality_truth(p, t, ["doc_id", "field_name"], ["field_name"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("field_name", "true_positives", "false_positives", "false_negatives", r("precision"), r("recall"), r("confidence_avg"), r("confidence_std"), r("accuracy"))


@query("extraction_stats", f"with {_RF} select count(*) as documents_processed, (count(*)*4)::bigint as fields_extracted, sum(err)::bigint as validation_errors, count(*) filter (review) as hitl_documents, round(avg(review::int),6) as hitl_rate from rr")
def _(spark, d):
    r = R.route(routed_fields(spark, d)).select(F.size("fields").alias("field_count"), "error_count", "requires_hitl", F.lit(1.0).alias("processing_time"))
    return stats.extraction_stats(r).select("documents_processed", "fields_extracted", "validation_errors", "hitl_documents", F.round("hitl_rate", 6).alias("hitl_rate"))


@query("routing_stats", f"with {_RF} select count(*) as documents_processed, count(*) filter (not review and conf>=0.95) as auto_approved, count(*) filter (review) as sent_to_hitl, round(avg(conf),6) as average_confidence from rr")
def _(spark, d):
    r = R.route(routed_fields(spark, d)).withColumn("processing_time", F.lit(1.0))
    return stats.routing_stats(r).select("documents_processed", "auto_approved", "sent_to_hitl", F.round("average_confidence", 6).alias("average_confidence"))


@query("ocr_stats", f"""with {Q.TX}, a as (select document_type, key, len(string_split(rtrim(full_text,chr(10)),chr(10))) as n from tx), b as (select *, len(list_filter(range(n), lambda i: (key+i)%5=0)) as hand from a)
  select document_type, count(*) as documents_processed, round(avg((key%90)/10.0),6) as average_processing_time, round(avg(case when key%10<>0 then (60+key%40)/100.0 end),6) as average_confidence,
   sum(hand)::bigint as handwritten_text_detected, count(*) filter (key%6<>5) as tables_extracted, (count(*)*3)::bigint as custom_fields_extracted from b group by 1""")
def _(spark, d):
    out = stats.ocr_stats(A.ocr_docs(spark, d), ["document_type"])
    return out.select("document_type", "documents_processed", F.round("average_processing_time", 6).alias("average_processing_time"),
                      F.round("average_confidence", 6).alias("average_confidence"), "handwritten_text_detected", "tables_extracted", "custom_fields_extracted")


@query("preprocess_stats", "select l_returnflag, count(*) as total_pages, round(avg((l_partkey%21-10)/4.0),6) as average_skew, 2.5::double as max_skew, round(avg(l_quantity/10.0),6) as average_processing_time from lineitem group by 1")
def _(spark, d):
    pages = A.table(spark, d, "lineitem").select("l_returnflag", ((F.col("l_partkey") % 21 - 10) / 4.0).alias("skew_angle"), (F.col("l_quantity") / 10.0).alias("processing_time"))
    out = stats.preprocess_stats(pages, ["l_returnflag"])
    return out.withColumns({"average_skew": F.round("average_skew", 6), "average_processing_time": F.round("average_processing_time", 6)})


# ---- whole plans and masking ----

@query("process_documents", f"with {plan_sql(TODAY, True)} select * from decided")
def _(spark, d):
    out = P.process_documents(A.ocr_docs(spark, d), TODAY)
    return out.select("document_id", "document_type", F.size("fields").alias("fields"), F.size("validation_results").alias("results"),
                      F.round("overall_confidence", 6).alias("overall_confidence"), "requires_hitl", "routing_reason", "priority", "auto_approve")


@query("custom_steps", f"with {Q.DM} select document_type, count(*) as n from dm where processing_status='success' and total_processing_time>50 group by 1")
def _(spark, d):
    return P.run_steps(A.document_metrics(spark, d), [
        ("only_success", lambda x: x.where(F.col("processing_status") == "success")), lambda x: x.where(F.col("total_processing_time") > 50),
        ("count", lambda x: x.groupBy("document_type").agg(F.count(F.lit(1)).alias("n")))])


_CARD = "\\b(?:[0-9][ -]?){12,15}[0-9]\\b"
_CLEAN = "regexp_replace(m,'[ -]','','g')"


def _mask_sql(internal, tags):
    card, ssn, email, phone = tags
    parts = f"string_split_regex(text, '{_CARD}')"
    found = f"regexp_extract_all(text, '{_CARD}')"
    ok = Q.luhn("replace(replace(m,' ',''),'-','')")
    out = f"""list_aggregate(list_transform(range(1, len({parts})+1), lambda i: ({parts})[i] || coalesce((list_transform({found}, lambda m: case when ({ok})=0 then '{card}' else m end))[i],'')), 'string_agg', '')"""
    out = f"regexp_replace({out}, '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b', '{ssn}', 'g')"
    if not internal:
        out = f"regexp_replace({out}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '{email}', 'g')"
        out = f"regexp_replace({out}, '\\b[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}\\b', '{phone}', 'g')"
    return f"select doc_id, md5({out}) as masked from documents"


def _mask_query(audience, tags):
    @query("mask_pii" if audience == "public" else f"mask_pii_{audience}", _mask_sql(audience == "internal", tags))
    def _(spark, d):
        return A.documents(spark, d).select("doc_id", "text").select("doc_id", F.md5(mask.mask_pii(F.col("text"), audience)).alias("masked"))


_mask_query("public", ("<CREDIT_CARD>", "<SSN>", "<EMAIL_ADDRESS>", "<PHONE_NUMBER>"))
_mask_query("internal", ("<CREDIT_CARD>", "<SSN>", "", ""))
_mask_query("restricted", ("[REDACTED]",) * 4)
