"""Queries over document metrics: sources, KPI aggregations, trends and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import status as S
from foliant.operators import kpi, report, stats
from foliant.operators.quantiles import attach
from foliant.plans import sql as Q
from foliant.plans.registry import query
from foliant.session import work_path
from foliant.sinks.versioned import VersionedTable
from foliant.sources import adapters as A
from foliant.sources import metrics as M

START, END = Q.PERIOD


def period(spark, d):
    return M.in_period(A.document_metrics(spark, d), START, END)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _round_sql(cols):
    return ", ".join(f"round({c},6) as {c}" for c in cols)


@query("scan_metrics_period", f"with {Q.DM} select document_id, document_type, processing_status, start_time, total_processing_time from dm where {Q.IN_PERIOD}")
def _(spark, d):
    return M.scan_metrics_period(A.document_metrics(spark, d), START, END).select(
        "document_id", "document_type", "processing_status", "start_time", "total_processing_time")


@query("recent_documents", f"""with {Q.PDM} select document_id, start_time, (select count(*) from p) as total_count
  from p order by start_time desc, document_id limit 100""")
def _(spark, d):
    return M.recent_documents(A.document_metrics(spark, d), START, END).select("document_id", "start_time", "total_count")


@query("parse_json_columns", """select event_id, cast(json_extract(props,'$.k') as double) as k, 0::bigint as empty_size from events""")
def _(spark, d):
    ev = A.table(spark, d, "events").select("event_id", "props", F.lit(None).cast("string").alias("missing"))
    out = M.parse_json_columns(ev, ["props", "missing"])
    return out.select("event_id", F.col("props")["k"].alias("k"), F.size("missing").cast("long").alias("empty_size"))


@query("derive_stage_times", f"""with {Q.DM} select document_id, round(total_processing_time*0.4,6) as ocr_time,
  round(total_processing_time*0.3,6) as extraction_time, round(total_processing_time*0.2,6) as validation_time from dm""")
def _(spark, d):
    out = M.derive_stage_times(A.document_metrics(spark, d)).select("document_id", "ocr_time", "extraction_time", "validation_time")
    return r6(out, "ocr_time", "extraction_time", "validation_time")


@query("canonical_status", """select event_id, case when event_type='view' then 'success' when event_type='click' then 'needs_review' else event_type end as status from events""")
def _(spark, d):
    old = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "hitl_required").otherwise(F.col("event_type"))
    return M.canonical_status(A.table(spark, d, "events").withColumn("processing_status", old)).select(
        "event_id", F.col("processing_status").alias("status"))


def stored(spark, d):
    """The metrics as a stored table: by day, maps as JSON text, and old status names in every other row."""
    dm, e = A.document_metrics(spark, d), F.substring("document_id", 5, 20).cast("long")
    status = F.col("processing_status")
    old = F.when((status == "success") & (e % 2 == 0), "completed").when((status == "needs_review") & (e % 3 == 0), "hitl_required").otherwise(status)
    rows = dm.withColumns({"processing_status": old, "cost_breakdown": F.to_json("cost_breakdown"), "confidence_scores": F.to_json("confidence_scores"), "dt": F.to_date("start_time")})
    table = VersionedTable(spark, work_path(spark, "stored-metrics"), by="dt")
    table.replace(rows.drop("hitl_reason"))
    return table


@query("stored_metrics_kpis", f"""with {Q.PDM}, a as (select document_type, count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.COST} from p group by 1)
  select document_type, total_documents, {", ".join(f"round({c},6) as {c}" for c in ("overall_accuracy", "stp_rate", "exception_rate", "throughput_docs_per_hour", "cost_per_document", "review_cost_per_doc"))} from a""")
def _(spark, d):
    rows = M.stored_metrics(stored(spark, d), START, END)
    out = rows.groupBy("document_type").agg(F.count(F.lit(1)).alias("total_documents"), *kpi.quality_aggs(), kpi.throughput_agg(), *kpi.cost_aggs())
    cols = ("overall_accuracy", "stp_rate", "exception_rate", "throughput_docs_per_hour", "cost_per_document", "review_cost_per_doc")
    return r6(out.select("document_type", "total_documents", *cols), *cols)


QUALITY_COLS = ("overall_accuracy", "stp_rate", "exception_rate")


@query("kpi_quality", f"with {Q.PDM}, a as (select {Q.QUALITY} from p) select {_round_sql(QUALITY_COLS)} from a")
def _(spark, d):
    return r6(kpi.kpi_quality(period(spark, d)), *QUALITY_COLS)


@query("kpi_quality_by_day", f"""with {Q.DM}, a as (select cast(start_time as date) as day, {Q.QUALITY} from dm group by 1)
  select day, {_round_sql(QUALITY_COLS)} from a""")
def _(spark, d):
    df = A.document_metrics(spark, d).withColumn("day", F.to_date("start_time"))
    return r6(kpi.kpi_quality(df, ["day"]), *QUALITY_COLS)


@query("latency_p50", f"with {Q.PDM}, {Q.quantiles('p', None, 'total_processing_time')} select round(latency_p50,6) as latency_p50 from qt")
def _(spark, d):
    return r6(kpi.latency(period(spark, d)), "latency_p50", "latency_p95").select("latency_p50")


@query("latency_p95", f"""with {Q.PDM}, {Q.quantiles('p', 'document_type', 'total_processing_time')}
  select document_type, round(latency_p50,6) as latency_p50, round(latency_p95,6) as latency_p95 from qt""")
def _(spark, d):
    return r6(kpi.latency(period(spark, d), ["document_type"]), "latency_p50", "latency_p95")


@query("throughput", f"with {Q.PDM}, a as (select {Q.THROUGHPUT} from p) select round(throughput_docs_per_hour,6) as throughput_docs_per_hour from a")
def _(spark, d):
    return r6(kpi.throughput(period(spark, d)), "throughput_docs_per_hour")


@query("sla_adherence", f"""with {Q.PDM} select document_type, round(avg(case when total_processing_time<=100 then 1.0 else 0.0 end),6) as sla_adherence_rate
  from p where total_processing_time>0 group by 1""")
def _(spark, d):
    return r6(kpi.sla_adherence(period(spark, d), 100, ["document_type"]), "sla_adherence_rate")


@query("hitl_times", f"""with {Q.RT} select round(avg(date_diff('second',created_at,first_touched_at)/60.0),6) as time_to_first_review_avg,
  round(avg(date_diff('second',created_at,resolution_time)/60.0),6) as time_to_resolution_avg from tasks""")
def _(spark, d):
    return r6(kpi.hitl_times(A.review_tasks(spark, d)), "time_to_first_review_avg", "time_to_resolution_avg")


COST_COLS = ("cost_per_document", "compute_cost_per_doc", "storage_cost_per_doc", "review_cost_per_doc")


@query("kpi_cost", f"with {Q.PDM}, a as (select document_type, {Q.COST} from p group by 1) select document_type, {_round_sql(COST_COLS)} from a")
def _(spark, d):
    return r6(kpi.kpi_cost(period(spark, d), ["document_type"]), *COST_COLS)


@query("reprocess_rate", f"with {Q.PDM}, a as (select {Q.REWORK} from p) select round(reprocess_rate,6) as reprocess_rate from a")
def _(spark, d):
    return r6(kpi.rework(period(spark, d)), "reprocess_rate").select("reprocess_rate")


@query("poison_count", f"with {Q.PDM} select document_type, count(*) filter (exception_type='poison_queue') as poison_queue_count from p group by 1")
def _(spark, d):
    return kpi.rework(period(spark, d), ["document_type"]).select("document_type", "poison_queue_count")


@query("exception_breakdown", f"with {Q.PDM} select exception_type, count(*) as count from p where exception_type is not null group by 1")
def _(spark, d):
    return kpi.exception_breakdown(period(spark, d))


_EXC = " ".join(f"when '{k}' then '{v}'" for k, v in kpi.config.EXCEPTION_TEXT.items())


@query("top_exceptions", f"""with {Q.PDM} select exception_type, count(*) as count, round(count(*)*100.0/(select count(*) from p),6) as percentage,
  case exception_type {_EXC} else exception_type end as description
  from p where exception_type is not null group by 1 order by count(*) desc, min(start_time), exception_type limit 5""")
def _(spark, d):
    return r6(kpi.top_exceptions(period(spark, d)), "percentage")


@query("top_exceptions_by_type", f"""with {Q.PDM}, c as (select document_type, exception_type, count(*) as count, min(start_time) f from p where exception_type is not null group by 1,2)
  select document_type, exception_type, count from c
  qualify row_number() over (partition by document_type order by count desc, f, exception_type) <= 3""")
def _(spark, d):
    return kpi.top_exceptions(period(spark, d), 3, ["document_type"]).select("document_type", "exception_type", "count")


@query("kpi_by_doc_type", f"""with {Q.PDM} select document_type, count(*) as count, round(avg(case when processing_status='success' then 1.0 else 0.0 end),6) as success_rate,
  round(avg(case when hitl_required then 0.0 else 1.0 end),6) as stp_rate, round(avg(total_processing_time) filter (total_processing_time>0),6) as avg_processing_time
  from p group by 1""")
def _(spark, d):
    return r6(kpi.kpi_by_doc_type(period(spark, d)), "success_rate", "stp_rate", "avg_processing_time")


@query("field_metrics_period", f"""with {Q.FM} select metric_id, field_name, round(precision,6) as precision, round(f1_score,6) as f1_score from fm
  where created_at between timestamp '{START}' and timestamp '{END}'""")
def _(spark, d):
    return r6(kpi.field_metrics_period(A.field_metrics(spark, d), START, END).select("metric_id", "field_name", "precision", "f1_score"), "precision", "f1_score")


KPI_COLS = (*QUALITY_COLS, "throughput_docs_per_hour", "sla_adherence_rate", *COST_COLS, "reprocess_rate", "latency_p50", "latency_p95",
            "time_to_first_review_avg", "time_to_resolution_avg")
_TASKS_IN = "created_at between timestamp '1996-01-01' and timestamp '1999-01-01'"


def _tasks_in(spark, d):
    return M.in_period(A.review_tasks(spark, d), "1996-01-01", "1999-01-01", "created_at")


@query("kpi_dashboard", f"""with {Q.PDM}, {Q.RT}, a as (select count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.SLA}, {Q.COST}, {Q.REWORK} from p),
  {Q.quantiles('p', None, 'total_processing_time')},
  h as (select coalesce(avg(date_diff('second',created_at,first_touched_at)/60.0),0.0)::double as time_to_first_review_avg,
    coalesce(avg(date_diff('second',created_at,resolution_time)/60.0),0.0)::double as time_to_resolution_avg from tasks where {_TASKS_IN})
  select total_documents, poison_queue_count, {_round_sql(KPI_COLS)} from a, qt, h""")
def _(spark, d):
    return r6(kpi.kpi_dashboard(A.document_metrics(spark, d), START, END, _tasks_in(spark, d)), *KPI_COLS)


@query("kpi_dashboard_by_type", f"""with {Q.PDM}, a as (select document_type, count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.SLA}, {Q.COST}, {Q.REWORK} from p group by 1),
  {Q.quantiles('p', 'document_type', 'total_processing_time')}
  select document_type, total_documents, poison_queue_count, {_round_sql(KPI_COLS[:-2])} from a join qt using (document_type)""")
def _(spark, d):
    return r6(kpi.kpi_dashboard(A.document_metrics(spark, d), START, END, group_cols=["document_type"]), *KPI_COLS[:-2])


@query("kpi_dashboard_empty", "select 0::bigint as total_documents, 0::bigint as poison_queue_count, " + ", ".join(f"0.0::double as {c}" for c in KPI_COLS[:-2]))
def _(spark, d):
    return kpi.kpi_dashboard(A.document_metrics(spark, d), "1999-01-01", "1999-02-01")


_LAST24 = f"start_time between timestamp '{Q.AS_OF}' - interval 24 hour and timestamp '{Q.AS_OF}'"


@query("kpi_realtime", f"""with {Q.DM}, p as (select * from dm where {_LAST24}),
  a as (select count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.REWORK} from p),
  e as (select exception_type, count(*) c from p where exception_type is not null group by 1 order by c desc, min(start_time), exception_type limit 3)
  select total_documents, poison_queue_count, {_round_sql((*QUALITY_COLS, 'throughput_docs_per_hour'))},
    (select string_agg(exception_type||':'||c, ',' order by c desc, exception_type) from e) as top_exceptions from a""")
def _(spark, d):
    return r6(kpi.kpi_realtime(A.document_metrics(spark, d), Q.AS_OF), *QUALITY_COLS, "throughput_docs_per_hour")


@query("recent_metrics", f"""with {Q.DM}, {Q.FM}, a as (select count(*) as total_documents, coalesce(round(avg(total_processing_time),2),0.0)::double as avg_processing_time,
   count(*) filter (processing_status='success') as completed, count(*) filter (processing_status='failed') as failed, count(*) filter (hitl_required) as needs_review
   from dm where created_at between timestamp '{Q.AS_OF}' - interval 48 hour and timestamp '{Q.AS_OF}'),
  b as (select round(avg(precision),4) as avg_precision, round(avg(recall),4) as avg_recall, round(avg(f1_score),4) as avg_f1_score, round(avg(accuracy),4) as avg_accuracy
   from fm where created_at between timestamp '{Q.AS_OF}' - interval 48 hour and timestamp '{Q.AS_OF}') select * from a, b""")
def _(spark, d):
    return kpi.recent_metrics(A.document_metrics(spark, d), A.field_metrics(spark, d), Q.AS_OF, 48)


@query("cost_share", f"""with {Q.PDM}, a as (select document_type, {Q.COST} from p group by 1) select document_type, round(compute_cost_per_doc/nullif(cost_per_document,0)*100,6) as compute_pct,
  round(storage_cost_per_doc/nullif(cost_per_document,0)*100,6) as storage_pct, round(review_cost_per_doc/nullif(cost_per_document,0)*100,6) as review_pct,
  round(cost_per_document*30000,4) as monthly_cost from a""")
def _(spark, d):
    out = kpi.cost_share(kpi.kpi_cost(period(spark, d), ["document_type"]))
    return r6(out, "compute_pct", "storage_pct", "review_pct").select(
        "document_type", "compute_pct", "storage_pct", "review_pct", F.round("monthly_cost", 4).alias("monthly_cost"))


@query("recent_activity_cost", f"with {Q.PDM} select document_id, case when has_cost then round(compute+storage+review,6) else 0.0 end as total_cost from p")
def _(spark, d):
    return r6(kpi.recent_activity_cost(period(spark, d)).select("document_id", "total_cost"), "total_cost")


@query("kpi_alerts", f"""with {Q.PDM}, a as (select document_type, {Q.QUALITY}, {Q.REWORK}, avg(total_processing_time) as t from p group by 1)
  select document_type, 'critical' as severity, 'Accuracy dropped to '||printf('%.1f',round(overall_accuracy*100,1))||'%' as message from a where overall_accuracy<0.85
  union all select document_type, 'warning', 'STP rate is low: '||printf('%.1f',round(stp_rate*100,1))||'%' from a where stp_rate<0.7
  union all select document_type, 'warning', 'Poison queue has '||poison_queue_count||' documents' from a where poison_queue_count>5
  union all select document_type, 'warning', 'HITL rate above 25%: investigation required' from a where 1-stp_rate>0.25
  union all select document_type, 'warning', 'Validation accuracy below 90%: quality alert' from a where overall_accuracy<0.9
  union all select document_type, 'warning', 'Processing time above 5s: performance alert' from a where t>5""")
def _(spark, d):
    row = period(spark, d).groupBy("document_type").agg(*kpi.quality_aggs(), *kpi.rework_aggs(), F.avg("total_processing_time").alias("t"))
    return kpi.kpi_alerts(row, avg_time=F.col("t"))


@query("kpi_trend", f"""with {Q.DM}, days as (select cast(range as date) as day from range(timestamp '2024-01-25', timestamp '2024-02-04', interval 1 day)),
  a as (select cast(start_time as date) as day, count(*) n, {Q.QUALITY} from dm group by 1)
  select days.day, coalesce(n,0) as documents, round(overall_accuracy,6) as overall_accuracy, round(stp_rate,6) as stp_rate,
   round(overall_accuracy - lag(overall_accuracy) over (order by days.day),6) as accuracy_change from days left join a using (day)""")
def _(spark, d):
    out = kpi.kpi_trend(A.document_metrics(spark, d), "2024-02-03", 10)
    return r6(out, "overall_accuracy", "stp_rate", "accuracy_change").withColumn("documents", F.col("documents").cast("long"))


@query("queue_trend", f"""with {Q.RT}, h as (select range as hour from range(timestamp '1998-06-29 01:00:00', timestamp '1998-06-30 01:00:00', interval 1 hour))
  select hour, cast((select count(*) from tasks where date_trunc('hour',created_at)<=hour) - (select count(*) from tasks where date_trunc('hour',resolution_time)<=hour) as bigint) as queue_depth from h""")
def _(spark, d):
    return kpi.queue_trend(A.review_tasks(spark, d), Q.TASKS_AS_OF, 24)


@query("threshold_status", """select event_id, case when value<=10 then 'Good' when value<=30 then 'Monitor' else 'Critical' end as latency_status,
  case when value>100 then 'Good' else 'Monitor' end as volume_status, case when value>=50 then 'Good' when value>=20 then 'Monitor' else 'Critical' end as level_status from events""")
def _(spark, d):
    v = F.col("value")
    return A.table(spark, d, "events").select(
        "event_id", S.threshold_status(v, 10, 30, inverse=True).alias("latency_status"),
        S.threshold_status(v, 100, None, inclusive=False).alias("volume_status"), S.threshold_status(v, 50, 20).alias("level_status"))


@query("doc_type_rating", f"""with {Q.DM}, a as (select document_type, cast(start_time as date) as day, avg(case when processing_status<>'failed' then 1.0 else 0.0 end) r from dm group by 1,2)
  select document_type, day, case when r>0.9 then 'Excellent' when r>0.8 then 'Good' else 'Needs Attention' end as rating from a""")
def _(spark, d):
    a = A.document_metrics(spark, d).groupBy("document_type", F.to_date("start_time").alias("day")).agg(
        F.avg(F.when(F.col("processing_status") != "failed", 1.0).otherwise(0.0)).alias("r"))
    return a.select("document_type", "day", S.doc_type_rating(F.col("r")).alias("rating"))


@query("trend_sign", f"""with {Q.DM}, a as (select cast(start_time as date) as day, avg(case when processing_status='success' then 1.0 else 0.0 end) r from dm group by 1),
  b as (select day, r - lag(r) over (order by day) c from a)
  select day, case when c>0 then 'up' when c<0 then 'down' else 'flat' end as direction,
   (case when c>0 then '+' else '' end)||printf('%.1f', c*100)||'%' as change_text from b where c is not null""")
def _(spark, d):
    t = kpi.kpi_trend(A.document_metrics(spark, d), "2024-01-30", 30).where(F.col("accuracy_change").isNotNull())
    direction, text = S.trend_sign(F.col("accuracy_change"))
    return t.select("day", direction.alias("direction"), text.alias("change_text"))


@query("dedupe_types", f"with {Q.DM} select distinct document_type from dm")
def _(spark, d):
    return A.document_metrics(spark, d).select("document_type").distinct().orderBy("document_type")


@query("distinct_counts", f"with {Q.DM} select count(distinct document_type) as distinct_document_type, count(distinct processing_status) as distinct_processing_status from dm")
def _(spark, d):
    return stats.distinct_counts(A.document_metrics(spark, d), ["document_type", "processing_status"])


_REPORT_SQL = f"""with {Q.PDM}, a as (select document_type, count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.SLA}, {Q.COST}, {Q.REWORK} from p group by 1),
  {Q.quantiles('p', 'document_type', 'total_processing_time')}, k as (select * from a join qt using (document_type))"""


def _pct(col, places=1):
    return col, f"printf('%.{places}f%%', round(({col})*100,{places}))"


def _num(col, places, before="", after=""):
    return col, f"'{before}'||printf('%.{places}f', round({col},{places}))||'{after}'"


def _whole(col, after):
    return col, f"printf('%.0f', round_even({col},0))||'{after}'"


def _share(part):
    return _num(f"{part}_cost_per_doc/nullif(cost_per_document,0.0)*100", 1, after="%")


_NO_STATUS = "null::varchar"
_DEPTH = ("poison_queue_count", "poison_queue_count::varchar")


def _good(col, good, warn, middle="Needs Attention"):
    return f"case when {col}>{good} then 'Good'" + (f" when {col}>{warn} then '{middle}' else 'Critical' end" if warn is not None else f" else '{middle}' end")


#: Every line of the report: section, place, label, (value, text), status.
_LINES = [("executive", i, *x, _NO_STATUS) for i, x in enumerate([
    ("Overall Accuracy", _pct("overall_accuracy")), ("Straight-Through Processing Rate", _pct("stp_rate")), ("Exception Rate", _pct("exception_rate")),
    ("Median Processing Time", _num("latency_p50", 2, after="s")), ("95th Percentile Latency", _num("latency_p95", 2, after="s")),
    ("Throughput", _whole("throughput_docs_per_hour", " docs/hour")), ("SLA Adherence", _pct("sla_adherence_rate")), ("Cost per Document", _num("cost_per_document", 3, "$")),
    ("Reprocess Rate", _pct("reprocess_rate")), ("Operational Efficiency", _pct("1-exception_rate"))])]
_LINES += [("operational", i, *x) for i, x in enumerate([
    ("Processing Accuracy", _pct("overall_accuracy"), _good("overall_accuracy", 0.9, 0.8)), ("STP Rate", _pct("stp_rate"), _good("stp_rate", 0.8, 0.7)),
    ("Throughput", _whole("throughput_docs_per_hour", " docs/hr"), _good("throughput_docs_per_hour", 100, None, "Monitor")),
    ("P95 Latency", _num("latency_p95", 2, after="s"), "case when latency_p95<10 then 'Good' when latency_p95<30 then 'Monitor' else 'Critical' end"),
    ("Poison Queue Count", _DEPTH, _NO_STATUS), ("Reprocess Rate", _pct("reprocess_rate", 2), _NO_STATUS),
    *(line for p in ("compute", "storage", "review") for line in ((f"{p.title()} Cost", _num(f"{p}_cost_per_doc", 4, "$"), _NO_STATUS), (f"{p.title()} Share", _share(p), _NO_STATUS))),
    ("Total Cost", _num("cost_per_document", 4, "$"), _NO_STATUS), ("Documents Requiring Review", _pct("1-stp_rate"), _NO_STATUS)])]
_LINES += [("technical", i, *x, _NO_STATUS) for i, x in enumerate([
    ("P50 (Median)", _num("latency_p50", 3, after="s")), ("P95", _num("latency_p95", 3, after="s")), ("Throughput", _num("throughput_docs_per_hour", 2, after=" documents/hour")),
    ("OCR Accuracy", _pct("overall_accuracy", 3)), ("Validation Pass Rate", _pct("1-exception_rate", 3)), ("STP Rate", _pct("stp_rate", 3)),
    ("Compute Cost/Doc", _num("compute_cost_per_doc", 6, "$")), ("Storage Cost/Doc", _num("storage_cost_per_doc", 6, "$")), ("Review Cost/Doc", _num("review_cost_per_doc", 6, "$")),
    ("Total Cost/Doc", _num("cost_per_document", 6, "$")), ("Reprocess Rate", _pct("reprocess_rate", 4)), ("Poison Queue Depth", _DEPTH), ("SLA Compliance", _pct("sla_adherence_rate", 2))])]


@query("kpi_report", _REPORT_SQL + " " + " union all ".join(
    f"select document_type, '{section}' as section, '{label}' as label, round(({col})::double,6) as value, {text} as text, {status} as status from k"
    for section, _, label, (col, text), status in _LINES))
def _(spark, d):
    k = kpi.kpi_dashboard(A.document_metrics(spark, d), START, END, group_cols=["document_type"])
    return report.kpi_report(k, keys=["document_type"]).select("document_type", "section", "label", F.round("value", 6).alias("value"), "text", "status")


@query("save_snapshot", f"""with {Q.PDM}, a as (select {Q.QUALITY} from p)
  select 'executive' as template_type, timestamp '{START}' as period_start, timestamp '{END}' as period_end, {_round_sql(QUALITY_COLS)} from a""")
def _(spark, d):
    from foliant.session import work_path
    from foliant.sinks.writers import save_snapshot

    path = work_path(spark, "snapshots")
    save_snapshot(kpi.kpi_quality(period(spark, d)), path, "executive", START, END)
    out = spark.read.parquet(path).select("template_type", "period_start", "period_end", "kpis.*")
    return r6(out, *QUALITY_COLS)
