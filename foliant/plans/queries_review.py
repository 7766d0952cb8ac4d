"""Queries of the review queue, review tasks, feedback and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.operators import joins as J
from foliant.operators import queue as K
from foliant.operators import review as V
from foliant.plans import sql as Q
from foliant.plans.registry import query
from foliant.sources import adapters as A

NOW = Q.TASKS_AS_OF
NAMES = ["urgent", "high", "normal", "low"]
REVIEW_NAMES = ["critical", "high", "medium", "low"]
SQL_NAMED = f"{Q.RT}, named as (select *, {Q.pick(NAMES, 'key')} as qname, {Q.pick(REVIEW_NAMES, 'key // 2')} as rname from tasks)"


def named(spark, d, names=NAMES, step=1):
    return A.review_tasks(spark, d).withColumn("priority", A.pick(names, F.floor(F.col("key") / step)))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("create_tasks", f"""with {SQL_NAMED} select sha256(document_id||'|'||strftime(created_at,'%Y-%m-%d %H:%M:%S')) as task_id, document_id, reason, qname as priority, 'pending' as status, 0::integer as attempts from named""")
def _(spark, d):
    docs = named(spark, d).withColumnRenamed("reason", "routing_reason")
    return K.create_tasks(docs).select("task_id", "document_id", "reason", "priority", "status", "attempts")


_QRANK = "case qname when 'urgent' then 0 when 'high' then 1 when 'normal' then 2 else 3 end"


@query("pop_batch", f"with {SQL_NAMED} select task_id, qname as priority, created_at from named where status='pending' order by {_QRANK}, created_at, task_id limit 10")
def _(spark, d):
    return K.pop_batch(named(spark, d)).select("task_id", "priority", "created_at")


def attempted(spark, d):
    k = F.col("key")
    return A.review_tasks(spark, d).withColumns({"attempts": (k % 3).cast("int"), "failed_at": F.col("created_at")})


_RETRY = f"""{Q.RT}, rs as (select *, (key%3+1)::integer as attempts, case when key%3+1>=3 then 'poisoned' else 'failed' end as st,
  case when key%3+1<3 then created_at + to_seconds(60*pow(2,key%3)::bigint) end as next_retry from tasks)"""


@query("retry_schedule", f"with {_RETRY} select task_id, st as status, attempts, next_retry from rs")
def _(spark, d):
    return K.retry_schedule(attempted(spark, d)).select("task_id", "status", "attempts", "next_retry")


@query("due_retries", f"with {_RETRY} select task_id, 'pending' as status from rs where st='failed' and next_retry<=timestamp '{NOW}'")
def _(spark, d):
    return K.due_retries(K.retry_schedule(attempted(spark, d)), NOW).select("task_id", "status")


@query("timeouts", f"with {Q.RT} select task_id, 'Processing timeout' as last_error, case when key%3+1>=3 then 'poisoned' else 'failed' end as status from tasks where status='in_progress' and created_at<timestamp '{NOW}' - interval 3600 second")
def _(spark, d):
    late = K.timeouts(attempted(spark, d).drop("failed_at").withColumn("assigned_at", F.col("created_at")), NOW)
    return K.retry_schedule(late).select("task_id", "last_error", "status")


@query("poison_alerts", f"with {_RETRY} select 'poison_queue' as alert_type, task_id, document_id, reason, attempts from rs where st='poisoned'")
def _(spark, d):
    tasks = K.retry_schedule(attempted(spark, d)).withColumn("last_error", F.lit("error"))
    return K.poison_alerts(tasks, NOW).select("alert_type", "task_id", "document_id", "reason", "attempts")


@query("queue_status", f"with {_RETRY} select 0::bigint as queue_size, count(*) filter (st='poisoned') as poison_queue_size, 0::bigint as in_progress_count, 0::bigint as completed_count, count(*) filter (st='failed') as failed_count, count(*) as total from rs")
def _(spark, d):
    return K.queue_status(K.retry_schedule(attempted(spark, d)))


@query("cancel_tasks", f"with {Q.RT} select task_id, case when status not in ('completed') and key in (select l_orderkey from lineitem where l_returnflag='R') then 'cancelled' else status end as status from tasks")
def _(spark, d):
    asked = A.table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.concat(F.lit("TASK-"), F.col("l_orderkey").cast("string")).alias("task_id"))
    return K.cancel_tasks(A.review_tasks(spark, d), asked).select("task_id", "status")


_STEPS = "||chr(10)||".join("'" + s.replace("\n", "'||chr(10)||'") + "'" for s in config.REVIEW_STEPS)


@query("review_instructions", f"""with {Q.RT}, h as (select task_id, case reason when 'low_confidence' then 'Document has low confidence score ('||printf('%.2f',confidence_score)||')'||chr(10)||'Please verify all extracted field values'||chr(10)
  when 'validation_error' then 'Document failed validation rules:'||chr(10)||(case when errors>0 then '  - total mismatch'||chr(10) else '' end)
  when 'missing_required_field' then 'Required fields are missing or have low confidence'||chr(10)||'Please extract missing field values manually'||chr(10)
  when 'business_rule_violation' then 'Document violates business rules:'||chr(10)||(case when errors>0 then '  - total mismatch'||chr(10) else '' end) else '' end as head from tasks)
  select task_id, md5(head||{_STEPS}) as text from h""")
def _(spark, d):
    return K.review_instructions(A.review_tasks(spark, d)).select("task_id", F.md5(F.array_join("instructions", "\n")).alias("text"))


@query("review_focus", f"with {Q.RT} select task_id, case document_type when 'invoice' then 'invoice_review' when 'receipt' then 'receipt_review' end as task_type, case document_type when 'invoice' then 'invoice_number,vendor_name,total_amount,invoice_date' when 'receipt' then 'merchant_name,total_amount,transaction_date' end as priority_fields from tasks")
def _(spark, d):
    return K.review_focus(A.review_tasks(spark, d)).select("task_id", "task_type", F.array_join("priority_fields", ",").alias("priority_fields"))


_DEADLINE = "created_at + to_hours((case priority when 1 then 72 when 2 then 24 else 2 end))"


def with_deadline(spark, d):
    return A.review_tasks(spark, d).withColumn("sla_deadline", V.sla_deadline(F.col("created_at"), F.col("priority")))


@query("sla_deadline", f"with {Q.RT} select task_id, {_DEADLINE} as sla_deadline from tasks")
def _(spark, d):
    return with_deadline(spark, d).select("task_id", "sla_deadline")


@query("assign_reviewers", f"""with recursive {Q.RT}, q as (select task_id, document_type, row_number() over (partition by document_type order by created_at, task_id) as k from tasks),
  r as (select 'rev_'||s_suppkey as user_id, {Q.pick(A.TYPES[:5], 's_suppkey')} as document_type, s_suppkey%7 as w, s_suppkey as ord from supplier where s_suppkey%9<>0),
  n as (select document_type, count(*) as tasks from q group by 1),
  pl as (select document_type, user_id, row_number() over (partition by document_type order by lv, ord) as k from
    (select r.document_type, user_id, ord, unnest(range(w, w+tasks)) as lv from r join n using (document_type)))
  select q.task_id, pl.user_id as assigned_to from q left join pl using (document_type, k)""")
def _(spark, d):
    return V.assign_reviewers(A.review_tasks(spark, d), A.reviewers(spark, d)).select("task_id", "assigned_to")


# Reviewers of two types each: the SQL takes the tasks one by one, with a number load * 1000000 + reviewer for each reviewer; the
# list it folds holds these numbers first, and then the number chosen for each task.
_BEST = "list_min(list_filter(a[1:n], lambda y: y%1000000%5=x[1] or (y%1000000+1)%5=x[1]))"


@query("assign_shared_reviewers", f"""with {Q.RT}, q as (select task_id, list_position({A.TYPES[:5]}, document_type) - 1 as kind, row_number() over (order by created_at, task_id) as k from tasks),
  s as (select list(s_suppkey%7*1000000+s_suppkey) as w, count(*) as n from supplier where s_suppkey%9<>0), t as (select list([kind::bigint] order by k) as kinds from q),
  f as (select n, list_reduce(kinds, lambda a, x: list_transform([{_BEST}], lambda b: list_concat(list_transform(a[1:n], lambda y: case when y=b then y+1000000 else y end), a[n+1:], [b]))[1], w) as a from s, t),
  b as (select unnest(a[n+1:]) as best, generate_subscripts(a[n+1:], 1) as k from f)
  select task_id, 'rev_'||(best%1000000) as assigned_to, best//1000000 as workload_before from b join q using (k)""")
def _(spark, d):
    two = A.reviewers(spark, d).withColumn("specializations", F.array(A.pick(A.TYPES[:5], F.col("ord")), A.pick(A.TYPES[:5], F.col("ord") + 1)))
    return V.assign_reviewers(A.review_tasks(spark, d), two).select("task_id", "assigned_to", "workload_before")


def touch_events(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("TASK-"), F.col("l_orderkey").cast("string")).alias("task_id"),
                     F.concat(F.lit("rev_"), ((F.col("l_orderkey") + F.col("l_linenumber") % 2) % 50).cast("string")).alias("reviewer_id"), F.col("l_shipdate").alias("ts"))


_TOUCH = f"""{Q.RT}, ev as (select 'TASK-'||l_orderkey as task_id, 'rev_'||((l_orderkey+l_linenumber%2)%50) as assigned_to, min(l_shipdate) as t from lineitem group by 1,2),
  tc as (select tasks.*, t from tasks join ev using (task_id, assigned_to))"""


@query("first_touch", f"""with {_TOUCH}, ft as (select *, case when first_touched_at is null or t<first_touched_at then t else first_touched_at end as f from tc)
  select task_id, case when status in ('pending','assigned') then 'in_progress' else status end as status, f as first_touched_at, round((epoch_us(f)-epoch_us(created_at))/60000000.0,6) as age_to_first_touch from ft""")
def _(spark, d):
    return r6(V.first_touch(A.review_tasks(spark, d), touch_events(spark, d)).select("task_id", "status", "first_touched_at", "age_to_first_touch"), "age_to_first_touch")


@query("complete_tasks", f"with {_TOUCH} select task_id, 'completed' as status, round((epoch_us(t)-epoch_us(created_at))/60000000.0,6) as age_to_resolve from tc")
def _(spark, d):
    return r6(V.complete_tasks(A.review_tasks(spark, d), touch_events(spark, d)).select("task_id", "status", "age_to_resolve"), "age_to_resolve")


_FB = f"""{Q.RT}, cr0 as (select 'TASK-'||l_orderkey as task_id, {Q.pick(A.FIELDS, 'l_linenumber')} as field_name, l_quantity::bigint as q,
   case when l_quantity::bigint%4=0 then 'INV-'||l_orderkey else '$'||cast(l_extendedprice as decimal(18,2)) end as corrected_value, case when l_returnflag='A' then 'typo' end as reason,
   l_partkey*100000+l_suppkey*100+l_quantity::bigint as pos from lineitem),
  cr as (select task_id, field_name, arg_max(q, pos) as q, arg_max(corrected_value, pos) as corrected_value, max(pos) as mp from cr0 group by 1,2),
  cx as (select cr.*, cr0.reason from cr join cr0 on cr0.task_id=cr.task_id and cr0.field_name=cr.field_name and cr0.pos=cr.mp),
  tf as (select task_id, key, document_type, status, 'invoice_number' as field_name, 'INV-'||key as original_value, (50+(key*3)%50)/100.0::double as confidence from tasks
   union all select task_id, key, document_type, status, 'total_amount', '$'||total, (50+(key*7)%50)/100.0::double from tasks
   union all select task_id, key, document_type, status, 'vendor_name', 'Trader '||o_custkey, (50+(key*9)%50)/100.0::double from tasks),
  fb as (select tf.*, corrected_value, coalesce(reason,'Manual correction') as correction_reason, coalesce(case when q%3<>0 then q%5+1 end,5)::integer as rating
   from tf join cx using (task_id, field_name) where original_value is distinct from corrected_value)"""


@query("collect_feedback", f"with {_FB} select task_id, field_name, original_value, corrected_value, correction_reason, rating as confidence_rating from fb")
def _(spark, d):
    return V.collect_feedback(A.review_tasks(spark, d), A.corrections(spark, d)).select(
        "task_id", "field_name", "original_value", "corrected_value", "correction_reason", "confidence_rating")


@query("feedback_to_field", f"with {_FB} select task_id, field_name, round(confidence,6) as confidence, rating as confidence_rating from fb")
def _(spark, d):
    tasks = A.review_tasks(spark, d)
    fb = V.collect_feedback(tasks, A.corrections(spark, d)).select("task_id", "field_name", "confidence_rating")
    return J.feedback_to_field(fb, V.task_fields(tasks), ["task_id", "field_name"]).select(
        "task_id", "field_name", F.round("confidence", 6).alias("confidence"), "confidence_rating")


@query("apply_corrections", f"with {_FB} select tf.task_id, tf.field_name, coalesce(corrected_value, original_value) as value from tf left join cx using (task_id, field_name)")
def _(spark, d):
    return V.apply_corrections(A.review_tasks(spark, d), A.corrections(spark, d))


@query("reviewer_stats", f"with {Q.RT} select assigned_to, count(*) filter (status not in ('completed','approved')) as current_workload, count(*) filter (status in ('completed','approved')) as completed_tasks, round(avg((epoch_us(resolution_time)-epoch_us(created_at))/60000000.0),6) as avg_resolution_minutes from tasks where assigned_to is not null group by 1")
def _(spark, d):
    return r6(V.reviewer_stats(A.review_tasks(spark, d)), "avg_resolution_minutes")


def records(spark, d):
    tasks = A.review_tasks(spark, d)
    return V.training_records(tasks, V.collect_feedback(tasks, A.corrections(spark, d)))


_TR = f"""{_FB}, g as (select task_id, count(*) as n, sum(rating-5*confidence) as delta from fb group by 1),
  tr as (select tasks.task_id, document_type, resolution_time as created_at, coalesce(n,0) as corrections, coalesce(delta,0.0) as delta from tasks left join g using (task_id) where status in ('completed','approved'))"""


@query("training_records", f"""with {_TR} select tr.task_id, tr.document_type, tr.created_at, fb.field_name, original_value, corrected_value, correction_reason, rating as reviewer_confidence,
  round(rating-5*confidence,6) as confidence_delta, case when fb.task_id is not null then 'pattern_match' end as extraction_method from tr left join fb on fb.task_id=tr.task_id""")
def _(spark, d):
    """Every record with every correction; a record without one is one row."""
    rows = records(spark, d).select("task_id", "document_type", "created_at", F.explode_outer("field_corrections").alias("c"))
    return rows.select("task_id", "document_type", "created_at", "c.field_name", "c.original_value", "c.corrected_value", "c.correction_reason", "c.reviewer_confidence",
                       F.round("c.confidence_delta", 6).alias("confidence_delta"), "c.extraction_method")


@query("get_training_data", f"with {_TR} select task_id, created_at, corrections::integer as corrections from tr where document_type='invoice' order by created_at desc, task_id limit 100")
def _(spark, d):
    return V.get_training_data(A.review_tasks(spark, d), A.corrections(spark, d), "invoice").select("task_id", "created_at", F.size("field_corrections").alias("corrections"))


@query("training_summary", f"""with {_TR}, n as (select * from tr order by created_at desc, task_id limit 1000), f as (select field_name, count(*) c from fb where task_id in (select task_id from n) group by 1 order by c desc, field_name limit 10)
  select 'total' as kind, 'samples' as name, count(*) as count from n union all select 'total', 'corrections', sum(corrections)::bigint from n
  union all select 'document_type', document_type, count(*) from n group by 2 union all select 'field', field_name, c from f""")
def _(spark, d):
    return V.training_summary(A.review_tasks(spark, d), A.corrections(spark, d))


@query("export_training_data", f"with {_TR} select task_id, document_type from tr where document_type='receipt'")
def _(spark, d):
    from foliant.session import work_path
    from foliant.sinks.writers import export_training_data

    path = work_path(spark, "training")
    export_training_data(records(spark, d), path, "receipt")
    return spark.read.schema("task_id string, document_type string").json(path)


@query("sla_statistics", f"""with {Q.RT}, x as (select *, {_DEADLINE} as dl, status='completed' and first_touched_at is not null as tc from tasks)
  select round(avg((epoch_us(first_touched_at)-epoch_us(created_at))/60000000.0) filter (tc),6) as avg_age_to_first_touch, round(avg((epoch_us(resolution_time)-epoch_us(created_at))/60000000.0) filter (tc),6) as avg_age_to_resolve,
   count(*) filter (tc) as total_completed_tasks, count(*) filter (dl<timestamp '{NOW}' and status<>'completed') as current_sla_violations from x""")
def _(spark, d):
    return r6(V.sla_statistics(with_deadline(spark, d), NOW), "avg_age_to_first_touch", "avg_age_to_resolve")


@query("review_queue_status", f"""with {Q.RT}, x as (select *, {_DEADLINE} as dl from tasks where status in ('pending','assigned','in_progress'))
  select count(*) as total_active_tasks, count(*) filter (status='pending') as pending_tasks, count(*) filter (status='assigned') as assigned_tasks, count(*) filter (status='in_progress') as in_progress_tasks,
   count(*) filter (dl<timestamp '{NOW}') as sla_violations, round(avg((epoch_us(timestamp '{NOW}')-epoch_us(created_at))/60000000.0),4) as avg_queue_age_minutes,
   count(*) filter (priority=1) as priority_1, count(*) filter (priority=2) as priority_2, count(*) filter (priority=3) as priority_3, round(count(*) filter (dl<timestamp '{NOW}')*100.0/count(*),6)::double as violation_rate from x""")
def _(spark, d):
    out = V.review_queue_status(with_deadline(spark, d), NOW)
    return out.withColumns({"avg_queue_age_minutes": F.round("avg_queue_age_minutes", 4), "violation_rate": F.round("violation_rate", 6)})


@query("reviewer_block", f"""with {Q.RT}, c as (select assigned_to, count(*) filter (status in ('assigned','in_progress')) as o, count(*) filter (status='completed') as d from tasks where assigned_to is not null group by 1)
  select 'rev_'||s_suppkey as user_id, s_name as name, s_suppkey%7 + coalesce(o,0) as current_workload, coalesce(d,0) as completed_tasks, s_suppkey%9<>0 as is_available, {Q.pick(A.TYPES[:5], 's_suppkey')} as specialization
  from supplier left join c on c.assigned_to='rev_'||s_suppkey""")
def _(spark, d):
    out = V.reviewer_block(A.review_tasks(spark, d), A.reviewers(spark, d))
    return out.withColumn("specialization", F.array_join("specializations", ",")).drop("specializations")


@query("escalate_overdue", f"""with {Q.RT}, x as (select *, {_DEADLINE} as dl from tasks) select task_id, case when dl<timestamp '{NOW}' and status<>'completed'
  then least(3, priority + floor((epoch_us(timestamp '{NOW}')-epoch_us(dl))/900000000.0)+1) else priority end::integer as priority from x""")
def _(spark, d):
    return V.escalate_overdue(with_deadline(spark, d), NOW).select("task_id", "priority")


_RRANK = "case rname when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"


@query("pending_tasks", f"with {SQL_NAMED} select task_id, rname as priority, created_at from named where status='pending' order by {_RRANK}, created_at, task_id limit 50")
def _(spark, d):
    return V.pending_tasks(named(spark, d, REVIEW_NAMES, 2)).select("task_id", "priority", "created_at")


@query("priority_counts", f"with {SQL_NAMED} select rname as priority, count(*) as count from named where status='pending' group by 1")
def _(spark, d):
    return V.priority_counts(named(spark, d, REVIEW_NAMES, 2))


@query("daily_summary", f"with {SQL_NAMED} select count(*) filter (status='pending') as pending_reviews, count(*) filter (status='completed' and cast(resolution_time as date)=date '1998-06-30') as completed_today, count(*) filter (status='pending' and rname='critical') as critical_priority, count(*) filter (status='pending' and rname='high') as high_priority from named")
def _(spark, d):
    return V.daily_summary(named(spark, d, REVIEW_NAMES, 2), "1998-06-30")


@query("submit_review", f"with {Q.RT} select task_id, case when key%3=0 then 'rejected' else 'approved' end as review_decision, case when key%2=0 then 'seen' else '' end as reviewer_notes, 1::integer as corrected, 'completed' as status from tasks where status='in_progress'")
def _(spark, d):
    tasks = A.review_tasks(spark, d).where(F.col("status") == "in_progress")
    k = F.col("key")
    some = lambda cond, name, v: F.when(cond, F.create_map(F.lit(name), F.lit(v))).otherwise(F.create_map().cast("map<string,string>"))
    form = F.map_concat(F.create_map(F.lit("total_amount"), F.lit("$1")), some(k % 3 == 0, "review_decision", "rejected"), some(k % 2 == 0, "reviewer_notes", "seen"))
    forms = tasks.select("task_id", form.alias("fields"), F.col("created_at").alias("ts"))
    return V.submit_review(tasks, forms).select("task_id", "review_decision", "reviewer_notes", F.size("corrected_fields").alias("corrected"), "status")


EVENTS_SQL = """te as (select 'T'||user_id||'-'||lpad(dayofyear(ts)::varchar,3,'0') as task_id, ts, event_id, case event_type when 'error' then 'attempt_failed' when 'signup' then 'touched'
   when 'purchase' then 'completed' when 'click' then 'cancel_requested' else 'started' end as event from events)"""
FOLD_SQL = f"""with {EVENTS_SQL}, o as (select *, row_number() over (partition by task_id order by ts, event_id) as n,
    case when event='attempt_failed' then count(*) filter (event='attempt_failed') over (partition by task_id order by ts, event_id) end as f from te),
  e as (select task_id, min(n) filter (event in ('completed','cancel_requested') or f=3) as stop from o group by 1),
  l as (select o.*, stop from o join e using (task_id) where stop is null or n<=stop),
  s as (select task_id, count(*) filter (event='attempt_failed') as attempts, max(ts) filter (event='attempt_failed') as lf, min(ts) filter (event='touched') as first_touched_at,
    arg_max(event, n) as le, max(stop) as stop from l group by 1)
  select task_id, case when stop is not null then case le when 'completed' then 'completed' when 'cancel_requested' then 'cancelled' else 'poisoned' end
     when le='attempt_failed' then 'failed' when first_touched_at is not null then 'in_progress' else 'pending' end as status, attempts::integer as attempts, first_touched_at,
   case when stop is null and le='attempt_failed' then lf + to_seconds(60*pow(2,attempts-1)::bigint) end as next_retry from s"""


@query("task_state", FOLD_SQL)
def _(spark, d):
    return K.fold_task_events(A.task_events(spark, d))


@query("custom_task_processor", f"with {Q.RT}, k as (select case when key%7=0 then null else document_type end as document_type from tasks) select document_type, case when document_type in ('invoice','receipt') then document_type else 'default' end as handler, count(*) as handled from k group by all")
def _(spark, d):
    from foliant.operators.handlers import TaskHandlers

    by = lambda name: lambda df: df.select("document_type", F.lit(name).alias("handler"))
    h = TaskHandlers(by("default"))
    h.register("invoice", by("invoice"))
    h.register("receipt", by("receipt"))
    tasks = A.review_tasks(spark, d).withColumn("document_type", F.when(F.col("key") % 7 != 0, F.col("document_type")))
    return h.process(tasks).groupBy("document_type", "handler").agg(F.count(F.lit(1)).alias("handled"))
