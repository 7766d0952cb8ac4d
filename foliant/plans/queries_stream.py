"""Streaming queries, run over all available input into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import config
from foliant.plans import sql as Q
from foliant.plans.queries_classify import KW
from foliant.plans.queries_review import FOLD_SQL
from foliant.plans.registry import query
from foliant.plans.sql_plan import plan_sql
from foliant.session import spread, work_path
from foliant.sources import adapters as A
from foliant.streaming import documents as D
from foliant.streaming import kpis as K
from foliant.streaming import tasks as T
from foliant.streaming import timers as X
from foliant.streaming.runner import batch_writer, log_writer, read_stream, rocksdb_state, run_available


def events(spark, d):
    return read_stream(spark, d, "events")


def timed_events(spark, d):
    """With the zoned timestamp that watermarks ask for."""
    return events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_new_documents", "select distinct 'user_'||user_id||'.pdf' as path from events")
def _(spark, d):
    names = events(spark, d).select(F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"), "ts")
    path = work_path(spark, "names")
    with rocksdb_state(spark):
        run_available(D.once(names, "path"), batch_writer(path))
    return spark.read.parquet(path).select("path")


@query("stream_documents", f"""with {plan_sql('1999-06-01', False)} select document_id, document_type, case when requires_hitl then 'needs_review' else 'success' end as processing_status,
  fields as field_count, requires_hitl as hitl_required, routing_reason as hitl_reason from decided""")
def _(spark, d):
    docs = A.order_text(A.order_docs_from(spread(read_stream(spark, d, "orders"), "o_orderkey"))).withColumn("processing_time", F.col("key") % 90 / 10.0)
    path = work_path(spark, "metrics")
    run_available(docs.transform(lambda x: D.stream_documents(x, "1999-06-01")), batch_writer(path))
    wanted = ["document_id", "document_type", "processing_status", "field_count", "hitl_required", "hitl_reason"]
    return D.current_metrics(spark.read.parquet(path).select(*wanted, "batch"))


_ROLL = f"p as (select * from dm where start_time >= timestamp '{Q.AS_OF}' - interval 24 hour and start_time < timestamp '{Q.AS_OF}')"


@query("stream_kpis", f"""with {Q.DM}, {_ROLL}, a as (select count(*) as total_documents, {Q.QUALITY}, {Q.THROUGHPUT}, {Q.REWORK}, avg(total_processing_time) as t from p)
  select total_documents, poison_queue_count, round(overall_accuracy,6) as overall_accuracy, round(stp_rate,6) as stp_rate, round(exception_rate,6) as exception_rate,
   round(reprocess_rate,6) as reprocess_rate, round(throughput_docs_per_hour,6) as throughput_docs_per_hour, round(t,6) as avg_processing_time from a""")
def _(spark, d):
    log = K.partials_log(spark, work_path(spark, "partials"))
    run_available(A.events_as_metrics(events(spark, d)), log.writer(K.window_partials))
    out = K.rolling_kpis(log.read(), Q.AS_OF)
    cols = ["overall_accuracy", "stp_rate", "exception_rate", "reprocess_rate", "throughput_docs_per_hour", "avg_processing_time"]
    return out.select("total_documents", "poison_queue_count", *[F.round(c, 6).alias(c) for c in cols])


@query("stream_task_state", FOLD_SQL)
def _(spark, d):
    log = T.summary_log(spark, work_path(spark, "tasks"))
    run_available(A.task_events_from(events(spark, d)), log.writer(T.summarize_events))
    return T.task_state(log.read())


@query("stream_running_stats", f"with {Q.DM} select document_type, count(*) as documents, round(avg(overall),6) as average_confidence, round(avg(total_processing_time),6) as average_processing_time from dm group by 1")
def _(spark, d):
    m = A.events_as_metrics(events(spark, d)).select(
        "document_type", F.col("confidence_scores")["overall"].alias("confidence"), F.col("total_processing_time").alias("processing_time"))
    log = K.running_log(spark, work_path(spark, "running"), ["document_type"])
    run_available(K.stream_running_stats(m, ["document_type"]), log_writer(log), mode="update")
    return log.read().drop("batch").withColumns({c: F.round(c, 6) for c in ("average_confidence", "average_processing_time")})


@query("on_new_document", "select event_type, count(*) as seen from events group by 1")
def _(spark, d):
    from foliant.operators.handlers import on_batch

    path = work_path(spark, "callbacks")
    count = batch_writer(path, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("seen")))
    run_available(events(spark, d), on_batch(count))
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("seen").alias("seen"))


@query("on_classified", f"with {KW} select kc as document_type, count(*) as seen from kw group by 1")
def _(spark, d):
    from foliant.operators.classify import classify_keywords
    from foliant.operators.handlers import on_batch

    path = work_path(spark, "classified")
    docs = classify_keywords(A.order_text(A.order_docs_from(spread(read_stream(spark, d, "orders"), "o_orderkey"))), "full_text")
    count = batch_writer(path, lambda b: b.groupBy(F.col("keyword_class").alias("document_type")).agg(F.count(F.lit(1)).alias("seen")))
    run_available(docs, on_batch(count))
    return spark.read.parquet(path).groupBy("document_type").agg(F.sum("seen").alias("seen"))


#: When the stream's clock stands after the events, and two later moments at which no events come.
MOMENTS = ("2024-02-01 00:00:00", "2024-02-02 12:00:00")
_SLA = " ".join(f"when {p} then {h * 3600}" for p, h in config.SLA_HOURS.items())


@query("stream_task_timers", f"with st as ({FOLD_SQL}), ev as (select 'T'||user_id||'-'||strftime(ts,'%j') as task_id, ts, event_id, event_type, (user_id%3+1)::integer as p from events),"
       f" c as (select task_id, min(ts) as created, max(p) as p from ev group by 1), z(now) as (values (timestamp '{MOMENTS[-1]}'))," + f"""
  third as (select task_id, ts from ev where event_type='error' qualify row_number() over (partition by task_id order by ts, event_id)={config.MAX_ATTEMPTS})
  select task_id, 'retry' as action, next_retry as due_at, null::integer as priority from st, z where status='failed' and next_retry<=now
  union all select task_id, 'timeout', first_touched_at + interval {config.TASK_TIMEOUT_SECONDS} second, null from st, z where status='in_progress' and first_touched_at + interval {config.TASK_TIMEOUT_SECONDS} second <= now
  union all select task_id, 'poisoned', third.ts, null from st join third using (task_id) where status='poisoned'
  union all select task_id, 'escalation', created + to_seconds(case p {_SLA} end + k*{config.ESCALATION_SECONDS}), (p+k+1)::integer from st join c using (task_id), z, range({config.MAX_PRIORITY}) r(k)
   where status not in ('completed','cancelled','poisoned') and p+k < {config.MAX_PRIORITY} and created + to_seconds(case p {_SLA} end + k*{config.ESCALATION_SECONDS}) <= now""")
def _(spark, d):
    """Three runs of one job: the events, and then two moments that only the clock brings. Ten users, with a task for each day of the year, are a shelf."""
    shelf = F.expr("left(task_id, length(task_id) - 5)")  # without the day and the user's last digit
    ticks, path, ckpt = work_path(spark, "clock"), work_path(spark, "timers"), work_path(spark, "timers-state")
    A.timed_tasks(A.table(spark, d, "events")).limit(0).unionByName(X.clock(spark)).write.parquet(ticks)
    for n, moment in enumerate((None, *MOMENTS)):
        if moment:
            X.clock(spark, moment).coalesce(1).write.mode("append").parquet(ticks)
        rows = A.timed_tasks(events(spark, d))
        both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(ticks))
        with rocksdb_state(spark):
            run_available(X.task_timers(both, shelf=shelf), batch_writer(f"{path}/run={n}"), ckpt)
    return spark.read.parquet(path).select("task_id", "action", F.col("due_at").cast("timestamp_ntz").alias("due_at"), "priority")
