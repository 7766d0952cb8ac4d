"""The review queue: tasks, retries with backoff, timeouts, poisoned and cancelled tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.operators.joins import top_per_group
from foliant.sources.metrics import plus_seconds, ts

TERMINAL = ("completed", "poisoned", "cancelled")


def rank(priority: Column, ranks: dict[str, int]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(m, priority), F.lit(len(ranks)))


def create_tasks(docs: DataFrame) -> DataFrame:
    """New pending tasks for routed documents; the id follows from document and time, so retries repeat it."""
    return docs.select(
        F.sha2(F.concat_ws("|", "document_id", F.col("created_at").cast("string")), 256).alias("task_id"), "document_id", "document_type",
        F.col("routing_reason").alias("reason"), "priority", "confidence_score", "created_at", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def pop_batch(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The next pending tasks: most urgent first, oldest first within a priority."""
    return tasks.where(F.col("status") == "pending").orderBy(rank(F.col("priority"), config.QUEUE_RANK), "created_at", "task_id").limit(n)


def retry_delay(attempts: Column) -> Column:
    return (config.RETRY_BASE_SECONDS * F.pow(F.lit(config.RETRY_FACTOR), attempts - 1)).cast("long")


def retry_schedule(tasks: DataFrame, failed_at: str = "failed_at") -> DataFrame:
    """One more failed attempt per task: scheduled again with doubled delay, or poisoned at the limit."""
    n = F.col("attempts") + 1
    dead = n >= config.MAX_ATTEMPTS
    return tasks.withColumns({
        "status": F.when(dead, "poisoned").otherwise("failed"),
        "next_retry": F.when(~dead, plus_seconds(F.col(failed_at), retry_delay(n))), "attempts": n})


def due_retries(tasks: DataFrame, as_of) -> DataFrame:
    """Failed tasks whose time has come, pending again."""
    due = (F.col("status") == "failed") & (F.col("next_retry") <= ts(as_of, tasks, "next_retry"))
    return tasks.where(due).withColumn("status", F.lit("pending")).withColumn("next_retry", F.lit(None).cast(tasks.schema["next_retry"].dataType))


def timeouts(tasks: DataFrame, as_of, seconds: int = config.TASK_TIMEOUT_SECONDS) -> DataFrame:
    """Tasks in progress for too long, ready for :func:`retry_schedule`."""
    limit = ts(as_of, tasks, "assigned_at") - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    late = tasks.where((F.col("status") == "in_progress") & (F.col("assigned_at") < limit))
    return late.withColumns({"last_error": F.lit("Processing timeout"), "failed_at": ts(as_of, tasks, "assigned_at")})


def poison_alerts(tasks: DataFrame, as_of) -> DataFrame:
    return tasks.where(F.col("status") == "poisoned").select(
        F.lit("poison_queue").alias("alert_type"), "task_id", "document_id", "document_type", "reason", "attempts", "last_error", "created_at",
        F.lit(str(as_of)).alias("timestamp"))


def queue_status(tasks: DataFrame) -> DataFrame:
    s = F.col("status")
    return tasks.agg(*[F.count_if(s == x).alias(n) for x, n in (
        ("pending", "queue_size"), ("poisoned", "poison_queue_size"), ("in_progress", "in_progress_count"), ("completed", "completed_count"),
        ("failed", "failed_count"))], F.count(F.lit(1)).alias("total"))


def cancel_tasks(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested tasks become cancelled unless they are already finished."""
    asked = requests.select("task_id").distinct().withColumn("__c", F.lit(True))
    cancel = F.coalesce("__c", F.lit(False)) & ~F.col("status").isin(*TERMINAL)
    return tasks.join(asked, "task_id", "left").withColumn("status", F.when(cancel, "cancelled").otherwise(F.col("status"))).drop("__c")


def review_instructions(tasks: DataFrame) -> DataFrame:
    """Adds the text lines a reviewer sees: by reason, then the fixed steps."""
    reason = F.col("reason")
    errors = F.transform("validation_errors", lambda e: F.concat(F.lit("  - "), e))
    head = (
        F.when(reason == "low_confidence", F.array(
            F.concat(F.lit("Document has low confidence score ("), F.format_string("%.2f", "confidence_score"), F.lit(")")),
            F.lit("Please verify all extracted field values")))
        .when(reason == "validation_error", F.concat(F.array(F.lit("Document failed validation rules:")), errors))
        .when(reason == "missing_required_field", F.array(F.lit("Required fields are missing or have low confidence"),
                                                          F.lit("Please extract missing field values manually")))
        .when(reason == "business_rule_violation", F.concat(F.array(F.lit("Document violates business rules:")), errors))
        .otherwise(F.array().cast("array<string>"))
    )
    return tasks.withColumn("instructions", F.concat(head, F.array(*[F.lit(s) for s in config.REVIEW_STEPS])))


def review_focus(tasks: DataFrame) -> DataFrame:
    """Adds what reviewers of the type look at first."""
    def table(key):
        return F.create_map(*[x for t, v in config.REVIEW_FOCUS.items() for x in (F.lit(t), F.array(*[F.lit(s) for s in v[key]]))])

    kinds = F.create_map(*[F.lit(x) for t, v in config.REVIEW_FOCUS.items() for x in (t, v["task_type"])])
    t = F.col("document_type")
    return tasks.withColumns({"task_type": F.try_element_at(kinds, t),
                              **{k: F.try_element_at(table(k), t) for k in ("priority_fields", "validation_focus", "business_rules")}})


def fold_task_events(events: DataFrame) -> DataFrame:
    """Current state per task from its events (task_id, ts, event), by event time.

    A completed or cancelled task ignores what comes later; the third failure poisons it, and only
    failures before the end count. No group is sorted: the third failure is the last of the first
    three, which the rank filter cuts to three rows per task before the shuffle, and everything else
    is an aggregate.
    """
    order = ["ts", "event_id"]
    third = (
        top_per_group(events.where(F.col("event") == "attempt_failed"), ["task_id"], order, config.MAX_ATTEMPTS)
        .groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("at"))
        .select("task_id", F.when(F.col("n") >= config.MAX_ATTEMPTS, F.col("at")).alias("poisoned"))
    )
    at = F.struct(*order)
    ends = events.groupBy("task_id").agg(
        F.min(F.when(F.col("event") == "completed", at)).alias("completed"),
        F.min(F.when(F.col("event") == "cancel_requested", at)).alias("cancelled"))
    limits = ends.join(third, "task_id", "left").select(
        "task_id", "completed", "cancelled", "poisoned", F.least("completed", "cancelled", "poisoned").alias("end"))
    live = events.withColumn("at", at).join(limits, "task_id").where(F.col("end").isNull() | (F.col("at") <= F.col("end")))
    fail = F.col("event") == "attempt_failed"
    state = live.groupBy("task_id").agg(
        F.count_if(fail).cast("int").alias("attempts"), F.max(F.when(fail, F.col("ts"))).alias("last_failure"), F.first("end").alias("end"),
        F.first("completed").alias("completed"), F.first("cancelled").alias("cancelled"), F.max_by("event", "at").alias("last_event"),
        F.min(F.when(F.col("event") == "touched", F.col("ts"))).alias("first_touched_at"))
    status = (
        F.when(F.col("end") == F.col("completed"), "completed").when(F.col("end") == F.col("cancelled"), "cancelled")
        .when(F.col("end").isNotNull(), "poisoned").when(F.col("last_event") == "attempt_failed", "failed")
        .when(F.col("first_touched_at").isNotNull(), "in_progress").otherwise("pending"))
    return state.select("task_id", status.alias("status"), "attempts", "first_touched_at",
                        F.when(status == "failed", plus_seconds(F.col("last_failure"), retry_delay(F.col("attempts")))).alias("next_retry"))
