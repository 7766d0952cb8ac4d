"""Task state from a stream of task events.

What decides a task's state is small whatever its number of events: its first three failures, first
completion, first cancellation, first touch and last event. Each micro-batch is reduced to that per
task with map-side partials (so a hot task sends a row per input partition), and appended to a log.
Reading merges the log the same way. Nothing depends on arrival order, and late events are folded in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import config
from foliant.operators.joins import top_per_group
from foliant.operators.queue import retry_delay
from foliant.sinks.versioned import LeveledLog
from foliant.sources.metrics import plus_seconds, ts

_AT = ("ts", "event_id")


def summarize_events(events: DataFrame) -> DataFrame:
    """Events (task_id, ts, event_id, event) to one summary row per task."""
    at = F.struct(*_AT)
    of = lambda e: F.when(F.col("event") == e, at)
    base = events.groupBy("task_id").agg(
        F.min(of("completed")).alias("completed"), F.min(of("cancel_requested")).alias("cancelled"), F.min(of("touched")).alias("touched"),
        F.max(F.struct(*_AT, "event")).alias("last"))
    return _with_failures(base, events.where(F.col("event") == "attempt_failed").select("task_id", *_AT))


def merge_summaries(log: DataFrame) -> DataFrame:
    """Summary rows of many batches to one per task."""
    base = log.groupBy("task_id").agg(F.min("completed").alias("completed"), F.min("cancelled").alias("cancelled"),
                                      F.min("touched").alias("touched"), F.max("last").alias("last"))
    return _with_failures(base, log.select("task_id", F.explode("failures").alias("f")).select("task_id", "f.*"))


def summary_log(spark: SparkSession, path: str) -> LeveledLog:
    """The log of summaries, merged level by level as batches come, and when read."""
    return LeveledLog(spark, path, merge_summaries)


def _with_failures(base: DataFrame, failures: DataFrame) -> DataFrame:
    first = top_per_group(failures, ["task_id"], list(_AT), config.MAX_ATTEMPTS)
    lists = first.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(*_AT))).alias("failures"))  # at most three
    none = F.filter(F.array(F.struct(*[F.col(f"last.{c}").alias(c) for c in _AT])), lambda x: F.lit(False))
    return base.join(lists, "task_id", "left").withColumn("failures", F.coalesce("failures", none))


def task_state(summaries: DataFrame) -> DataFrame:
    """Current state per task; the same columns as the batch fold."""
    poisoned = F.get("failures", F.lit(config.MAX_ATTEMPTS - 1))
    s = summaries.withColumn("poisoned", poisoned).withColumn("end", F.least("completed", "cancelled", "poisoned"))
    live = lambda c: F.col("end").isNull() | (c <= F.col("end"))
    s = s.withColumns({"fails": F.filter("failures", live), "touch": F.when(live(F.col("touched")), F.col("touched.ts"))})
    status = (
        F.when(F.col("end") == F.col("completed"), "completed").when(F.col("end") == F.col("cancelled"), "cancelled")
        .when(F.col("end").isNotNull(), "poisoned").when(F.col("last.event") == "attempt_failed", "failed")
        .when(F.col("touch").isNotNull(), "in_progress").otherwise("pending"))
    n = F.size("fails")
    return s.select("task_id", status.alias("status"), n.alias("attempts"), F.col("touch").alias("first_touched_at"),
                    F.when(status == "failed", plus_seconds(F.element_at("fails", -1)["ts"], retry_delay(n))).alias("next_retry"))


def due_now(state: DataFrame, as_of, timeout: int = config.TASK_TIMEOUT_SECONDS) -> DataFrame:
    """Marks what a timer would do at a moment: retries that are due and touched tasks that have timed out."""
    now = ts(as_of, state, "next_retry")
    late = (F.col("status") == "in_progress") & (plus_seconds(F.col("first_touched_at"), F.lit(timeout)) < now)
    return state.withColumns({"retry_due": (F.col("status") == "failed") & (F.col("next_retry") <= now), "timed_out": late})


def timers(state: DataFrame, as_of, timeout: int = config.TASK_TIMEOUT_SECONDS) -> DataFrame:
    """What is due at a moment, as rows: (task_id, action, due_at) of retries and timeouts.

    Time passes without events, so timers are asked at a moment over the merged state, by a job on a clock.
    """
    s = due_now(state, as_of, timeout)
    retry = F.when(F.col("retry_due"), F.struct(F.lit("retry").alias("action"), F.col("next_retry").alias("due_at")))
    late = F.when(F.col("timed_out"), F.struct(F.lit("timeout").alias("action"), plus_seconds(F.col("first_touched_at"), F.lit(timeout)).alias("due_at")))
    return s.select("task_id", F.explode(F.filter(F.array(retry, late), lambda x: x.isNotNull())).alias("t")).select("task_id", "t.*")
