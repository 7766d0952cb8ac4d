"""Rolling KPIs: each micro-batch leaves partials per tumbling window, which are sums and are merged when read.

Nothing waits for a watermark and nothing is too late: a row that comes days after its time adds a partial to its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sinks.versioned import LeveledLog
from foliant.sources.metrics import seconds_between, ts
from foliant.streaming.runner import latest_per


def window_partials(metrics: DataFrame, width: str = "5 minutes") -> DataFrame:
    """One row of partial sums and a latency sketch per tumbling window of a micro-batch.

    A sliding day would copy each row into every step it belongs to; partials cost one row per
    window and batch, and a day of them is merged in one small aggregation.
    """
    t, s = F.col("total_processing_time"), F.col("processing_status")
    return (
        metrics.groupBy(F.window("start_time", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(s == "success").alias("successes"), F.count_if("hitl_required").alias("reviews"),
            F.count_if(F.col("exception_type").isNotNull()).alias("exceptions"), F.count_if(s == "reprocessing").alias("reprocessed"),
            F.count_if(F.coalesce(F.col("exception_type") == "poison_queue", F.lit(False))).alias("poisoned"),
            F.sum("total_processing_time").alias("time_sum"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"),
            F.kll_sketch_agg_double(F.when(t > 0, t)).alias("latency_sketch"))
        .select(F.col("w.start").alias("window_start"), "documents", "successes", "reviews", "exceptions", "reprocessed", "poisoned", "time_sum",
                "first_start", "last_start", "latency_sketch")
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """The partials of all batches as one row per window: what a log is compacted to."""
    sums = ("documents", "successes", "reviews", "exceptions", "reprocessed", "poisoned", "time_sum")
    return partials.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in sums], F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"),
                                                F.kll_merge_agg_double("latency_sketch").alias("latency_sketch"))


def partials_log(spark: SparkSession, path: str) -> LeveledLog:
    """The log that a job of rolling KPIs writes to, with ``log.writer(window_partials)``, and that readers merge."""
    return LeveledLog(spark, path, merge_partials)


def running_log(spark: SparkSession, path: str, keys: list[str]) -> LeveledLog:
    """The log of an output in update mode: a row per key and batch, of which the last one counts."""
    return LeveledLog(spark, path, lambda df: latest_per(df, keys, keep_batch=True))


def rolling_kpis(partials: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The last hours' KPIs from the partials."""
    end = ts(as_of, partials, "window_start")
    p = partials.where((F.col("window_start") >= end - F.make_dt_interval(hours=F.lit(hours))) & (F.col("window_start") < end))
    n = F.sum("documents")
    share = lambda c: F.coalesce(F.try_divide(F.sum(c), n), F.lit(0.0))
    hours_span = F.greatest(seconds_between(F.min("first_start"), F.max("last_start")) / 3600, F.lit(1.0))
    sketch = F.kll_merge_agg_double("latency_sketch")
    return p.agg(
        F.coalesce(n, F.lit(0)).alias("total_documents"), share("successes").alias("overall_accuracy"),
        (1 - F.coalesce(F.try_divide(F.sum("reviews"), n), F.lit(1.0))).alias("stp_rate"), share("exceptions").alias("exception_rate"),
        share("reprocessed").alias("reprocess_rate"), F.coalesce(F.sum("poisoned"), F.lit(0)).alias("poison_queue_count"),
        F.coalesce(n / hours_span, F.lit(0.0)).alias("throughput_docs_per_hour"), share("time_sum").alias("avg_processing_time"), sketch.alias("s"),
    ).select("*", F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", F.lit(0.5))).alias("latency_p50_approx"),
             F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", F.lit(0.95))).alias("latency_p95_approx")).drop("s")


def stream_running_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts and averages per key (update or complete mode); one state row per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.avg("confidence").alias("average_confidence"),
                                 F.avg("processing_time").alias("average_processing_time"))
