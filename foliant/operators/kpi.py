"""KPI aggregations over document metrics.

Each operator takes the (already filtered) metrics frame and optional grouping columns. Everything
that can be is one aggregation with map-side partials; quantiles use the exact bracketed operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import config
from foliant.functions import status as S
from foliant.operators.quantiles import attach, bracket_aggs, exact_quantiles, p50, p95
from foliant.session import materialize
from foliant.sources.metrics import cost_part, in_period, map_total, seconds_between, ts


def _share(cond: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, 1.0).otherwise(0.0)), F.lit(0.0))


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def quality_aggs() -> list[Column]:
    return [
        _share(F.col("processing_status") == "success").alias("overall_accuracy"),
        _share(~F.col("hitl_required")).alias("stp_rate"),
        _share(F.col("exception_type").isNotNull()).alias("exception_rate"),
    ]


def throughput_agg() -> Column:
    hours = F.greatest(seconds_between(F.min("start_time"), F.max("start_time")) / 3600, F.lit(1.0))
    any_time = F.max(F.when(F.col("total_processing_time") > 0, 1)).isNotNull()
    return F.when(any_time, F.count(F.lit(1)) / hours).otherwise(F.lit(0.0)).alias("throughput_docs_per_hour")


def sla_agg(limit: float = config.SLA_SECONDS) -> Column:
    t = F.col("total_processing_time")
    return F.coalesce(F.avg(F.when(t > 0, F.when(t <= limit, 1.0).otherwise(0.0))), F.lit(0.0)).alias("sla_adherence_rate")


def cost_aggs() -> list[Column]:
    m = F.col("cost_breakdown")
    some = m.isNotNull() & (F.size(m) > 0)
    parts = [("cost_per_document", map_total(m))] + [(f"{k}_cost_per_doc", cost_part(m, k)) for k in ("compute", "storage", "review")]
    return [_mean(F.when(some, c)).alias(n) for n, c in parts]


def rework_aggs() -> list[Column]:
    return [
        _share(F.col("processing_status") == "reprocessing").alias("reprocess_rate"),
        F.count_if(F.coalesce(F.col("exception_type") == "poison_queue", F.lit(False))).alias("poison_queue_count"),
    ]


def kpi_quality(df: DataFrame, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(*quality_aggs())


def throughput(df: DataFrame, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(throughput_agg())


def sla_adherence(df: DataFrame, limit: float = config.SLA_SECONDS, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(sla_agg(limit))


def kpi_cost(df: DataFrame, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(*cost_aggs())


def rework(df: DataFrame, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(*rework_aggs())


def latency(df: DataFrame, group_cols=(), approximate: bool = False) -> DataFrame:
    """latency_p50 and latency_p95 of the positive times; 0 where there are none."""
    g = list(group_cols)
    t = F.when(F.col("total_processing_time") > 0, F.col("total_processing_time"))
    x = df.select(*g, t.alias("t"))
    if approximate:
        q = x.groupBy(*g).agg(F.percentile_approx("t", 0.5, 10000).alias("latency_p50"),
                              F.percentile_approx("t", 0.95, 10000).alias("latency_p95"))
    else:
        q = exact_quantiles(x, "t", [p50("latency_p50"), p95("latency_p95")], g)
        if g:
            q = x.select(*g).distinct().join(q, g, "left")
    return q.select(*g, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("latency_p50", "latency_p95")])


def hitl_times(tasks: DataFrame, group_cols=()) -> DataFrame:
    """Average minutes to first review and to resolution, from the review tasks themselves."""
    return tasks.groupBy(*group_cols).agg(
        _mean(seconds_between(F.col("created_at"), F.col("first_touched_at")) / 60).alias("time_to_first_review_avg"),
        _mean(seconds_between(F.col("created_at"), F.col("resolution_time")) / 60).alias("time_to_resolution_avg"),
    )


def exception_breakdown(df: DataFrame, group_cols=()) -> DataFrame:
    return df.where(F.col("exception_type").isNotNull()).groupBy(*group_cols, "exception_type").agg(F.count(F.lit(1)).alias("count"))


def top_exceptions(df: DataFrame, n: int = 5, group_cols=()) -> DataFrame:
    """The ``n`` most frequent exceptions, earliest first on ties, as a share of all documents."""
    g = list(group_cols)
    total = df.groupBy(*g).agg(F.count(F.lit(1)).alias("__total"))
    counts = (
        df.where(F.col("exception_type").isNotNull()).groupBy(*g, "exception_type")
        .agg(F.count(F.lit(1)).alias("count"), F.min("start_time").alias("__first"))
    )
    order = [F.col("count").desc(), F.col("__first"), F.col("exception_type")]
    if g:
        rank = F.row_number().over(Window.partitionBy(*g).orderBy(*order))
        best = counts.withColumn("__r", rank).where(F.col("__r") <= n)
    else:
        best = counts.orderBy(*order).limit(n)
    names = F.create_map(*[F.lit(x) for kv in config.EXCEPTION_TEXT.items() for x in kv])
    return attach(best, total, g).select(
        *g, "exception_type", "count", (F.col("count") / F.col("__total") * 100).alias("percentage"),
        F.coalesce(F.try_element_at(names, F.col("exception_type")), F.col("exception_type")).alias("description"),
    )


def kpi_by_doc_type(df: DataFrame, group_cols=("document_type",)) -> DataFrame:
    t = F.col("total_processing_time")
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("count"),
        _share(F.col("processing_status") == "success").alias("success_rate"),
        _share(~F.col("hitl_required")).alias("stp_rate"),
        F.avg(F.when(t > 0, t)).alias("avg_processing_time"),
    )


def field_metrics_period(fm: DataFrame, start, end, n: int | None = None, order=("created_at", "metric_id")) -> DataFrame:
    """The period's field metrics; ``n`` asks for the first so many in order."""
    rows = in_period(fm, start, end, "created_at")
    return rows if n is None else rows.orderBy(*order).limit(n)


def kpi_dashboard(df: DataFrame, start, end, tasks: DataFrame | None = None, group_cols=()) -> DataFrame:
    """One row (per group) of all KPIs; an empty period gives one row of zeros.

    ``tasks`` are the period's review tasks and need the same grouping columns. The period is read twice: once for all sums
    and the brackets of the quantiles, which are kept, and once to count values inside the brackets.
    """
    g = list(group_cols)
    docs = in_period(df, start, end)
    t = F.when(F.col("total_processing_time") > 0, F.col("total_processing_time"))
    quantiles = [p50("latency_p50"), p95("latency_p95")]
    first = materialize(docs.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total_documents"), *quality_aggs(), throughput_agg(), sla_agg(), *cost_aggs(), *rework_aggs(), *bracket_aggs(t, quantiles)))
    q = exact_quantiles(docs.select(*g, t.alias("t")), "t", quantiles, g, first.select(*g, "__n", "__p"))
    out = attach(first.drop("__n", "__p"), q, g)
    if tasks is not None:
        out = attach(out, hitl_times(tasks, g), g)
    zero = [c for c in ("latency_p50", "latency_p95", "time_to_first_review_avg", "time_to_resolution_avg") if c in out.columns]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero})


def kpi_realtime(df: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The last hours' headline figures, with the three most frequent exceptions beside them."""
    end = ts(as_of, df, "start_time")
    recent = df.where(F.col("start_time").between(end - F.make_dt_interval(hours=F.lit(hours)), end))
    head = recent.agg(F.count(F.lit(1)).alias("total_documents"), *quality_aggs(), throughput_agg(), rework_aggs()[1])
    top = top_exceptions(recent, 3)
    lines = top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("exception_type").alias("e")))),
        lambda x: F.concat(x["e"], F.lit(":"), (-x["n"]).cast("string"))), ",").alias("top_exceptions"))
    return attach(head, lines, [])


def recent_metrics(docs: DataFrame, fields: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Counts and averages of the last hours; status names must be canonical."""
    def last(df):
        end = ts(as_of, df, "created_at")
        return df.where(F.col("created_at").between(end - F.make_dt_interval(hours=F.lit(hours)), end))

    d = last(docs).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.round(_mean(F.col("total_processing_time")), 2).alias("avg_processing_time"),
        F.count_if(F.col("processing_status") == "success").alias("completed"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"),
        F.count_if("hitl_required").alias("needs_review"),
    )
    f = last(fields).agg(*[F.round(_mean(F.col(c)), 4).alias(n) for c, n in (
        ("precision", "avg_precision"), ("recall", "avg_recall"), ("f1_score", "avg_f1_score"), ("accuracy", "avg_accuracy"))])
    return attach(d, f, [])


def cost_share(kpi: DataFrame, monthly_docs: int = 30_000) -> DataFrame:
    """Percent of each cost component and the monthly cost; NULL shares where the total is zero."""
    total = F.nullif(F.col("cost_per_document"), F.lit(0.0))
    return kpi.withColumns({
        **{f"{k}_pct": F.try_divide(F.col(f"{k}_cost_per_doc"), total) * 100 for k in ("compute", "storage", "review")},
        "monthly_cost": F.col("cost_per_document") * monthly_docs,
    })


def recent_activity_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("total_cost", F.coalesce(map_total(F.col("cost_breakdown")), F.lit(0.0)))


def kpi_alerts(kpi: DataFrame, queue_depth: Column | None = None, avg_time: Column | None = None) -> DataFrame:
    """One row per threshold the KPI row crosses; thresholds and texts are fixed values."""
    def pct(c):
        return F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))

    def alert(cond, level, message):
        return F.when(cond, F.struct(F.lit(level).alias("severity"), message.alias("message")))

    acc, stp, poison = F.col("overall_accuracy"), F.col("stp_rate"), F.col("poison_queue_count")
    rules = [
        alert(acc < 0.85, "critical", F.concat(F.lit("Accuracy dropped to "), pct("overall_accuracy"))),
        alert(stp < 0.7, "warning", F.concat(F.lit("STP rate is low: "), pct("stp_rate"))),
        alert(poison > 5, "warning", F.concat(F.lit("Poison queue has "), poison.cast("string"), F.lit(" documents"))),
        alert(1 - stp > 0.25, "warning", F.lit("HITL rate above 25%: investigation required")),
        alert(acc < 0.9, "warning", F.lit("Validation accuracy below 90%: quality alert")),
    ]
    if avg_time is not None:
        rules.append(alert(avg_time > 5, "warning", F.lit("Processing time above 5s: performance alert")))
    if queue_depth is not None:
        rules.append(alert(queue_depth > 100, "warning", F.lit("Queue depth above 100: capacity alert")))
    keys = [c for c in kpi.columns if c in ("period", "document_type")]
    return kpi.select(*keys, F.explode(F.filter(F.array(*rules), lambda a: a.isNotNull())).alias("a")).select(*keys, "a.*")


def kpi_trend(df: DataFrame, last_day, days: int = 7) -> DataFrame:
    """Daily accuracy and straight-through rate with the change from the day before; gaps stay as empty days."""
    spark = df.sparkSession
    end = F.lit(str(last_day)).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    first = ts(last_day, df, "start_time") - F.make_dt_interval(days=F.lit(days - 1))
    until = ts(last_day, df, "start_time") + F.make_dt_interval(days=F.lit(1))
    daily = (
        df.where((F.col("start_time") >= first) & (F.col("start_time") < until))
        .groupBy(F.to_date("start_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("documents"), *quality_aggs()[:2])
    )
    by_day = Window.orderBy("day")  # over the calendar: `days` rows
    acc = F.col("overall_accuracy")
    return calendar.join(daily, "day", "left").select(
        "day", F.coalesce("documents", F.lit(0)).alias("documents"), "overall_accuracy", "stp_rate",
        (acc - F.lag(acc).over(by_day)).alias("accuracy_change"))


def queue_trend(tasks: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Open tasks at the end of each of the last hours: entries minus exits, counted per hour."""
    end = F.date_trunc("hour", F.lit(str(as_of)).cast("timestamp"))
    h = F.make_dt_interval(hours=F.lit(1))
    moves = tasks.select(F.explode(F.array(
        F.struct(F.col("created_at").alias("ts"), F.lit(1).alias("d")),
        F.struct(F.col("resolution_time").alias("ts"), F.lit(-1).alias("d")))).alias("m")).select("m.*").where(F.col("ts").isNotNull())
    # Everything before the window folds into its first hour, so the running sum covers `hours` rows.
    start = end - F.make_dt_interval(hours=F.lit(hours - 1))
    per_hour = (
        moves.select(F.greatest(F.date_trunc("hour", F.col("ts").cast("timestamp")), start).alias("hour"), "d")
        .where(F.col("hour") <= end).groupBy("hour").agg(F.sum("d").alias("d"))
    )
    calendar = tasks.sparkSession.range(1).select(F.explode(F.sequence(start, end, h)).alias("hour"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return calendar.join(per_hour, "hour", "left").select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.sum(F.coalesce("d", F.lit(0))).over(w).alias("queue_depth"))


def with_status(kpi: DataFrame) -> DataFrame:
    return kpi.withColumns({
        "accuracy_status": S.threshold_status(F.col("overall_accuracy"), 0.9, 0.8),
        "stp_status": S.threshold_status(F.col("stp_rate"), 0.8, 0.7),
        "latency_status": S.threshold_status(F.col("latency_p95"), 10, 30, inverse=True),
    })
