"""Human review: deadlines, assignment, touch and completion times, feedback, training data, summaries."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import config
from foliant.operators import filling
from foliant.operators.queue import rank
from foliant.operators.ranking import row_numbers
from foliant.session import materialize, written
from foliant.sources.metrics import seconds_between, ts

DONE = "completed"
PLACES_PER_CHUNK = 10_000
#: Tasks of a chunk that is filled in order, and the least number of them for each reviewer: a chunk hands on the workloads of
#: all reviewers, so that what chunks hand on grows with the tasks, not with tasks times reviewers.
TASKS_PER_CHUNK, TASKS_PER_REVIEWER = 100_000, 2


def sla_deadline(created: Column, priority: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for kv in config.SLA_HOURS.items() for x in kv])
    return created + F.make_dt_interval(hours=F.coalesce(F.try_element_at(hours, priority), F.lit(config.SLA_DEFAULT_HOURS)))


def assign_reviewers(tasks: DataFrame, reviewers: DataFrame, chunk_tasks: int | None = None) -> DataFrame:
    """Each task to the free specialist with the least work at that moment (first on ties), oldest task first.

    Document types that share a reviewer, directly or over others, form a family. In a family of one type, serial
    greedy filling is the same as listing every reviewer's future places by workload level: the k-th task takes the k-th
    place; tasks and places are numbered over range partitions, so a type of any size is spread. In a family of several types each
    assignment changes what the other types see; its tasks are filled in chunks side by side until the workloads handed from
    chunk to chunk agree, which gives the serial result. A family of such a kind runs jobs when this is called.
    """
    families = _families(reviewers)
    shared = sorted(t for t, family in families.items() if sum(f == family for f in families.values()) > 1)
    untyped = tasks.where("document_type is null").select("task_id", "document_type", F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("long").alias("workload_before"),
                                                         F.lit(None).cast("long").alias("k"))
    tasks = tasks.where("document_type is not null")
    if not shared:
        return _fill_by_level(tasks, reviewers).unionByName(untyped)
    if chunk_tasks is None:
        chunk_tasks = max(TASKS_PER_CHUNK, TASKS_PER_REVIEWER * reviewers.where("is_available").count())
    in_shared = F.col("document_type").isin(*shared)
    return _fill_by_level(tasks.where(~in_shared), reviewers).unionByName(_fill_in_order(tasks.where(in_shared), reviewers, families, chunk_tasks)).unionByName(untyped)


def _families(reviewers: DataFrame) -> dict[str, str]:
    """The family of each type: types are configuration, so their distinct combinations are few."""
    sets = reviewers.where("is_available").select(F.array_sort("specializations").alias("s")).distinct().collect()
    family: dict[str, str] = {}
    for types in (r["s"] for r in sets if r["s"]):
        old = {family.get(t, t) for t in types}
        low = min(old)
        family.update({t: low for t in types})
        family.update({t: low for t, f in family.items() if f in old})
    return family


def _fill_in_order(tasks: DataFrame, reviewers: DataFrame, families: dict[str, str], chunk_tasks: int) -> DataFrame:
    """Serial filling per family, in chunks of the tasks' order that are filled side by side.

    Every chunk is filled from guessed workloads. A pass then hands on where each chunk ended (``filling.next_starts``) and fills those chunks
    anew whose start was another. It is over when no start changes: the first chunk's start is right, so all are. Each pass
    makes one more chunk right at least; where filling levels workloads out it is a few passes for any number of chunks.
    """
    sizes = Counter(families.values())
    shared = [t for t, f in families.items() if sizes[f] > 1]
    family = F.create_map(*[F.lit(x) for t in shared for x in (t, families[t])])
    code = {t: i for i, t in enumerate(sorted(families))}
    codes = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    staff = (
        reviewers.where(F.col("is_available") & F.get("specializations", F.lit(0)).isin(shared)).withColumn("family", family[F.get("specializations", F.lit(0))])
        .groupBy("family").agg(F.sort_array(F.collect_list(F.struct(  # people, however many tasks
            F.col("ord").cast("long").alias("ord"), F.col("user_id").alias("id"), F.coalesce(F.col("current_workload"), F.lit(0)).cast("long").alias("load"),
            F.transform("specializations", lambda t: codes[t]).alias("types")))).alias("s"))
        .select("family", F.col("s.id").alias("ids"), F.col("s.load").alias("first"),
                F.flatten("s.types").alias("kinds"), F.transform("s.types", F.size).alias("sizes")))
    queue = row_numbers(tasks.select(family[F.col("document_type")].alias("family"), "task_id", "document_type", "created_at"), ["family"], ["created_at", "task_id"], "k")
    one = F.struct("k", "task_id", "document_type", codes[F.col("document_type")].alias("code"))
    chunks = (
        queue.groupBy("family", F.floor((F.col("k") - 1) / chunk_tasks).alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("t"))  # chunk_tasks at most
        .select("family", "chunk", F.col("t.code").alias("codes"), F.transform("t", lambda x: x.dropFields("code")).alias("tasks")).join(staff, "family"))
    chunks = written(chunks, "assignment-chunks")

    key, end = ["family", "chunk"], filling.end("codes", "kinds", "sizes", "start").alias("end")
    plain = chunks.select(*key, "codes", "kinds", "sizes")
    once = [F.when(F.col("chunk") == 0, F.col(c)).alias(c) for c in ("kinds", "sizes")]  # the same in all chunks of a family
    starts = chunks.select(*key, F.col("first").alias("start"))
    ends = written(plain.join(starts, key).select(*key, *once, "start", end), "assignment-ends")
    while True:
        after = written(ends.groupBy("family").applyInPandas(filling.hand_on, ends.schema.simpleString()[7:-1] + ", moved boolean"), "assignment-starts")
        if not after.where("moved").count():
            break
        again = plain.join(after.where("moved").select(*key, "start"), key).select(*key, *once, "start", end)
        ends = written(after.where("not moved").drop("moved").unionByName(again), "assignment-ends")

    filled = chunks.join(ends.select(*key, "start"), key).withColumn("got", filling.places("codes", "kinds", "sizes", "start"))
    rows = filled.select("ids", F.explode(F.arrays_zip("tasks", "got.who", "got.load")).alias("x"))
    return rows.select(
        "x.tasks.task_id", "x.tasks.document_type", F.when(F.col("x.who") >= 0, F.get("ids", F.col("x.who"))).alias("assigned_to"),
        F.when(F.col("x.who") >= 0, F.col("x.load")).alias("workload_before"), "x.tasks.k")


def _fill_by_level(tasks: DataFrame, reviewers: DataFrame) -> DataFrame:
    """The k-th task of a type takes the k-th place of its reviewers; for types that share no reviewer."""
    free = reviewers.where("is_available").select("user_id", "ord", "current_workload", F.explode("specializations").alias("document_type"))
    need = tasks.groupBy("document_type").agg(F.count(F.lit(1)).alias("tasks"))
    # The level the filling reaches: the least over the m least loaded reviewers of (tasks + their work) / m.
    by_load = free.groupBy("document_type", "current_workload").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("document_type").orderBy("current_workload")
    levels = (
        by_load.withColumns({"m": F.sum("n").over(so_far), "w": F.sum(F.col("n") * F.col("current_workload")).over(so_far)})
        .join(need, "document_type").groupBy("document_type").agg(F.min(F.ceil((F.col("tasks") + F.col("w")) / F.col("m"))).alias("level")))
    # Places of a reviewer are spelled out in chunks that are dealt out before they become rows.
    chunk = F.lit(PLACES_PER_CHUNK).cast("long")
    last = F.col("level") - 1
    chunks = (
        free.join(levels, "document_type").where(F.col("current_workload") < F.col("level"))
        .select("document_type", "user_id", "ord", "level", F.explode(F.sequence(F.col("current_workload"), last, chunk)).alias("from"))
        .repartition("document_type", "user_id", "from"))
    places = chunks.select("document_type", "user_id", "ord", F.explode(F.sequence(F.col("from"), F.least(last, F.col("from") + chunk - 1))).alias("level"))
    slots = row_numbers(places, ["document_type"], ["level", "ord"], "k").select("document_type", "k", "user_id", "level")
    queue = row_numbers(tasks.select("task_id", "document_type", "created_at"), ["document_type"], ["created_at", "task_id"], "k")
    return queue.join(slots, ["document_type", "k"], "left").select(
        "task_id", "document_type", F.col("user_id").alias("assigned_to"), F.col("level").alias("workload_before"), "k")


def first_touch(tasks: DataFrame, touches: DataFrame) -> DataFrame:
    """Touches by the assignee, as (task_id, reviewer_id, ts) events: first time, age in minutes and status.

    An earlier touch that the task has stays, and a finished task keeps its status.
    """
    first = touches.groupBy("task_id", "reviewer_id").agg(F.min("ts").alias("__ts"))
    mine = tasks.join(first.withColumnRenamed("reviewer_id", "assigned_to"), ["task_id", "assigned_to"])
    mine = mine.withColumn("first_touched_at", F.least("first_touched_at", "__ts")).drop("__ts")
    waiting = F.col("status").isin("pending", "assigned")
    return mine.withColumns({"age_to_first_touch": seconds_between(F.col("created_at"), F.col("first_touched_at")) / 60,
                             "status": F.when(waiting, "in_progress").otherwise(F.col("status"))})


def complete_tasks(tasks: DataFrame, completions: DataFrame) -> DataFrame:
    """Completion by the assignee: time and age in minutes; (task_id, reviewer_id, ts) events."""
    done = completions.groupBy("task_id", "reviewer_id").agg(F.min("ts").alias("resolution_time"))
    mine = tasks.drop("resolution_time").join(done.withColumnRenamed("reviewer_id", "assigned_to"), ["task_id", "assigned_to"])
    return mine.withColumns({"age_to_resolve": seconds_between(F.col("created_at"), F.col("resolution_time")) / 60, "status": F.lit(DONE)})


def last_corrections(corrections: DataFrame) -> DataFrame:
    """One correction per task and field, the last one; map-side partials keep repeats off the shuffle."""
    cols = [c for c in corrections.columns if c not in ("task_id", "field_name", "pos")]
    return corrections.groupBy("task_id", "field_name").agg(F.max_by(F.struct(*cols), "pos").alias("c")).select("task_id", "field_name", "c.*")


def task_fields(tasks: DataFrame, *keep: str) -> DataFrame:
    return tasks.select("task_id", *keep, F.explode("extracted_fields").alias("f")).select(
        "task_id", *keep, F.col("f.field_name").alias("field_name"), F.col("f.value").alias("original_value"),
        F.col("f.confidence").alias("confidence"), F.col("f.extraction_method").alias("extraction_method"))


def collect_feedback(tasks: DataFrame, corrections: DataFrame) -> DataFrame:
    """A feedback row per corrected field whose value changed, with default reason and rating."""
    fields = task_fields(tasks, "document_type", "assigned_to")
    j = last_corrections(corrections).join(fields, ["task_id", "field_name"]).where(~F.col("original_value").eqNullSafe(F.col("corrected_value")))
    return j.select("task_id", "field_name", "document_type", "original_value", "corrected_value", F.col("assigned_to").alias("reviewer_id"),
                    F.coalesce("reason", F.lit("Manual correction")).alias("correction_reason"), F.coalesce("rating", F.lit(5)).alias("confidence_rating"),
                    "timestamp", "confidence", "extraction_method")


def apply_corrections(tasks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Long fields with the corrected value where there is one."""
    c = last_corrections(corrections).select("task_id", "field_name", "corrected_value")
    return task_fields(tasks).join(c, ["task_id", "field_name"], "left").select(
        "task_id", "field_name", F.coalesce("corrected_value", "original_value").alias("value"))


def reviewer_stats(tasks: DataFrame) -> DataFrame:
    open_ = ~F.col("status").isin(DONE, "approved")
    return tasks.where(F.col("assigned_to").isNotNull()).groupBy("assigned_to").agg(
        F.count_if(open_).alias("current_workload"), F.count_if(~open_).alias("completed_tasks"),
        F.avg(seconds_between(F.col("created_at"), F.col("resolution_time")) / 60).alias("avg_resolution_minutes"))


def training_records(tasks: DataFrame, feedback: DataFrame) -> DataFrame:
    """One record per finished task: its corrections, confidence deltas and extraction methods.

    Feedback holds one row per task and field, so a record's lists are no longer than the schema.
    """
    delta = F.col("confidence_rating") - 5 * F.col("confidence")
    entry = F.struct("field_name", "original_value", "corrected_value", "correction_reason", F.col("confidence_rating").alias("reviewer_confidence"),
                     delta.alias("confidence_delta"), "extraction_method", "timestamp")
    lists = feedback.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("field_corrections"))
    done = tasks.where(F.col("status").isin(DONE, "approved"))
    return done.join(lists, "task_id", "left").select(
        "task_id", "document_id", "document_type", F.col("resolution_time").alias("created_at"),
        (seconds_between(F.col("created_at"), F.col("resolution_time")) / 60).alias("resolution_time_minutes"),
        F.col("assigned_to").alias("reviewer_id"), F.coalesce("field_corrections", F.array()).alias("field_corrections"),
        F.col("validation_errors").alias("validation_failures"))


def newest_records(tasks: DataFrame, corrections: DataFrame, document_type: str | None = None, limit: int = 100) -> DataFrame:
    """The records of the newest finished tasks: what is newest depends on tasks alone, so only theirs meet any corrections."""
    done = tasks.where(F.col("status").isin(DONE, "approved"))
    done = done if document_type is None else done.where(F.col("document_type") == document_type)
    newest = materialize(done.orderBy(F.col("resolution_time").desc(), "task_id").limit(limit))
    return training_records(newest, collect_feedback(newest, corrections.join(newest.select("task_id"), "task_id", "left_semi")))


def get_training_data(tasks: DataFrame, corrections: DataFrame, document_type: str | None = None, limit: int = 100) -> DataFrame:
    return newest_records(tasks, corrections, document_type, limit).orderBy(F.col("created_at").desc(), "task_id")


def training_summary(tasks: DataFrame, corrections: DataFrame, newest: int = 1000, top: int = 10) -> DataFrame:
    """Over the newest records: (kind, name, count) of samples, corrections, types and most corrected fields."""
    recent = newest_records(tasks, corrections, None, newest).select("document_type", F.transform("field_corrections", lambda c: c["field_name"]).alias("names"))
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("name"), F.col("count"))
    totals = recent.agg(F.count(F.lit(1)).alias("s"), F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("c")).select(
        F.explode(F.array(F.struct(F.lit("samples").alias("name"), F.col("s").alias("count")), F.struct(F.lit("corrections").alias("name"), F.col("c").alias("count")))).alias("x")).select("x.*")
    types = recent.groupBy(F.col("document_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    fields = (recent.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), "name").limit(top))
    return line(totals, "total").unionByName(line(types, "document_type")).unionByName(line(fields, "field"))


def _overdue(tasks: DataFrame, as_of) -> Column:
    return F.col("sla_deadline") < ts(as_of, tasks, "sla_deadline")


def sla_statistics(tasks: DataFrame, as_of) -> DataFrame:
    touched = (F.col("status") == DONE) & F.col("first_touched_at").isNotNull()
    minutes = lambda c: seconds_between(F.col("created_at"), F.col(c)) / 60
    zero = F.lit(0.0)
    return tasks.agg(
        F.coalesce(F.avg(F.when(touched, minutes("first_touched_at"))), zero).alias("avg_age_to_first_touch"),
        F.coalesce(F.avg(F.when(touched, minutes("resolution_time"))), zero).alias("avg_age_to_resolve"),
        F.count_if(touched).alias("total_completed_tasks"),
        F.count_if(_overdue(tasks, as_of) & (F.col("status") != DONE)).alias("current_sla_violations"))


def review_queue_status(tasks: DataFrame, as_of) -> DataFrame:
    """One row over the active tasks: counts by status and priority, violations and mean age."""
    active = tasks.where(F.col("status").isin("pending", "assigned", "in_progress"))
    n = F.count(F.lit(1))
    late = F.count_if(_overdue(tasks, as_of))
    age = seconds_between(F.col("created_at"), ts(as_of, tasks, "created_at")) / 60
    return active.agg(
        n.alias("total_active_tasks"), *[F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in ("pending", "assigned", "in_progress")],
        late.alias("sla_violations"), F.coalesce(F.avg(age), F.lit(0.0)).alias("avg_queue_age_minutes"),
        *[F.count_if(F.col("priority") == p).alias(f"priority_{p}") for p in (1, 2, 3)],
        F.coalesce(F.try_divide(late, n) * 100, F.lit(0.0)).alias("violation_rate"))


def reviewer_block(tasks: DataFrame, reviewers: DataFrame) -> DataFrame:
    """The reviewers' part of the queue status: a row per reviewer with open and completed tasks besides what the roster says.

    Tasks are counted per reviewer with map-side sums before they meet the roster; reviewers without tasks have zeros.
    """
    counts = tasks.where(F.col("assigned_to").isNotNull()).groupBy(F.col("assigned_to").alias("user_id")).agg(
        F.count_if(F.col("status").isin("assigned", "in_progress")).alias("open_tasks"), F.count_if(F.col("status") == DONE).alias("completed_tasks"))
    rows = reviewers.join(counts, "user_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("open_tasks", "completed_tasks")})
    return rows.select("user_id", "name", (F.col("current_workload") + F.col("open_tasks")).alias("current_workload"), "completed_tasks", "is_available", "specializations")


def escalate_overdue(tasks: DataFrame, as_of, every: int = config.ESCALATION_SECONDS) -> DataFrame:
    """Overdue open tasks gain one priority step per check since the deadline, up to the highest."""
    late = _overdue(tasks, as_of) & (F.col("status") != DONE)
    over = seconds_between(F.col("sla_deadline"), ts(as_of, tasks, "sla_deadline"))
    ticks = F.least(F.floor(over / every) + 1, F.lit(config.MAX_PRIORITY)).cast("int")
    return tasks.withColumn("priority", F.when(late, F.greatest(F.col("priority"), F.least(F.lit(config.MAX_PRIORITY), F.col("priority") + ticks))).otherwise(F.col("priority")))


def pending_tasks(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """Most critical first, oldest first within a priority name."""
    return tasks.where(F.col("status") == "pending").orderBy(rank(F.col("priority"), config.REVIEW_RANK), "created_at", "task_id").limit(limit)


def priority_counts(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") == "pending").groupBy("priority").agg(F.count(F.lit(1)).alias("count"))


def daily_summary(tasks: DataFrame, day) -> DataFrame:
    pending = F.col("status") == "pending"
    today = (F.col("status") == DONE) & (F.to_date("resolution_time") == F.lit(str(day)).cast("date"))
    return tasks.agg(
        F.count_if(pending).alias("pending_reviews"), F.count_if(today).alias("completed_today"),
        F.count_if(pending & (F.col("priority") == "critical")).alias("critical_priority"),
        F.count_if(pending & (F.col("priority") == "high")).alias("high_priority"))


def submit_review(tasks: DataFrame, forms: DataFrame) -> DataFrame:
    """Review forms (task_id, fields map, ts) to completed tasks: decision, notes and the corrected fields."""
    f = F.col("fields")
    reserved = ("reviewer_notes", "review_decision")
    out = forms.select(
        "task_id", F.coalesce(F.try_element_at(f, F.lit("review_decision")), F.lit("approved")).alias("review_decision"),
        F.coalesce(F.try_element_at(f, F.lit("reviewer_notes")), F.lit("")).alias("reviewer_notes"),
        F.map_filter(f, lambda k, v: ~k.isin(*reserved)).alias("corrected_fields"), F.col("ts").alias("completed_at"))
    return tasks.drop("status").join(out, "task_id").withColumn("status", F.lit(DONE))
