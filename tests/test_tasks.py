"""Queue, review and streaming behaviour on small frames, against plain Python where the rules are serial."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from foliant.operators import filling
from foliant.operators import queue as K
from foliant.operators import review as V
from foliant.streaming import documents as D
from foliant.streaming import kpis as SK
from foliant.streaming import tasks as ST
from foliant.streaming.runner import batch_writer, log_writer, rocksdb_state, run_available
from foliant.streaming.timers import Task, TimerSpec, clock, task_timers

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_retry_sequence(spark):
    df = spark.createDataFrame([("t", n, T0) for n in range(3)], "task_id string, attempts int, failed_at timestamp")
    rows = sorted(K.retry_schedule(df).collect(), key=lambda r: r["attempts"])
    assert [(r["status"], r["next_retry"]) for r in rows] == [("failed", at(1)), ("failed", at(2)), ("poisoned", None)]


def python_fold(events):
    out = {}
    for task in {e[0] for e in events}:
        state = {"status": "pending", "attempts": 0, "touched": None, "retry": None}
        for _, ts, _, kind in sorted((e for e in events if e[0] == task), key=lambda e: (e[1], e[2])):
            state["retry"] = None
            state["last"] = kind
            if kind == "attempt_failed":
                state["attempts"] += 1
                if state["attempts"] == 3:
                    state["status"] = "poisoned"
                    break
                state["retry"] = ts + dt.timedelta(seconds=60 * 2 ** (state["attempts"] - 1))
            elif kind == "touched" and state["touched"] is None:
                state["touched"] = ts
            elif kind in ("completed", "cancel_requested"):
                state["status"] = "completed" if kind == "completed" else "cancelled"
                break
        if state["status"] == "pending":
            state["status"] = "failed" if state["last"] == "attempt_failed" else "in_progress" if state["touched"] else "pending"
        if state["status"] != "failed":
            state["retry"] = None
        out[task] = (state["status"], state["attempts"], state["touched"], state["retry"])
    return out


def task_events(n=600):
    rng = random.Random(3)
    kinds = ["attempt_failed", "touched", "started", "attempt_failed", "completed", "cancel_requested", "started"]
    # One task in three events is the same one.
    return [(f"t{0 if rng.random() < 0.33 else rng.randrange(120)}", at(rng.randrange(500)), i, rng.choice(kinds)) for i in range(n)]


EV = "task_id string, ts timestamp, event_id long, event string"


def as_dict(df):
    return {r["task_id"]: (r["status"], r["attempts"], r["first_touched_at"], r["next_retry"]) for r in df.collect()}


def test_fold_matches_python(spark):
    events = task_events()
    assert as_dict(K.fold_task_events(spark.createDataFrame(events, EV))) == python_fold(events)


def test_summaries_merge_in_any_order(spark):
    events = task_events()
    parts = [events[i::4] for i in range(4)]
    log = None
    for p in reversed(parts):
        s = ST.summarize_events(spark.createDataFrame(p, EV))
        log = s if log is None else log.unionByName(s)
    assert as_dict(ST.task_state(ST.merge_summaries(log))) == python_fold(events)


def test_task_stream_over_several_runs(spark, tmp_path):
    events = task_events()
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i in range(2):
        spark.createDataFrame(events[i::2], EV).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EV).option("maxFilesPerTrigger", 2).parquet(src)
        run_available(stream, ST.summary_log(spark, out).writer(ST.summarize_events), ckpt)
    assert as_dict(ST.task_state(ST.summary_log(spark, out).read())) == python_fold(events)


def test_compacted_log_reads_the_same(spark, tmp_path):
    events = task_events()
    log = ST.summary_log(spark, str(tmp_path))
    log.fan = 3
    for i in range(7):
        log.append(ST.summarize_events(spark.createDataFrame(events[i::7], EV)), i)
    assert len(log.table.version().entries) == 3  # two of the second level and the seventh batch
    assert as_dict(ST.task_state(log.read())) == python_fold(events)


def python_actions(events, now, spec):
    """What is due at a moment by events up to it, as (task, action, time, priority); ``events`` have a priority."""
    out = set()
    for task in {e[0] for e in events}:
        t = Task()
        for _, ts, i, kind, p in (e for e in events if e[0] == task):
            t.add(int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)), i, kind, p)
        for action, us, p in t.actions(spec):
            when = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
            if when <= now:
                out.add((task, action, when, p))
    return out


def test_timers_fire_without_events(spark, tmp_path):
    """Retries, timeouts, poison and escalations at three moments, of which the last two bring no events."""
    rng = random.Random(8)
    kinds = ["attempt_failed", "attempt_failed", "touched", "started", "completed", "cancel_requested"]
    events = [(f"t{rng.randrange(60)}", at(rng.randrange(300)), i, rng.choice(kinds), 1 + i % 3) for i in range(160)]
    spec = TimerSpec(retention=3600)
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "task_id string, ts timestamp, event_id long, event string, priority int"
    moments = [max(e[1] for e in events), at(400), at(60 * 80)]
    seen: set = set()
    for i, now in enumerate(moments):
        (spark.createDataFrame(events, schema) if i == 0 else clock(spark, now)).coalesce(1).write.mode("append").parquet(src)
        with rocksdb_state(spark):
            run_available(task_timers(spark.readStream.schema(schema).parquet(src), spec), batch_writer(f"{out}/{i}"), ckpt)
        new = {(r["task_id"], r["action"], r["due_at"], r["priority"]) for r in spark.read.parquet(f"{out}/{i}").collect()}
        assert not new & seen
        seen |= new
        assert seen == python_actions(events, now, spec), i
    assert {a for _, a, _, _ in seen} == {"retry", "timeout", "poisoned", "escalation"}
    # By the last moment all tasks that have ended are out of the state.
    ended = {e[0] for e in events if e[3] in ("completed", "cancel_requested")} | {t for t, a, _, _ in seen if a == "poisoned"}
    left = {r["key"]["task_id"] for r in spark.read.format("statestore").option("stateVarName", "task").load(ckpt).collect()}
    assert left == {e[0] for e in events} - ended


def test_due_now(spark):
    s = spark.createDataFrame([("a", "failed", at(0), None), ("b", "failed", at(9), None), ("c", "in_progress", None, at(0)), ("d", "in_progress", None, at(50))],
                              "task_id string, status string, next_retry timestamp, first_touched_at timestamp")
    got = {r["task_id"]: (r["retry_due"], r["timed_out"]) for r in ST.due_now(s, at(5)).collect()}
    assert got["a"] == (True, False) and got["b"] == (False, False)
    late = {r["task_id"]: r["timed_out"] for r in ST.due_now(s, at(70)).collect()}
    assert late["c"] and not late["d"]


def test_names_once_over_several_runs(spark, tmp_path):
    """Also names of files that come late; and a batch reads nothing of what earlier ones wrote."""
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i, names in enumerate((["a.pdf", "b.pdf", "a.pdf"], ["b.pdf", "c.pdf"], ["old.pdf"], ["d.pdf", "old.pdf"])):
        time = T0 - dt.timedelta(days=900) if i == 2 else T0
        spark.createDataFrame([(n, time) for n in names], "path string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        with rocksdb_state(spark):
            run_available(D.once(spark.readStream.schema("path string, ts timestamp").parquet(src), "path"), batch_writer(out), ckpt)
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["a.pdf", "b.pdf", "c.pdf", "d.pdf", "old.pdf"]
    plans = spark.readStream.schema("path string, ts timestamp").parquet(src)
    assert "batch=" not in D.once(plans, "path")._jdf.queryExecution().toString()


def test_rerun_of_a_batch_overwrites_it(spark, tmp_path):
    write = batch_writer(str(tmp_path))
    for _ in range(2):
        write(spark.range(3), 0)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_stream_kpis_match_batch(spark, tmp_path):
    rows = [(at(i * 7), float(i % 9), "success" if i % 3 else "failed", i % 4 == 0, "poison_queue" if i % 10 == 0 else None) for i in range(300)]
    schema = "start_time timestamp, total_processing_time double, processing_status string, hitl_required boolean, exception_type string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(src)
    log = SK.partials_log(spark, out)
    log.fan = 2
    run_available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), log.writer(SK.window_partials))
    assert len(log.table.version().entries) == 2  # three batches, of which two are merged
    r = SK.rolling_kpis(log.read(), at(24 * 60), 24).first()
    inside = [x for x in rows if at(0) <= x[0] < at(24 * 60)]
    assert r["total_documents"] == len(inside)
    assert abs(r["overall_accuracy"] - sum(x[2] == "success" for x in inside) / len(inside)) < 1e-9
    assert r["poison_queue_count"] == sum(x[4] is not None for x in inside)
    assert 7.0 <= r["latency_p95_approx"] <= 8.0


def test_running_stats_log(spark, tmp_path):
    log = SK.running_log(spark, str(tmp_path / "out"), ["document_type"])
    log.fan = 2
    for i in range(5):
        frame = spark.createDataFrame([("a", i), ("bcdef"[i], i)], "document_type string, documents int")
        log_writer(log)(frame, i)
    assert {r["document_type"]: r["documents"] for r in log.read().collect()} == {"a": 4, "b": 0, "c": 1, "d": 2, "e": 3, "f": 4}


def serial_assignment(tasks, reviewers):
    load = {r[0]: r[2] for r in reviewers}
    out = {}
    for task, kind, _ in sorted(tasks, key=lambda t: (t[2], t[0])):
        fit = [r for r in reviewers if kind in r[3] and r[4]]
        if fit:
            best = min(fit, key=lambda r: (load[r[0]], r[1]))[0]
            load[best] += 1
            out[task] = best
        else:
            out[task] = None
    return out


def test_assignment_equals_serial_filling(spark):
    rng = random.Random(1)
    kinds = ["invoice", "receipt", "contract"]
    reviewers = [(f"r{i}", i, rng.randrange(6), [kinds[i % 2]], i % 5 != 0) for i in range(11)]
    tasks = [(f"t{i:03}", kinds[0] if rng.random() < 0.6 else rng.choice(kinds), at(rng.randrange(100))) for i in range(200)]
    got = V.assign_reviewers(spark.createDataFrame(tasks, "task_id string, document_type string, created_at timestamp"),
                             spark.createDataFrame(reviewers, "user_id string, ord long, current_workload long, specializations array<string>, is_available boolean"))
    assert {r["task_id"]: r["assigned_to"] for r in got.collect()} == serial_assignment(tasks, reviewers)


def test_assignment_with_shared_reviewers(spark):
    rng = random.Random(4)
    pairs = [["invoice", "receipt"], ["receipt"], ["contract", "form"], ["invoice"], ["memo"]]
    reviewers = [(f"r{i}", i, rng.randrange(4), pairs[i % 5], i % 6 != 0) for i in range(12)]
    tasks = [(f"t{i:03}", rng.choice(["invoice", "receipt", "contract", "form", "memo", "other", None]), at(rng.randrange(100))) for i in range(300)]
    got = V.assign_reviewers(spark.createDataFrame(tasks, "task_id string, document_type string, created_at timestamp"),
                             spark.createDataFrame(reviewers, "user_id string, ord long, current_workload long, specializations array<string>, is_available boolean"))
    assert {r["task_id"]: r["assigned_to"] for r in got.collect()} == serial_assignment(tasks, reviewers)


@pytest.mark.parametrize("chunk", [40])
def test_shared_reviewers_in_chunks(spark, chunk):
    """Rates that level out, a type that outruns its reviewers, a second family, unknown and missing types, repeated times."""
    rng = random.Random(chunk)
    pairs = [["invoice", "receipt"], ["receipt", "memo"], ["contract", "form"], ["invoice"], ["memo"]]
    reviewers = [(f"r{i}", i, rng.randrange(9), pairs[i % 5], i % 6 != 0) for i in range(14)]
    kinds = ["invoice"] * 9 + ["receipt", "memo", "contract", "form", "other", None]
    tasks = [(f"t{i:03}", rng.choice(kinds), at(rng.randrange(60))) for i in range(400)]
    got = V.assign_reviewers(spark.createDataFrame(tasks, "task_id string, document_type string, created_at timestamp"),
                             spark.createDataFrame(reviewers, "user_id string, ord long, current_workload long, specializations array<string>, is_available boolean"), chunk).collect()
    assert {r["task_id"]: r["assigned_to"] for r in got} == serial_assignment(tasks, reviewers)
    assert len(got) == len(tasks)
    load = {r[0]: r[2] for r in reviewers}
    for r in sorted((r for r in got if r["assigned_to"]), key=lambda r: r["workload_before"]):
        assert r["workload_before"] == load[r["assigned_to"]]
        load[r["assigned_to"]] += 1


def passes_until_right(codes, types, first, chunk):
    """Passes over chunks until no start changes; the workloads at the end have to be the serial ones."""
    parts = [codes[i : i + chunk] for i in range(0, len(codes), chunk)]
    starts, n = [first] * len(parts), 0
    while True:
        n += 1
        ends = [filling.fill(c, types, s)[2] for c, s in zip(parts, starts)]
        new = filling.next_starts(types, starts, ends)
        if new == starts:
            assert ends[-1] == filling.fill(codes, types, first)[2]
            return n
        starts = new


def test_passes_do_not_grow_with_the_chunks():
    rng = random.Random(3)
    types = [[i % 4, (i + 1) % 4] for i in range(13)]
    first = [rng.randrange(5) for _ in types]
    few, many = (passes_until_right([rng.randrange(4) for _ in range(n * 100)], types, first, 100) for n in (8, 80))
    assert many <= few + 2 <= 9
    # A type that outruns its reviewers: the groups drift apart.
    apart = [[0], [0, 1], [1], [2]]
    assert passes_until_right([0 if rng.random() < 0.8 else rng.randrange(4) for _ in range(8000)], apart, [0, 3, 9, 1], 100) < 12



def test_touch_keeps_an_earlier_one_and_the_end(spark):
    tasks = spark.createDataFrame([("a", "r", at(0), None, "assigned"), ("b", "r", at(0), at(1), "completed"), ("c", "r", at(0), at(9), "in_progress")],
                                  "task_id string, assigned_to string, created_at timestamp, first_touched_at timestamp, status string")
    touches = spark.createDataFrame([(t, "r", at(5)) for t in "abc"] + [("a", "x", at(2))], "task_id string, reviewer_id string, ts timestamp")
    got = {r["task_id"]: (r["first_touched_at"], r["status"]) for r in V.first_touch(tasks, touches).collect()}
    assert got == {"a": (at(5), "in_progress"), "b": (at(1), "completed"), "c": (at(5), "in_progress")}


def test_handlers_keep_every_row(spark):
    from foliant.operators.handlers import TaskHandlers

    h = TaskHandlers()
    h.register("invoice", lambda df: df.withColumn("by", F.lit("invoice")))
    df = spark.createDataFrame([("invoice",), ("receipt",), (None,)], "document_type string")
    assert sorted(map(str, ((r["document_type"], r["by"]) for r in h.process(df).collect()))) == ["('invoice', 'invoice')", "('receipt', None)", "(None, None)"]
    assert TaskHandlers().process(df).count() == 3


def test_escalation_steps(spark):
    df = spark.createDataFrame([("a", 1, at(0), "pending"), ("b", 1, at(20), "pending"), ("c", 1, at(0), "completed"), ("d", 3, at(0), "pending"), ("e", 1, at(99), "pending")],
                               "task_id string, priority int, sla_deadline timestamp, status string")
    got = {r["task_id"]: r["priority"] for r in V.escalate_overdue(df, at(25)).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 3, "e": 1}


def test_feedback_and_training_record(spark):
    f = [("invoice_number", "INV", 0.95, "m"), ("total_amount", "$1,234.56", 0.65, "m")]
    tasks = spark.createDataFrame([("T", "D", "invoice", f, [], T0, "r1", "completed", at(30))], (
        "task_id string, document_id string, document_type string, extracted_fields array<struct<field_name:string,value:string,confidence:double,extraction_method:string>>, "
        "validation_errors array<string>, created_at timestamp, assigned_to string, status string, resolution_time timestamp"))
    fixes = spark.createDataFrame([("T", "total_amount", "$1234.56", None, None, 2, T0), ("T", "total_amount", "$9", "old", 1, 1, T0), ("T", "invoice_number", "INV", None, None, 1, T0)],
                                  "task_id string, field_name string, corrected_value string, reason string, rating int, pos long, timestamp timestamp")
    fb = V.collect_feedback(tasks, fixes).collect()
    assert [(r["field_name"], r["corrected_value"], r["correction_reason"], r["confidence_rating"]) for r in fb] == [("total_amount", "$1234.56", "Manual correction", 5)]
    rec = V.training_records(tasks, V.collect_feedback(tasks, fixes)).first()
    assert rec["resolution_time_minutes"] == 30.0 and abs(rec["field_corrections"][0]["confidence_delta"] - 1.75) < 1e-9
    assert {r["field_name"]: r["value"] for r in V.apply_corrections(tasks, fixes).collect()} == {"invoice_number": "INV", "total_amount": "$1234.56"}
