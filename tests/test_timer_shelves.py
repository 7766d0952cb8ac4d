"""Task timers with many tasks in a state value: what a shelf costs, and that it changes nothing of what comes out."""

import datetime as dt
import json
import random
from types import SimpleNamespace

import pandas as pd

from pyspark.sql import functions as F

from foliant.streaming.runner import batch_writer, rocksdb_state, run_available
from foliant.streaming.timers import ShelfTimers, TimerSpec, clock, task_timers
from tests.test_timer_calls import Store

T0 = dt.datetime(2024, 1, 1)


def test_calls_per_shelf():
    """Tasks of a shelf need as many messages as one task, when their events come and when their timers fire."""
    store = Store()
    timers = ShelfTimers(TimerSpec(), True)
    timers.init(store)
    entries = [json.dumps({"task_id": f"t{i}", "us": i * 1_000_000, "event_id": 2**60 + i, "event": "attempt_failed", "priority": None}) for i in range(40)]
    frames = iter([pd.DataFrame({"entry": entries[:25]}), pd.DataFrame({"entry": entries[25:]})])
    assert list(timers.handleInputRows(("s",), frames, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert sorted(store.calls) == ["get", "register", "update"] and store.timers == {60_000}
    store.calls.clear()
    # At 90 s the retries of the first 31 tasks are due.
    out = list(timers.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 90_000), SimpleNamespace(getExpiryTimeInMs=lambda: 60_000)))
    assert [(r.task_id, r.action, r.due_us, r.priority) for f in out for r in f.itertuples()] == [(f"t{i}", "retry", (60 + i) * 1_000_000, pd.NA) for i in range(31)]
    assert sorted(store.calls) == ["get", "register", "update"] and store.timers == {60_000, 91_000}


def test_shelves_change_nothing(spark, tmp_path):
    """Every micro-batch gives the same rows, also where events of some tasks meet due timers of others on their shelf."""
    rng = random.Random(5)
    kinds = ["attempt_failed", "touched", "started"] * 4 + ["completed", "cancel_requested"]
    schema = "task_id string, ts timestamp, event_id long, event string, priority int"
    src = str(tmp_path / "src")
    for i in range(4):
        rows = [(f"t{rng.randrange(90):02}", T0 + dt.timedelta(minutes=i * 45 + rng.randrange(90)), 2**60 + 100 * i + n, rng.choice(kinds), rng.choice([None, 1, 2, 3]))
                for n in range(90)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    clock(spark, T0 + dt.timedelta(days=4)).coalesce(1).write.mode("append").parquet(src)
    found, left = [], []
    for name, shelf in (("task", None), ("shelf", F.left("task_id", F.lit(2)))):
        out, ckpt = str(tmp_path / name), str(tmp_path / f"{name}-state")
        with rocksdb_state(spark):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            run_available(task_timers(stream, TimerSpec(retention=1800), "5 minutes", shelf=shelf), batch_writer(out), ckpt)
        found.append(sorted(map(str, spark.read.parquet(out).collect())))
        left.append([len(json.loads(r["value"]["tasks"])) for r in spark.read.format("statestore").option("stateVarName", "task").load(ckpt).collect()])
    assert found[0] == found[1] and len(found[0]) > 50
    rows = spark.read.parquet(out).collect()
    assert {r["action"] for r in rows} == {"retry", "timeout", "poisoned", "escalation"} and len({r["batch"] for r in rows}) > 3
    # As many tasks are left, on nine shelves at most.
    assert sum(left[0]) == sum(left[1]) and max(left[0]) == 1 and len(left[1]) <= 9
