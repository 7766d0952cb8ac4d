"""Review tasks as keyed state with timers: retries, timeouts, escalations and poisoned tasks come out when their time has come.

What is kept of a task is small: its first three failures, first completion, cancellation and touch, its last event,
and which actions are out already. The order in which events arrive does not matter. A task has one timer, for its next action;
it fires when the stream's clock passes it, without any event of the task. The clock is the watermark (``EventTime``; rows
with the event ``clock`` move it where nothing else does) or the machine's (``ProcessingTime``). A task that has ended leaves the state
after a retention time in which further events of it are still told apart from a new task.

Tasks of one shelf are one value in the state store and have the earliest of their timers there, since each key costs messages to the JVM
and a batch of its own, which is far more than the work on a task; their events come as frames, whose cost is per shelf too. Without
shelves each task is a key and its events are rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant import config

if TYPE_CHECKING:
    import pandas as pd

CLOCK = "clock"
SECOND = 1_000_000
#: The time of the key's timer, and its tasks as JSON: each an array of the task's id and the fields of ``Task``.
_STATE = "timer bigint, tasks string"
#: What of the task's state the first event of a kind is.
_FIRST = {"completed": "completed", "cancel_requested": "cancelled", "touched": "touched"}
OUTPUT = "task_id string, action string, due_us bigint, priority int"


@dataclass(frozen=True)
class TimerSpec:
    timeout: int = config.TASK_TIMEOUT_SECONDS
    escalate_every: int = config.ESCALATION_SECONDS
    #: Seconds that an ended task stays in the state.
    retention: int = 7 * 86_400


@dataclass
class Task:
    """What decides a task's state; times are microseconds, events (time, id)."""

    completed: list[int] | None = None
    cancelled: list[int] | None = None
    touched: list[int] | None = None
    failures: list[list[int]] | None = None
    last: list[int] | None = None
    last_event: str | None = None
    created: int | None = None
    priority: int | None = None
    sent: list[str] | None = None
    #: When the task's timer fires, in milliseconds.
    timer: int | None = None

    def add(self, us: int, event_id: int, event: str, priority: int | None) -> None:
        at = [us, event_id]
        first = _FIRST.get(event)
        if first:
            setattr(self, first, min(getattr(self, first) or at, at))
        if event == "attempt_failed":
            self.failures = sorted([*(self.failures or []), at])[: config.MAX_ATTEMPTS]
        if self.last is None or at > self.last:
            self.last, self.last_event = at, event
        self.created = us if self.created is None else min(self.created, us)
        if priority is not None:
            self.priority = max(priority, self.priority or 0)

    def end(self) -> tuple[list[int] | None, bool]:
        """When the task ended, and whether it was poisoned."""
        fails = self.failures or []
        poisoned = fails[config.MAX_ATTEMPTS - 1] if len(fails) >= config.MAX_ATTEMPTS else None
        ends = [x for x in (self.completed, self.cancelled, poisoned) if x]
        end = min(ends) if ends else None
        return end, end is not None and end == poisoned and end not in (self.completed, self.cancelled)

    def actions(self, spec: TimerSpec) -> list[tuple[str, int, int | None]]:
        """Name, time and new priority of all that comes next if no event does."""
        end, poisoned = self.end()
        out: list[tuple[str, int, int | None]] = [("poisoned", end[0], None)] if poisoned else []
        if end:
            return self._unsent(out)
        fails = self.failures or []
        if self.last_event == "attempt_failed":
            out.append(("retry", fails[-1][0] + config.RETRY_BASE_SECONDS * config.RETRY_FACTOR ** (len(fails) - 1) * SECOND, None))
        elif self.touched:
            out.append(("timeout", self.touched[0] + spec.timeout * SECOND, None))
        if self.priority is not None:
            deadline = self.created + config.SLA_HOURS.get(self.priority, config.SLA_DEFAULT_HOURS) * 3600 * SECOND
            out += [("escalation", deadline + k * spec.escalate_every * SECOND, self.priority + k + 1) for k in range(config.MAX_PRIORITY - self.priority)]
        return self._unsent(out)

    def _unsent(self, actions: list[tuple[str, int, int | None]]) -> list[tuple[str, int, int | None]]:
        return [a for a in actions if _name(a) not in self.sent] if self.sent else actions


_FIELDS = [f.name for f in fields(Task)]


def _name(action: tuple[str, int, int | None]) -> str:
    return f"{action[0]}@{action[1]}"


def _millis(us: int) -> int:
    return -(-us // 1000)


class TaskTimers(StatefulProcessor):
    """Keeps the tasks of a key in one value; here the key is the task."""

    def __init__(self, spec: TimerSpec, event_time: bool) -> None:
        self.spec, self.event_time = spec, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _load(self) -> tuple[int | None, dict[str, list]]:
        """The time of the key's timer, and what is kept of its tasks by their id."""
        value = self.state.get()
        return (value[0], {name: kept for name, *kept in json.loads(value[1])}) if value else (None, {})

    def _save(self, timer: int | None, tasks: dict[str, list], fired: int | None = None) -> None:
        """Each call of the state is a message to the JVM, so a timer that stays is not touched; one that has fired is taken away by Spark."""
        at = min((kept[-1] for kept in tasks.values() if kept[-1] is not None), default=None)
        if timer is not None and timer not in (at, fired):
            self.handle.deleteTimer(timer)
        if at is not None and at != timer:
            self.handle.registerTimer(at)
        self.state.update((at, json.dumps([[name, *kept] for name, kept in tasks.items()], separators=(",", ":"))))

    def _kept(self, task: Task, actions: list[tuple[str, int, int | None]], now: int) -> list:
        """The fields of a task with its timer, for the next action or for leaving the state; what is due already fires at the next tick."""
        due = [a[1] for a in actions]
        if not due and (end := task.end()[0]):
            due = [end[0] + self.spec.retention * SECOND]
        task.timer = max(_millis(min(due)), now + 1 if self.event_time and now > 0 else 1) if due else None
        return [getattr(task, f) for f in _FIELDS]

    def add(self, events: Iterable[tuple[str, int, int, str, int | None]], timerValues) -> None:
        """Takes events (task, microseconds, id, event, priority) of the key; without any the state is not asked."""
        timer, tasks, met = None, None, {}
        for name, us, event_id, event, priority in events:
            if event != CLOCK:
                if tasks is None:
                    timer, tasks = self._load()
                task = met.get(name)
                if task is None:
                    task = met[name] = Task(*tasks.get(name, ()))
                task.add(us, event_id, event, priority)
        if tasks is not None:
            now = self._now(timerValues)
            tasks.update((name, self._kept(task, task.actions(self.spec), now)) for name, task in met.items())
            self._save(timer, tasks)

    def fire(self, timerValues, fired: int) -> list[tuple[str, str, int, int | None]]:
        """What is due of the key's tasks (task, action, microseconds, priority); the others are left as they are."""
        timer, tasks = self._load()
        if timer != fired:
            return []
        now, out = self._now(timerValues), []
        for name, kept in list(tasks.items()):
            if kept[-1] is None or kept[-1] > now:
                continue
            task, due, later = Task(*kept), [], []
            for action in task.actions(self.spec):
                (due if _millis(action[1]) <= now else later).append(action)
            due.sort(key=lambda a: a[1])
            task.sent = [*(task.sent or []), *map(_name, due)]
            end, _ = task.end()
            if end and not later and _millis(end[0] + self.spec.retention * SECOND) <= now:
                del tasks[name]
            else:
                tasks[name] = self._kept(task, later, now)
            out += [(name, *action) for action in due]
        if tasks:
            self._save(timer, tasks, fired)
        else:
            self.state.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] != CLOCK:
            self.add(((key[0], row["us"], row["event_id"], row["event"], row["priority"]) for row in rows), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for name, action, us, priority in self.fire(timerValues, expiredTimerInfo.getExpiryTimeInMs()):
            yield Row(task_id=name, action=action, due_us=us, priority=priority)


class ShelfTimers(TaskTimers):
    """The same for many tasks of a key, in frames; an event is one JSON text, which keeps its numbers as they are beside missing ones."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = (e for frame in rows for e in json.loads(f"[{','.join(frame['entry'])}]"))
        self.add(((e["task_id"], e["us"], e["event_id"], e["event"], e["priority"]) for e in events), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pandas as pd

        out = self.fire(timerValues, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            name, action, us, priority = zip(*out)
            yield pd.DataFrame({"task_id": name, "action": action, "due_us": us, "priority": pd.array(priority, "Int32")})


def task_timers(events: DataFrame, spec: TimerSpec = TimerSpec(), delay: str = "0 seconds", event_time: bool = True, shelf: Column | None = None) -> DataFrame:
    """A stream of ``task_id, action, due_at, priority`` from events ``task_id, ts, event_id, event, priority``; to be run inside
    ``rocksdb_state``. ``priority`` is the new one of an escalation.

    An action is decided by the events known when the clock passes its time; it comes out once. ``delay`` is how late events may be.
    ``shelf`` is made of the task's id and names the tasks that share a state value: some hundreds of them at most, as a shelf
    is read and written whole. It does not change what comes out, and is the same for all runs of a checkpoint.
    """
    rows = events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event", "priority")
    how = {"outputStructType": OUTPUT, "outputMode": "append", "timeMode": "EventTime" if event_time else "ProcessingTime"}
    if shelf is None:
        out = rows.withWatermark("ts", delay).groupBy("task_id").transformWithState(statefulProcessor=TaskTimers(spec, event_time), **how)
    else:
        entry = F.to_json(F.struct("task_id", "us", "event_id", "event", "priority"), {"ignoreNullFields": "false"})
        packed = rows.select(shelf.alias("shelf"), "ts", entry.alias("entry"))
        out = packed.withWatermark("ts", delay).groupBy("shelf").transformWithStateInPandas(statefulProcessor=ShelfTimers(spec, event_time), **how)
    return out.select("task_id", "action", F.timestamp_micros("due_us").alias("due_at"), "priority")


def clock(spark, *moments) -> DataFrame:
    """Rows that move the clock of an event-time stream."""
    rows = spark.createDataFrame([(str(m),) for m in moments], "ts string")
    return rows.select(F.lit(CLOCK).alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
                       F.lit(CLOCK).alias("event"), F.lit(None).cast("int").alias("priority"))
