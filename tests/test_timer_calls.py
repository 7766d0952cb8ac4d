"""What one task costs in messages between Python and the state store."""

from types import SimpleNamespace

from foliant.streaming.timers import TaskTimers, TimerSpec


class Store:
    """A handle, its value state and timers, that counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.note("get") or self.value, update=lambda v: self.note("update") or setattr(self, "value", v),
                               exists=lambda: self.note("exists") or self.value is not None, clear=lambda: self.note("clear") or setattr(self, "value", None))

    def note(self, name):
        self.calls.append(name)

    def listTimers(self):
        self.note("list")
        return list(self.timers)

    def registerTimer(self, at):
        self.note("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.note("delete")
        self.timers.remove(at)


def test_calls_per_task():
    store = Store()
    timers = TaskTimers(TimerSpec(), True)
    timers.init(store)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    row = {"us": 5_000_000, "event_id": 1, "event": "attempt_failed", "priority": None}
    assert list(timers.handleInputRows(("t",), iter([row]), clock)) == []
    assert store.calls == ["get", "update", "register"] or store.calls == ["get", "register", "update"]
    assert store.timers == {65_000}
    # Another event that does not move the timer leaves it alone; one that ends the task moves it.
    store.calls.clear()
    list(timers.handleInputRows(("t",), iter([row | {"us": 4_000_000, "event": "started"}]), clock))
    assert store.calls == ["get", "update"] and store.timers == {65_000}
    list(timers.handleInputRows(("t",), iter([row | {"us": 6_000_000, "event": "completed"}]), clock))
    assert store.timers == {(6 + 7 * 86_400) * 1000}
