"""The life of submitted tasks as keyed state: queued, running, done or failed, until they expire or are evicted.

A desk is what has a queue of its own; its state is a map of the tasks that it holds, of bounded number, so one key never
holds more than ``Desk.most`` entries however many tasks pass through it. Timers drop tasks whose time is over even if
nothing more arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds that a task is kept and tasks that are held; stages and shares of the work done.
TTL = 7200
MOST = 20
STATES = {"queued": ("排队中", 0), "running": ("解析", 5), "done": ("完成", 100), "error": ("失败", 100)}
#: What ends a task for the desk: its time is over, a newer one took its place, or it was not let in.
ENDS = ("expired", "evicted", "rejected")
_VALUE = "created timestamp, status string, message string"
CHANGES = "desk string, task_id string, status string, stage string, pct int, message string, created timestamp, at timestamp, seq long"


@dataclass(frozen=True)
class Desk:
    """``ttl``: seconds after which a task goes. ``most``: tasks held. ``refuse``: a full desk rejects a task, else the
    oldest one makes room."""

    ttl: float = TTL
    most: int = MOST
    refuse: bool = False


class Lifecycle(StatefulProcessor):
    """Rows of a desk: task_id, kind (``submit`` or a state), message, at, seq. Gives a row for each change.

    Rows of one call are taken in the order of (at, seq): a micro-batch is sorted, a table's rows come sorted, one after
    another, and none is held. A state of a task that the desk does not hold is ignored; so is a
    state other than ``STATES``. A task that is submitted again starts anew. ``ticking``: the clock is the engine's
    processing time, with timers; else it is ``at`` of the rows.
    """

    def __init__(self, rules: Desk, ticking: bool) -> None:
        self.rules, self.ticking = rules, ticking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", _VALUE)

    def _held(self) -> dict[str, tuple[datetime, str, str | None]]:
        return {k[0]: tuple(v) for k, v in self.tasks.iterator()}

    def _row(self, desk: str, task: str, value: tuple, status: str, at: datetime, seq: int | None) -> Row:
        stage, pct = STATES.get(status, ("", 100))
        return Row(desk=desk, task_id=task, status=status, stage=stage, pct=pct, message=value[2], created=value[0], at=at, seq=seq)

    def _drop(self, desk: str, held: dict, task: str, status: str, at: datetime, seq: int | None) -> Row:
        return self._row(desk, task, held.pop(task), status, at, seq)

    def _keep(self, before: dict, held: dict) -> None:
        """Write what has changed since ``before``: one write for each task at most."""
        for task in before.keys() - held.keys():
            self.tasks.removeKey((task,))
        for task, value in held.items():
            if before.get(task) != value:
                self.tasks.updateValue((task,), value)

    def _in_order(self, rows: Iterator[Row]) -> Iterator[Row]:
        last = None
        for r in rows:
            own = (r["at"], r["seq"] is not None, r["seq"])
            if last is not None and own < last:
                raise ValueError("rows of a table are not in the order of (at, seq)")
            last = own
            yield r

    def _expire(self, desk: str, held: dict, now: datetime, seq: int | None = None) -> Iterator[Row]:
        last = now - timedelta(seconds=self.rules.ttl)
        for task in sorted((t for t, v in held.items() if v[0] < last), key=lambda t: (held[t][0], t)):
            yield self._drop(desk, held, task, "expired", now, seq)

    def _clock(self, timers) -> datetime:
        return datetime.fromtimestamp(timers.getCurrentProcessingTimeInMs() / 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        desk, before = key[0], self._held()
        held = dict(before)
        now = self._clock(timerValues) if self.ticking else None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])) if self.ticking else self._in_order(rows):
            at = now or r["at"]
            yield from self._expire(desk, held, at, r["seq"])
            task = r["task_id"]
            if r["kind"] == "submit":
                if task not in held and self.rules.refuse and len(held) >= self.rules.most:
                    yield self._row(desk, task, (at, "", r["message"]), "rejected", at, r["seq"])
                    continue
                held[task] = (at, "queued", r["message"])
                if self.ticking:  # one millisecond later the task is older than its time
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.rules.ttl * 1000) + 1)
            elif task in held and r["kind"] in STATES:
                held[task] = (held[task][0], r["kind"], r["message"])
            else:
                continue
            yield self._row(desk, task, held[task], held[task][1], at, r["seq"])
            while len(held) > self.rules.most:
                yield self._drop(desk, held, min(held, key=lambda t: (held[t][0], t)), "evicted", at, r["seq"])
        self._keep(before, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._held()
        held = dict(before)
        yield from self._expire(key[0], held, self._clock(timerValues))
        self._keep(before, held)

    def close(self) -> None:
        pass


_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(events: DataFrame, rules: Desk = Desk()) -> DataFrame:
    """Every change of the tasks of ``events``: desk, task_id, kind, message, at, seq (orders rows of one time).

    Of a stream the clock is processing time; a table is replayed by its own times. Rows without a desk, task, kind or time
    are left out. Keyed state of this kind needs the session's state store to be RocksDB; it is set so here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    x = events.select(F.col("desk").cast("string").alias("desk"), F.col("task_id").cast("string").alias("task_id"), "kind", F.col("message").cast("string").alias("message"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"))
    x = x.where("desk is not null and task_id is not null and kind is not null and at is not null")
    ticking = events.isStreaming
    if not ticking:
        x = x.repartition("desk").sortWithinPartitions("desk", "at", "seq")
    _ = events.sparkSession.streams.active  # state of a table needs the coordinator that a session's first stream brings up
    return x.groupBy("desk").transformWithState(Lifecycle(rules, ticking), CHANGES, "Update", "ProcessingTime" if ticking else "None")


def current(made: DataFrame) -> DataFrame:
    """The tasks that desks hold after a table of changes: desk, task_id, status, stage, pct, message, created, at."""
    order = F.struct("created", "at", "seq", F.col("status").isin(*ENDS))  # an end follows the change of the same row
    last = made.where("status <> 'rejected'").groupBy("desk", "task_id").agg(F.max_by(F.struct(*made.columns), order).alias("x"))
    return last.select("x.*").where(~F.col("status").isin(*ENDS))
