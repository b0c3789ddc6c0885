"""Jobs as a state machine over a stream of their events, with deadlines for jobs that hang.

Events of a job are held until the watermark has passed them and then applied in the order of
(instant, order of states, event id), so the result doesn't depend on how they are spread over
micro-batches.  Each event becomes one row that says what it did:

- ``ok``: a transition of ``LEGAL``;
- ``repeated``: the job is in that state already; nothing changes;
- ``illegal``: no such transition; the state stays;
- ``stuck``: a row of the machine's own, at the deadline of a job that is still running ``limit`` after it
  began to run; the job is then in the state ``stuck``.  An event at the deadline itself comes first.

State per job is the current state and the events not yet passed; a timer per job fires at the next of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: From each state (None: not seen yet) the states that may follow.
LEGAL = {
    None: ("queued", "running"),
    "queued": ("running", "failed"),
    "running": ("complete", "failed"),
    "failed": ("queued", "running"),
    "complete": ("queued",),
    "stuck": ("complete", "failed", "queued"),
}
ORDER = ("queued", "running", "failed", "complete")
RESULT = "job_id long, event_id long, at timestamp, was string, status string, outcome string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def advanced(job_id, was: str | None, since: int | None, events: list[tuple[int, str, int]], upto: int | None, limit: int) -> tuple[list[tuple], str | None, int | None]:
    """Rows (job_id, event_id, at, was, status, outcome) of events (at in microseconds, status, event_id), and the state after them at the instant ``upto``."""
    rows = []

    def overdue(now: int | None) -> None:
        nonlocal was, since
        if was == "running" and now is not None and since + limit < now:
            rows.append((job_id, None, since + limit, was, "stuck", "stuck"))
            was, since = "stuck", since + limit

    for at, status, event_id in sorted(events, key=lambda e: (e[0], ORDER.index(e[1]), e[2])):
        overdue(at)
        outcome = "repeated" if status == was else "ok" if status in LEGAL[was] else "illegal"
        rows.append((job_id, event_id, at, was, status, outcome))
        if outcome == "ok":
            was, since = status, at
    overdue(upto)
    return rows, was, since


def _instant(micros: int) -> datetime:
    return (_EPOCH + timedelta(microseconds=micros)).replace(tzinfo=None)


class JobMachine(StatefulProcessor):
    """``limit`` is in seconds; instants travel as microseconds."""

    def __init__(self, limit: int):
        self.limit = limit * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "was string, since long")
        self.waiting = handle.getListState("waiting", "at long, status string, event_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r.micros, r.status, r.event_id) for r in rows]
        self.waiting.appendList(events)
        self.handle.registerTimer(min(e[0] for e in events) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due, rest = [e for e in events if e[0] < passed], [e for e in events if e[0] >= passed]
        state = self.now.get() if self.now.exists() else (None, None)
        rows, was, since = advanced(key[0], state[0], state[1], due, passed, self.limit)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if was is not None and (was, since) != tuple(state):
            self.now.update((was, since))
        later = [e[0] for e in rest] + ([since + self.limit] if was == "running" else [])
        if later:
            self.handle.registerTimer(max(min(later), passed) // 1000 + 1)
        for job_id, event_id, at, before, status, outcome in rows:
            yield Row(job_id=job_id, event_id=event_id, at=_instant(at), was=before, status=status, outcome=outcome)

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, limit: int = 6 * 3600) -> DataFrame:
    """What each event (job_id, event_id, at, status) of a stream with a watermark on ``at`` did; ``limit`` in seconds.

    Rows whose status is none of ``ORDER`` or whose job_id is null are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = events.where(events.status.isin(*ORDER) & events.job_id.isNotNull()).selectExpr("job_id", "event_id", "at", "unix_micros(at) AS micros", "status")
    return known.groupBy("job_id").transformWithState(JobMachine(limit), RESULT, "Append", "EventTime")
