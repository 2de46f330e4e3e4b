"""What a monitoring service keeps on the driver beside its streaming query: the source's connection, reports that wait,
and the progress of tasks and listeners. All of it is small and bounded; alerts themselves stay in DataFrames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from alertloom.streaming.monitor import with_hash

#: Limits of the queue and of the sessions, in seconds and entries.
QUEUE_SIZE, WAIT_SECONDS = 5, 5.0
SESSION_SECONDS, SWEEP_SECONDS, MOST_SESSIONS = 3600, 300, 100
MOST_TASKS, KEPT_TASKS = 50, 25
TASK_STATES = {"completed": "completed", "success": "completed", "failed": "failed", "error": "failed", "cancelled": "cancelled", "aborted": "cancelled"}


class Connection:
    """A source that is opened on first use and again after it was lost; `attempts` counts the failures in a row.

    open() gives a source with connect() -> bool, is_connected, read(n) and disconnect().
    """

    def __init__(self, open: Callable[[], object], clock: Callable[[], float] = time.time):
        self.open, self.clock = open, clock
        self.source, self.attempts, self.connected_at = None, 0, None

    def ensure(self) -> bool:
        if self.source is not None and self.source.is_connected:
            return True
        self.close()
        try:
            source = self.open()
            ok = bool(source.connect())
        except Exception:  # an unreachable source is a failed attempt, to be repeated at the next trigger
            ok = False
        if not ok:
            self.attempts += 1
            return False
        self.source, self.attempts, self.connected_at = source, 0, self.clock()
        return True

    def read(self, n: int = 1000) -> list:
        """Up to n records; none while there is no connection. An error that names the connection drops it."""
        if not self.ensure():
            return []
        try:
            return self.source.read(n)
        except Exception as e:
            if "connect" in str(e).lower():
                self.source = None
            return []

    def close(self) -> None:
        source, self.source, self.connected_at = self.source, None, None
        if source is not None:
            try:
                source.disconnect()
            except Exception:  # it is lost already
                pass


class ReportQueue:
    """One report at a time: alerts that come while one is written wait, and are merged by hash into the next report.

    A set that meets a full queue is refused and counted.
    """

    def __init__(self, generate: Callable[[DataFrame], object], size: int = QUEUE_SIZE, wait: float = WAIT_SECONDS):
        self.generate, self.size, self.wait = generate, size, wait
        self.waiting: list[DataFrame] = []
        self.refused = self.reports = 0
        self._running, self._lock = False, threading.Lock()

    def submit(self, alerts: DataFrame) -> bool:
        """Write a report of these and the waiting alerts, or have them wait for the next; False where they are refused."""
        with self._lock:
            if self._running:
                room = len(self.waiting) < self.size
                if room:
                    self.waiting.append(alerts)
                else:
                    self.refused += 1
                return room
            self._running = True
        try:
            time.sleep(self.wait)
            with self._lock:
                sets, self.waiting = [alerts, *self.waiting], []
            self.generate(merged(sets))
            self.reports += 1
            return True
        finally:
            with self._lock:
                self._running = False


def merged(sets: list[DataFrame]) -> DataFrame:
    """Alerts of several sets, one row per alert hash."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return (out if "alert_hash" in out.columns else with_hash(out)).dropDuplicates(["alert_hash"])


@dataclass
class Task:
    name: str
    total: int = 100
    started: float = 0.0
    step: int = 0
    progress: int = 0
    status: str = "started"
    ended: float | None = None
    messages: list[str] = field(default_factory=list)


@dataclass
class Session:
    started: float
    active: float
    connected: bool = True
    messages: int = 0


class Progress:
    """Tasks with their progress, and sessions that listen; idle and closed sessions and old finished tasks go in sweep()."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock = clock
        self.tasks: dict[str, Task] = {}
        self.sessions: dict[str, Session] = {}

    def connect(self, session: str) -> bool:
        """False where there is no room for another session."""
        if session not in self.sessions and len(self.sessions) >= MOST_SESSIONS:
            return False
        self.sessions[session] = Session(self.clock(), self.clock())
        return True

    def disconnect(self, session: str) -> None:
        self.sessions.pop(session, None)

    def start(self, task: str, name: str, total: int = 100) -> None:
        self.tasks[task] = Task(name, total, self.clock())

    def update(self, task: str, message: str = "", step: int | None = None, progress: int | None = None, status: str = "info") -> None:
        """New state of a task, told to every session; the state follows from the status word."""
        t = self.tasks[task]
        if step is not None:
            t.step = min(step, t.total)
            t.progress = t.step * 100 // t.total
        elif progress is not None:
            t.progress = max(0, min(100, progress))
            t.step = t.progress * t.total // 100
        t.status = TASK_STATES.get(status, "running")
        if t.status != "running":
            t.ended = self.clock()
        if t.status == "completed":
            t.progress = 100
        t.messages.append(message)
        for s in self.sessions.values():
            s.active, s.messages = self.clock(), s.messages + 1

    def sweep(self) -> None:
        now = self.clock()
        self.sessions = {k: s for k, s in self.sessions.items() if s.connected and now - s.active <= SESSION_SECONDS}
        if len(self.tasks) > MOST_TASKS:
            done = sorted((t.started, k) for k, t in self.tasks.items() if t.status in TASK_STATES.values())
            for _, k in done[:-KEPT_TASKS]:
                del self.tasks[k]

    def statistics(self) -> dict:
        now = self.clock()
        count = lambda state: sum(t.status == state for t in self.tasks.values())
        return {
            "sessions": {k: {"duration_seconds": now - s.started, "idle_seconds": now - s.active, "message_count": s.messages} for k, s in self.sessions.items()},
            "tasks": {k: {"status": t.status, "progress": t.progress, "step": t.step, "duration_seconds": (t.ended or now) - t.started, "message_count": len(t.messages)} for k, t in self.tasks.items()},
            "summary": {"active_sessions": len(self.sessions), "total_tasks": len(self.tasks), "completed_tasks": count("completed"), "failed_tasks": count("failed"), "running_tasks": count("running")},
        }
