"""Many tasks at once: a bounded pool of driver threads, with states, cancelling
through job tags, events and a rate limit. The work itself is Spark's."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.enums import TASK_STATES


@dataclass
class Task:
    task_id: str
    state: str = "pending"
    error: str = ""
    result: object = None
    started: float = 0.0
    ended: float = 0.0
    future: Future | None = field(default=None, repr=False)


class TaskManager:
    """Runs up to ``workers`` tasks; each runs under a job tag of its own id.

    ``on_event(task)`` is called at each change of state, from the task's thread.
    """

    def __init__(self, spark: SparkSession, workers: int = 4, on_event: Callable[[Task], None] | None = None):
        self.spark, self.on_event = spark, on_event
        self.pool, self.lock = ThreadPoolExecutor(workers), threading.Lock()
        self.tasks: dict[str, Task] = {}

    def _set(self, task: Task, state: str) -> None:
        assert state in TASK_STATES
        task.state = state
        if self.on_event:
            self.on_event(task)

    def submit(self, task_id: str, work: Callable[[], object]) -> Task:
        """Queue work; a second task of one id is an error."""
        with self.lock:
            if task_id in self.tasks:
                raise ValueError(f"task {task_id!r} is there already")
            task = self.tasks[task_id] = Task(task_id)

        def run():
            if task.state == "cancelled":
                return
            tag = f"task-{task_id}".replace(",", "_")
            self.spark.addTag(tag)
            task.started = time.time()
            self._set(task, "downloading")
            try:
                task.result = work()
                self._set(task, "done")
            except Exception as e:  # noqa: BLE001 - whatever a task raises is its state
                task.error = str(e)
                if task.state != "cancelled":
                    self._set(task, "failed")
            finally:
                task.ended = time.time()
                self.spark.removeTag(tag)

        self._set(task, "pending")
        task.future = self.pool.submit(run)
        return task

    def cancel(self, task_id: str) -> bool:
        """Stop a task that has not ended: its queued work or its running jobs."""
        task = self.tasks.get(task_id)
        if task is None or task.state in ("done", "failed", "cancelled"):
            return False
        self._set(task, "cancelled")
        if not task.future.cancel():
            self.spark.interruptTag(f"task-{task_id}".replace(",", "_"))
        return True

    def wait(self) -> dict[str, str]:
        """Wait for all; the state of each."""
        for task in list(self.tasks.values()):
            if not task.future.cancelled():
                task.future.result()
        return {t.task_id: t.state for t in self.tasks.values()}

    def close(self) -> None:
        self.pool.shutdown()


class RateLimit:
    """A token bucket of ``rate`` units a second and a second's burst; 0 is no limit.
    A request above the burst is let through in parts."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.tokens, self.at, self.lock = rate, clock(), threading.Lock()

    def allow(self, n: float) -> bool:
        if self.rate <= 0:
            return True
        with self.lock:
            now = self.clock()
            self.tokens, self.at = min(self.rate, self.tokens + (now - self.at) * self.rate), now
            if n > self.tokens:
                return False
            self.tokens -= n
            return True

    def wait(self, n: float) -> None:
        while self.rate > 0 and n > 0:
            part = min(n, self.rate)
            while not self.allow(part):
                self.sleep(max((part - self.tokens) / self.rate, 0.001))
            n -= part
