"""Progress of a run: how many tasks of the stages under way are done, and when they should end."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class Progress:
    """Within its block, report() gets a line whenever a twentieth more of the known tasks is done; without report, nothing runs."""

    def __init__(self, spark: SparkSession, report: Callable[[str], None] | None, every_s: float = 1.0, steps: int = 20):
        self.tracker, self.report, self.every_s, self.steps = spark.sparkContext.statusTracker(), report, every_s, steps
        self._stop, self._stages = threading.Event(), {}

    def look(self) -> tuple[int, int]:
        """(tasks done, tasks known) over all stages seen so far."""
        for s in self.tracker.getActiveStageIds():
            self._stages.setdefault(s, (0, 0))
        for s in list(self._stages):
            info = self.tracker.getStageInfo(s)
            if info is not None:
                self._stages[s] = (info.numCompletedTasks, info.numTasks)
        return sum(d for d, _ in self._stages.values()), sum(n for _, n in self._stages.values())

    def _watch(self) -> None:
        began, last = time.time(), -1
        while not self._stop.wait(self.every_s):
            done, known = self.look()
            step = self.steps * done // known if known else 0
            if step != last and done:
                last, left = step, (time.time() - began) * (known - done) / done
                self.report(f"{done} of {known} tasks, about {left:.0f} s left")

    def __enter__(self) -> Progress:
        if self.report is not None:
            self._thread = threading.Thread(target=self._watch, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self.report is not None:
            self._thread.join(10)
            done, known = self.look()
            self.report(f"{done} of {known} tasks, done")
