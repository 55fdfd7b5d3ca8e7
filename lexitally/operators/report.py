"""The text report, the progress line and its counter."""

from __future__ import annotations

import threading
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import SparkSession

RULE = "=" * 40


def format_report(mb: float, seconds: float, articles: int, words: int, unique: int, k: int, top: Iterable[tuple[int, str, int]]) -> str:
    """The report. ``k`` is the number asked for, though there may be fewer rows."""
    lines = [
        f"Processed {mb:g} MB in {seconds:.2f} seconds.",
        f"Total articles: {articles}",
        f"Total words: {words}",
        f"Unique words: {unique}",
        "",
        f"Top {k} Words:",
        RULE,
        *(f"{rank:>4}. {word:>25} : {count}" for rank, word, count in top),
    ]
    return "\n".join(lines) + "\n"


class _ByTask(AccumulatorParam):
    """The largest number of each task."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        for task, n in value2.items():
            value1[task] = max(n, value1.get(task, 0))
        return value1


class TaskCounter:
    """What tasks have done, as far as they have ended. Each task counts once, however often it runs.

    The driver keeps a number for each task: less than Spark keeps about it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._tasks = spark.sparkContext.accumulator({}, _ByTask())

    def reached(self, number: int) -> None:
        """In a task: what it has done until now. The stage and the partition tell tasks apart, and stay the same in a new attempt."""
        task = TaskContext.get()
        self._tasks.add({(task.stageId(), task.partitionId()): number})

    @property
    def value(self) -> int:
        return sum(list(self._tasks.value.values()))  # a copy first: tasks may end meanwhile


@contextmanager
def progress(spark: SparkSession, out, every: float = 0.5):
    """Writes ``Read N MB | Articles: M`` to ``out`` twice a second while the block runs, and gives it the counter for M.

    The bytes are Spark's own metric of the running stages. The counter adds up as tasks end; one that runs again doesn't raise it.
    """
    done, tracker, store = threading.Event(), spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    articles = TaskCounter(spark)

    def show() -> None:
        while not done.wait(every):
            stages = [store.lastStageAttempt(i) for i in tracker.getActiveStageIds() if tracker.getStageInfo(i)]
            if stages:
                read = sum(s.inputBytes() for s in stages)
                print(f"Read {read // (1024 * 1024)} MB | Articles: {articles.value}", end="\r", file=out, flush=True)

    thread = threading.Thread(target=show, daemon=True)
    thread.start()
    try:
        yield articles
    finally:
        done.set()
        thread.join()
