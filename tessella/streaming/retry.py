"""Retries that happen: failed messages wait for their time and are tried again, at most MAX_RETRIES times, then are dead letters.

The first try of a message is a column expression over the whole micro-batch. Only failures enter the state, one row per message
that is waiting: its next try, when that is due, and its fields. They are kept in buckets of many tasks, as each call from Python to
the store costs more than a row. Each bucket's next wait is a timer in event time, so a rerun of a stream gives
the same tries at the same times, whatever the number of micro-batches or restarts from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ingest import BACKOFF_MS, ERROR_CHARS, MAX_RETRIES

#: A try of a message: its number from 0, when it took place, whether it went well, and if not why, and whether it was the last.
TRIES = "task_id string, retry int, at timestamp, ok boolean, error string, dead boolean"
_WAITING = "task_id string, retry int, due long, message string"
#: Buckets of tasks. A task holds one bucket's waiting messages at a time; a checkpoint keeps the number it began with.
BUCKETS = 4_096
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: From a message (JSON text) and the number of the try to an error, or None if it went well.
Work = Callable[[str, int], str | None]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State per key with timers needs a store that can hold several tables; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Retries(StatefulProcessor):
    """Holds the failed messages of a bucket until their next tries are due. One that comes again while it waits is not taken twice.

    The state of a bucket is read and written as a whole, and its timer is that of its next due try, so calls of the store go by
    buckets, not by messages.
    """

    def __init__(self, work: Work, retries: int = MAX_RETRIES, step_ms: int = BACKOFF_MS):
        self.work, self.retries, self.step_ms = work, retries, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        now, first = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            if r.task_id not in first or (r.at_us, r.message) < first[r.task_id]:
                first[r.task_id] = r.at_us, r.message
        for task, *_ in self.waiting.get():
            first.pop(task, None)
        left = []
        for task, (at, message) in first.items():
            yield from self._tries(task, 1, at + 1_000 * self.step_ms, message, now, left)
        if left:
            self.waiting.appendList(left)
            self._wake(left)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        now, left, tried = timerValues.getCurrentWatermarkInMs(), [], False
        for task, retry, due, message in self.waiting.get():
            for row in self._tries(task, retry, due, message, now, left):
                tried = True
                yield row
        if tried and left:
            self.waiting.put(left)
        elif tried:
            self.waiting.clear()
        if left:
            self._wake(left)

    def _tries(self, task: str, retry: int, due: int, message: str, now: int, left: list[tuple]) -> Iterator[Row]:
        """All tries that are due (in microseconds) by now (in milliseconds); a later one is added to those left."""
        while -(-due // 1_000) <= now:
            error = self.work(message, retry)
            last = error is not None and retry >= self.retries
            yield Row(task_id=task, retry=retry, at_us=due, ok=error is None, error=error[:ERROR_CHARS] if last else error, dead=last)
            if error is None or last:
                return
            retry, due = retry + 1, due + 1_000 * self.step_ms * (retry + 1)
        left.append((task, retry, due, message))

    def _wake(self, left: list[tuple]) -> None:
        self.handle.registerTimer(-(-min(due for _, _, due, _ in left) // 1_000))

    def close(self) -> None:
        pass


def with_retries(messages: DataFrame, work: Work, first_error: Column, retries: int = MAX_RETRIES, step_ms: int = BACKOFF_MS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of the tries (see TRIES) of a stream of messages (task_id, ts, message).

    ``first_error`` is the first try's error, or null, of each row; later tries call ``work``. Try r + 1 is due step_ms * (r + 1) after
    try r, and takes place when a message with a later time was seen. A null task_id or ts is no message. A task whose
    messages repeat is tried once while it waits. Waiting messages are held in ``buckets`` by a hash of the task. Run it in ``keyed_state``.
    """
    known = messages.where(F.col("task_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    tried = known.withColumn("error", first_error)
    own = tried.select("task_id", F.lit(0).alias("retry"), F.col("ts").alias("at"), F.col("error").isNull().alias("ok"), F.when(F.lit(retries) > 0, F.col("error")).otherwise(F.substring("error", 1, ERROR_CHARS)).alias("error"), (F.col("error").isNotNull() & F.lit(retries <= 0)).alias("dead"))
    if retries <= 0:
        return own
    failed = tried.where(F.col("error").isNotNull()).select("task_id", "ts", F.unix_micros("ts").alias("at_us"), "message")
    dealt = failed.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)))
    later = dealt.groupBy("bucket").transformWithState(Retries(work, retries, step_ms), "task_id string, retry int, at_us long, ok boolean, error string, dead boolean", "Append", "EventTime")
    return own.union(later.select("task_id", "retry", F.timestamp_micros("at_us").alias("at"), "ok", "error", "dead"))


def outcomes(tries: DataFrame) -> DataFrame:
    """One row per task of a table of tries: tries made, COMPLETED, FAILED or PENDING, when the last took place, and its error."""
    last = F.max_by(F.struct("ok", "dead", "at", "error"), "retry")
    rows = tries.groupBy("task_id").agg((F.max("retry") + 1).alias("tries"), last.alias("l"))
    return rows.select("task_id", "tries", F.when(F.col("l.ok"), "COMPLETED").when(F.col("l.dead"), "FAILED").otherwise("PENDING").alias("status"), F.col("l.at").alias("at"), F.col("l.error").alias("error"))
