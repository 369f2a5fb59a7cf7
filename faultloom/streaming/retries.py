"""S4 as a stream: the failed attempts of each task, kept in state while it is being retried."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ATTEMPT = "attempt: bigint, diff: string, failure: string"
#: Fixed values of the feedback loop: attempts told, and characters of a diff.
MOST, CUT = 3, 1500
#: Attempts of a task gathered before only the last are kept.
FULL = 64
#: What the session needs for these streams: a store for lists, and, where a stream shall end with its input, no batches for timers alone.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession):
    """SETTINGS for the streams that start inside."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Retries(StatefulProcessor):
    """State of a task: whether an attempt was good, and its last failed attempts. It is read and written once a batch, and forgotten when the task is idle for ``idle_ms``."""

    def __init__(self, most: int, cut: int, idle_ms: int) -> None:
        self.most, self.cut, self.idle_ms = most, cut, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", f"good boolean, failed array<struct<{ATTEMPT}>>", self.idle_ms)

    def last(self, attempts: list[tuple]) -> list[tuple]:
        return sorted(attempts, key=lambda x: (x[0], x[1], x[2] or ""))[-self.most :]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        good, kept = self.told.get() or (False, [])
        kept = [tuple(x) for x in kept]
        for _, attempt, ok, diff, failure in rows:
            good = good or bool(ok)
            if not good:
                kept.append((attempt, (diff or "")[: self.cut], failure))
                kept = self.last(kept) if len(kept) > FULL else kept
        kept = [] if good else self.last(kept)
        self.told.update((good, kept))
        yield Row(task=key[0], good=good, history=kept)

    def close(self) -> None:
        pass


def retry_history_stream(attempts: DataFrame, *, most: int = MOST, cut: int = CUT, idle_ms: int = 86_400_000) -> DataFrame:
    """(task, good, history) whenever a task's state changes: its last ``most`` failed attempts in order, diffs cut to ``cut`` characters; none once an attempt was good.

    attempts: a stream (task, attempt, ok, diff, failure) in any order; attempts of a task are numbered. The session needs SETTINGS as the stream starts.
    """
    kind = attempts.schema["task"].dataType.simpleString()
    out = StructType.fromDDL(f"task {kind}, good boolean, history array<struct<{ATTEMPT}>>")
    told = attempts.select("task", "attempt", "ok", "diff", "failure")
    return told.groupBy("task").transformWithState(Retries(most, cut, idle_ms), out, outputMode="Update", timeMode="ProcessingTime")
