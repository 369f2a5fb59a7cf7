"""Append-only call ledgers and resumable result streams, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .sink import KeyedSink

LEDGER = "ts timestamp, caller string, provider string, model string, input_tokens long, output_tokens long, cost double, mock boolean"


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """The lines of an append-only ledger, as they come; lines that can't be parsed are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ledger_summary(ledger: DataFrame, by: list[str] | None = None, *, window: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Calls, real and mock calls, tokens and cost, over all or for each of ``by``.

    With ``window``, for each span of ``ts`` as well; spans are dropped from memory once they are over by
    ``lateness``. Without one, memory holds one row for each key. Works on batch tables too.
    """
    keys = [F.col(c) for c in by or []]
    if window:
        ledger = ledger.withWatermark("ts", lateness) if ledger.isStreaming else ledger
        keys.append(F.window("ts", window).alias("span"))
    mock = F.coalesce(F.col("mock"), F.lit(False))
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~mock).alias("real_calls"),
        F.count_if(mock).alias("mock_calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"),
    )


def once_per_key(results: DataFrame, keys: list[str], *, ts: str | None = None, lateness: str = "1 day") -> DataFrame:
    """The first result of each key. With ``ts``, keys are forgotten ``lateness`` after they came, so
    memory is bounded; without, every key is remembered."""
    if ts:
        return results.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return results.dropDuplicates(keys)


def resume_into(results: DataFrame, done: str, keys: list[str], *, checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Save each key's first result in the ``KeyedSink`` at ``done``, whatever was saved by earlier runs; ends when the input is read."""
    sink = KeyedSink(results.sparkSession, done, results.schema, keys, order or [])
    return sink.start(results, checkpoint)
