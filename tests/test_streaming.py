"""Streams against the same operator on the whole table."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultloom.operators import evidence
from faultloom.streaming import ledger, retries, sink


def test_ledger_summary(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"ts": f"2026-01-01T00:{i:02d}:00Z", "caller": "ab"[i % 2], "input_tokens": i, "output_tokens": 2, "cost": 0.5, "mock": i % 3 == 0} for i in range(30)]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows[:20])) + "\n{broken\n")
    (source / "2.json").write_text("\n".join(map(json.dumps, rows[20:])))
    stream = ledger.ledger_summary(ledger.read_ledger(spark, str(source)), ["caller"])
    stream.writeStream.outputMode("complete").format("memory").queryName("ledger_test").trigger(availableNow=True).start().awaitTermination(60)
    got = {r["caller"]: r.asDict() for r in spark.table("ledger_test").collect()}
    assert {k: v["calls"] for k, v in got.items()} == {"a": 15, "b": 15}
    assert got["a"]["input_tokens"] == sum(range(0, 30, 2)) and got["b"]["cost"] == 7.5
    assert got["a"]["mock_calls"] + got["b"]["mock_calls"] == 10 and got["a"]["real_calls"] == 10
    batch = spark.read.schema(ledger.LEDGER).option("mode", "DROPMALFORMED").json(str(source))
    spans = ledger.ledger_summary(batch, window="10 minutes").collect()
    assert sorted(r["calls"] for r in spans) == [10, 10, 10]


def test_once_per_key_and_resume(spark, tmp_path):
    source, done = tmp_path / "in", str(tmp_path / "done")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"k": i % 5, "v": i}) for i in range(10)))
    stream = lambda: spark.readStream.schema("k long, v long").json(str(source))
    ledger.once_per_key(stream(), ["k"]).writeStream.format("memory").queryName("once_test").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("once_test").collect()) == [0, 1, 2, 3, 4]
    ledger.resume_into(stream(), done, ["k"], checkpoint=str(tmp_path / "c1")).awaitTermination(60)
    (source / "2.json").write_text("\n".join(json.dumps({"k": i, "v": i}) for i in range(3, 8)))
    ledger.resume_into(stream(), done, ["k"], checkpoint=str(tmp_path / "c1")).awaitTermination(60)
    ledger.resume_into(stream(), done, ["k"], checkpoint=str(tmp_path / "c2")).awaitTermination(60)
    saved = sink.KeyedSink(spark, done, stream().schema, ["k"], [])
    assert sorted(map(tuple, saved.read().collect())) == [(k, k) for k in range(8)]


def test_a_batch_counts_once_whatever_fails(spark, tmp_path, monkeypatch):
    """The stream fails between the write and the commit of a batch, twice, and is started again; a failed batch is not seen."""
    source = tmp_path / "in"
    source.mkdir()
    for f in range(4):
        (source / f"{f}.json").write_text("\n".join(json.dumps({"k": (f * 7 + i) % 13, "v": 100 * f + i}) for i in range(20)))
    stream = lambda: spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).json(str(source))
    table = sink.KeyedSink(spark, str(tmp_path / "table"), stream().schema, ["k"], ["v"], buckets=4)
    commit, calls = sink.KeyedSink._commit, []

    def failing(self, run, number):
        calls.append(number)
        if calls.count(number) == 1 and number in (0, 2):
            raise OSError("lost before the commit")
        commit(self, run, number)

    monkeypatch.setattr(sink.KeyedSink, "_commit", failing)
    for expected in (0, 2):
        with pytest.raises(StreamingQueryException):
            table.start(stream(), str(tmp_path / "c")).awaitTermination()
        assert calls[-1] == expected
    assert len(table.read().collect()) == 13  # batches 0 and 1 hold every key
    table.start(stream(), str(tmp_path / "c")).awaitTermination()
    rows = table.read().collect()
    assert len(rows) == 13 and calls == [0, 0, 1, 2, 2, 3]
    table.write(spark.createDataFrame([(99, 1)], "k long, v long"), 3, run=next(iter(table._last())))  # committed already
    assert len(table.read().collect()) == 13
    plan = table._stored().where(F.col("__bucket").isin([1])).select("k")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "__bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_retries_as_a_stream(spark, tmp_path):
    """Shuffled attempts in several files against the operator on the whole table."""
    rng = random.Random(5)
    rows = [{"task": t, "attempt": a, "ok": t % 3 == 0 and a == 2, "diff": "x" * 1600 if a == 4 else f"d{a}", "failure": None if a == 3 else "f"} for t in range(12) for a in range(1, 2 + t % 6)]
    rng.shuffle(rows)
    source = tmp_path / "in"
    source.mkdir()
    for f in range(4):
        (source / f"{f}.json").write_text("\n".join(map(json.dumps, rows[f::4])))
    schema = "task long, attempt long, ok boolean, diff string, failure string"
    with retries.settings(spark):
        out = retries.retry_history_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
        table = sink.KeyedSink(spark, str(tmp_path / "table"), out.schema, ["task"], ["good"], keep="last")
        table.start(out, str(tmp_path / "c"), mode="update").awaitTermination(100)
    got = {r["task"]: [tuple(h) for h in r["history"]] for r in table.read().where("not good").collect()}
    whole = evidence.retry_history(spark.read.schema(schema).json(str(source)), ["task"]).collect()
    assert got == {r["task"]: [tuple(h) for h in r["history"]] for r in whole} and len(got) > 5


def test_a_batch_writes_few_files(spark, tmp_path):
    """A batch from many tasks leaves one small file for each bucket, not one for each bucket and task."""
    for keep in ("first", "last"):
        table = sink.KeyedSink(spark, str(tmp_path / keep), T.StructType().add("k", "long").add("v", "long"), ["k"], ["v"], keep=keep, buckets=4)
        table.write(spark.range(2000).select(F.col("id").alias("k"), F.col("id").alias("v")).repartition(8, "v"), 0)
        assert len(list((tmp_path / keep / "rows").rglob("part-*.parquet"))) == 4
        assert table.read().count() == 2000
