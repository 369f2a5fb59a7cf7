"""Sinks: what is written is read back."""

import glob
import json

import pytest

from faultloom.sinks import files, waveforms


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/**/part-*", recursive=True)) for x in open(f, encoding="utf-8", newline="").read().splitlines()]


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("s01", 1), ("s02", None)], "sample string, n int")
    files.write_documents(df, str(tmp_path / "d"), key="sample")
    assert [json.loads(x) for x in lines(tmp_path / "d" / "__sample=s01")] == [{"sample": "s01", "n": 1}]


def test_appended_lines(spark, tmp_path):
    for k in (1, 2):
        files.append_lines(spark.createDataFrame([(k, None)], "k int, note string"), str(tmp_path / "l"))
    assert sorted(json.loads(x)["k"] for x in lines(tmp_path / "l")) == [1, 2] and all("note" in json.loads(x) for x in lines(tmp_path / "l"))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x", y'), (1, None)], "id int, text string")
    files.write_csv(df, str(tmp_path / "a"), order=["id"])
    assert spark.read.csv(str(tmp_path / "a"), header=True, escape='"').count() == 2
    files.write_csv(df, str(tmp_path / "b"), order=["id"], bom=True)
    assert lines(tmp_path / "b") == ["﻿id,text", "1,", '2,"say ""x"", y"']


def test_snapshots(spark, tmp_path):
    s = files.Snapshots(spark, f"file://{tmp_path}/s")
    assert s.read("k int").count() == 0
    for n in (3, 1):
        s.flush(spark.range(n).selectExpr("cast(id as int) AS k"))
        assert s.read("k int").count() == n
    with pytest.raises(Exception, match="."):
        s.flush(spark.range(2).selectExpr("raise_error('no') AS k"))
    assert s.read("k int").count() == 1


def test_waveforms(spark):
    sampled = spark.createDataFrame([(1, 0, "clk", "1"), (1, 1, "clk", "0"), (1, 1, "n", "0101"), (1, 2, "zz", "1")], "trace_id int, cycle long, sig string, val string")
    shown = spark.createDataFrame([(1, "n", 2), (1, "clk", 1)], "trace_id int, sig string, rank int")
    svg = waveforms.waveforms(sampled, shown, spark.createDataFrame([(1, 1)], "trace_id int, anchor long")).first()["svg"]
    assert svg.startswith("<svg") and svg.index(">clk<") < svg.index(">n<") and "0101" in svg and "zz" not in svg and "#fdd" in svg and ">?<" in svg
