"""Sources on small files written by hand."""

import datetime
import json
import random

from pyspark.sql import functions as F

from faultloom.operators import trace
from faultloom.plans import file_queries
from faultloom.sources import logs, vcd

DUMP = """$timescale 1ns $end
$var wire 1 ! clk $end
$var wire 4 # count $end
$enddefinitions $end
#0
$dumpvars
0!
b0000 #
$end
#5
1!
b0001 #
#10
0!
r1.5 x
#15
1!
b0010 #
b0011 #
"""


def test_value_change_dump(spark, tmp_path):
    (tmp_path / "a.vcd").write_text(DUMP)
    lines = vcd.read_lines(spark, str(tmp_path / "a.vcd"))
    names = {r["vid"]: (r["name"], r["width"]) for r in vcd.signals(lines).collect()}
    assert names == {"!": ("clk", 1), "#": ("count", 4)}
    found = vcd.changes(lines)
    assert [(r["ts"], r["vid"], r["val"]) for r in found.orderBy("pos").collect()] == [
        (0, "!", "0"), (0, "#", "0000"), (5, "!", "1"), (5, "#", "0001"), (10, "!", "0"), (15, "!", "1"), (15, "#", "0010"), (15, "#", "0011"),
    ]
    named = found.join(vcd.signals(lines).select("trace_id", "vid", F.col("name").alias("sig")), ["trace_id", "vid"])
    last = trace.last_in_cycle(trace.with_cycles(named, (F.col("sig") == "clk") & F.col("val").isin("1", "01", "001")))
    got = {(r["cycle"], r["sig"]): r["val"] for r in last.collect()}
    assert got[0, "count"] == "0000" and got[1, "count"] == "0001" and got[2, "count"] == "0011"


def test_text_in_any_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("käse".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gbk"))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in logs.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "käse", "b.txt": "中文"}


def test_result_rows(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"results": [{"sample": "s01", "ok": true}, {"sample": "s02", "ok": false}]}')
    (tmp_path / "2.json").write_text('[{"sample": "s03"}]')
    (tmp_path / "3.json").write_text("{broken")
    rows = logs.read_results(spark, str(tmp_path / "*.json"), "sample: string, ok: boolean").orderBy("src", "pos").collect()
    assert [(r["sample"], r["ok"]) for r in rows] == [("s01", True), ("s02", False), ("s03", None)]
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k":')
    assert sorted(r["k"] for r in logs.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k long").collect()) == [1, 2]


def test_missing_files(spark, tmp_path):
    for d, names in (("s01", ("design.v", "tb.v")), ("s02", ("design.v",))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text("x")
    got = logs.missing_files(spark, str(tmp_path), ["design.v", "tb.v"]).collect()
    assert [(r["sample"], r["file"]) for r in got] == [("s02", "tb.v")]
    samples = spark.createDataFrame([("s01",), ("s03",)], "sample string")
    got = logs.missing_files(spark, str(tmp_path), ["design.v", "tb.v"], samples).collect()
    assert sorted((r["sample"], r["file"]) for r in got) == [("s03", "design.v"), ("s03", "tb.v")]


def test_dump_read_in_splits(spark, tmp_path):
    """A dump of many splits gives the changes of the dump as one piece, in order and with the right times."""
    text = "$var wire 8 # n $end\n#0\n" + "".join(f"#{i * 10}\nb{i % 2:08b} #\n1!\n" for i in range(1, 3000))
    (tmp_path / "big.vcd").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = vcd.read_lines(spark, str(tmp_path / "big.vcd"))
        assert lines.select("pos.block").distinct().count() > 3
        got = [(r["ts"], r["vid"], r["val"]) for r in vcd.changes(lines).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [x for i in range(1, 3000) for x in ((i * 10, "#", f"{i % 2:08b}"), (i * 10, "!", "1"))]


def test_results_with_a_fallback(spark, tmp_path):
    schema, keys = "sample: string, setting: string, seed: int, ok: boolean", ["sample", "setting", "seed"]
    one = lambda s, seed, ok: {"sample": s, "setting": "A", "seed": seed, "ok": ok}
    (tmp_path / "part_1.json").write_text(json.dumps({"results": [one("s02", 0, True), one("s01", 0, True)]}))
    (tmp_path / "part_2.json").write_text(json.dumps({"results": [one("s01", 0, False)]}))
    (tmp_path / "part_1.json.partial.jsonl").write_text(json.dumps(one("s03", 1, False)) + "\n" + json.dumps(one("s02", 0, False)) + "\n{cut")
    paths = [str(tmp_path / x) for x in ("all.json", "part_?.json", "part_*.partial.jsonl")]
    read = lambda: [(r["sample"], r["seed"], r["ok"]) for r in logs.read_with_fallback(spark, *paths, schema, keys).collect()]
    assert read() == [("s01", 0, True), ("s02", 0, True), ("s03", 1, False)]
    (tmp_path / "all.json").write_text(json.dumps({"results": []}))
    assert len(read()) == 3
    (tmp_path / "all.json").write_text(json.dumps({"results": [one("s09", 2, True)]}))
    assert read() == [("s09", 2, True)]


def test_log_scalars(spark):
    row = spark.range(1).select(
        logs.bmc_depth(F.lit("a\nbmc: depth 20\nb")).alias("depth"),
        logs.module_header(F.lit("module m #(parameter W = 8) (input a, output b);")).alias("m"),
        logs.expand_samples(F.lit("s04-s06, s40,s05")).alias("ids"),
        logs.fail_step(F.lit("Checking assertions in step 3..\nChecking assertions in step 11..")).alias("step"),
    ).first()
    assert row["depth"] == 20 and row["m"]["name"] == "m" and row["m"]["ports"] == "input a, output b"
    assert row["ids"] == ["s04", "s05", "s06", "s40"] and row["step"] == 11


def test_many_dumps_in_a_file(spark, tmp_path):
    """Files of many dumps, in splits smaller than a dump, against a loop; sc1_dump_files writes no file for each user."""
    rng, want = random.Random(6), []
    (tmp_path / "in").mkdir()
    for f in range(2):
        text = ""
        for k in range(8):
            name, t = f"t{f}{k}", 0
            text += f"$comment trace {name} $end\n"
            for _ in range(rng.choice([0, 3, 200])):
                t += rng.randint(0, 5)
                text += f"#{t}\nb101 {'ab'[t % 2]}\n"
                want.append((name, t, "ab"[t % 2]))
        (tmp_path / "in" / f"{f}.vcd").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        found = vcd.changes(vcd.dumps_of(vcd.read_lines(spark, str(tmp_path / "in"))))
        assert sorted((r["trace_id"], r["ts"], r["vid"]) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 20), i % 100 if i % 100 else None, "click", None if i % 7 == 0 else 5.0) for i in range(500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = file_queries.sc1_dump_files(spark, str(tmp_path))
    assert {r["trace"]: r["changes"] for r in out.collect()} == {k if k else None: 5 for k in range(100)}
    assert len(out.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
