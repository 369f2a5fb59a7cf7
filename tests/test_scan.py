"""Scans in pieces, range joins, order statistics and run-length traces against loops over plain lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultloom.functions import stats
from faultloom.operators import ranges, scan, trace
from faultloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_states_are_carried_over_pieces(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    v = F.col("v")
    states = {"s": scan.running_sum(v), "n": scan.row_number(), "m": scan.running_max(v), "l": scan.last_known(v), "p": scan.previous(v)}
    for backward in (False, True):
        got = scan.segmented_scan(df, ["k"], ["t"], scan.by_width(F.col("t"), 7), states, backward=backward).collect()
        want = []
        for k in ("a", "b", None):
            total = n = 0
            most = last = before = None
            for _, t, x in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if backward else r[1]):
                total, n = total + (x or 0), n + 1
                most, last = (x if most is None else max(most, x), x) if x is not None else (most, last)
                want.append((k, t, x, total, n, most, last, before))
                before = (x,)
        told = [(*tuple(r)[:7], None if r["p"] is None else (r["p"]["v"],)) for r in got]
        assert sorted(told, key=repr) == sorted(want, key=repr)
    assert scan.segmented_scan(df.limit(0), ["k"], ["t"], F.lit(0), states).count() == 0


def test_a_long_trace_is_scanned_in_pieces(spark):
    """Two million changes of one trace: every piece is a share of it, and the states run through."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    cut = scan.by_width(F.col("t"), scan.piece_width(df, "t"))
    assert df.groupBy(cut.alias("p")).count().agg(F.max("count")).first()[0] <= scan.PIECE_ROWS + 1
    out = scan.segmented_scan(df, ["k"], ["t"], cut, {"n": scan.row_number(), "l": scan.last_known(F.col("v"))})
    wrong = out.where((F.col("n") != F.col("t") + 1) | (F.col("l") != F.col("t") - F.col("t") % 1000))
    assert wrong.isEmpty()


def test_places_in_an_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = sorted(scan.numbered(df, ["v", "t"]).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 301))
    assert [tuple(r)[:3] for r in got] == sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[1]))
    per = scan.numbered(df, ["t"], by=["k"]).collect()
    assert all([r["t"] for r in sorted((r for r in per if r["k"] == k), key=lambda r: r["place"])] == sorted(t for q, t, _ in rows if q == k) for k in ("a", "b", None))


def test_order_statistics_by_selection(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([rng.random() * 100, rng.random() ** 8 * 1e9, 7.0])) for _ in range(3000)] + [("w", 1.0), ("q", None), ("e", 5.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: (len(x), x[len(x) // 2]) for k in "xyzwe" for x in [sorted(v for q, v in rows if q == k and v is not None)]}
    for few, bins in ((2048, 1024), (5, 4)):
        monkeypatch.setattr(scan, "FEW", few)
        monkeypatch.setattr(scan, "BINS", bins)
        got = scan.order_statistic(df, ["k"], "v", lambda n: F.floor(n / 2)).collect()
        assert {r["k"]: (r["n"], r["v"]) for r in got} == want
    every = sorted(v for _, v in rows if v is not None)
    assert [tuple(r) for r in scan.order_statistic(df, [], "v", lambda n: F.floor(n / 2)).collect()] == [(len(every), every[len(every) // 2])]
    assert scan.order_statistic(df.limit(0), ["k"], "v", lambda n: F.floor(n / 2)).count() == 0


@pytest.mark.parametrize("hot", [10**6, 20])
def test_points_in_intervals(spark, hot):
    """Intervals of all lengths, empty, turned and open ones; crowded bins are split; no nested-loop join."""
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randint(-50, 3000), i) for i in range(1500)] + [("a", None, -1), (None, 5, -2)]
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 5, 40, 900, -3]), j) for j, s in enumerate(rng.randint(-60, 3000) for _ in range(150))] + [("a", 100, None, 999)]
    p, s = spark.createDataFrame(points, "k string, at long, id long"), spark.createDataFrame(spans, "k string, lo long, hi long, j long")
    out = ranges.interval_join(p, s, keys=["k"], at="at", start="lo", stop="hi", hot=hot)
    want = sorted((i, j) for k, at, i in points for q, lo, hi, j in spans if k == q and at is not None and lo <= at < (math.inf if hi is None else hi))
    assert sorted((r["id"], r["j"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.interval_join(p.limit(0), s, keys=["k"], at="at", start="lo", stop="hi").count() == 0
    assert ranges.interval_join(p, s.limit(0), keys=["k"], at="at", start="lo", stop="hi").count() == 0


@pytest.mark.parametrize("piece", [9, None])
def test_nearest_rows(spark, piece):
    rng = random.Random(5)
    left = [(rng.choice("abd"), rng.choice([None, *range(200)]), i) for i in range(300)]
    right = [(rng.choice("abc"), rng.choice([None, *range(-20, 230)]), f"r{i}") for i in range(60)]
    out = ranges.nearest_join(spark.createDataFrame(left, "k string, at long, id long"), spark.createDataFrame(right, "k string, at long, name string"), keys=["k"], at="at", piece=piece)
    want = {}
    for k, at, i in left:
        best = min(((abs(x - at), x, n) for q, x, n in right if q == k and x is not None and at is not None), default=None)
        want[i] = (best[1:], best[0]) if best else (None, None)
    assert {r["id"]: (tuple(r["near"]) if r["near"] else None, r["distance"]) for r in out.collect()} == want


@pytest.mark.parametrize("width", [4, 1024])
def test_first_place_at_most(spark, width):
    rng = random.Random(6)
    series = [(rng.choice("ab"), i, rng.randint(-5, 60)) for i in range(700)]
    asked = [(rng.choice("abc"), rng.randint(0, 750), rng.randint(-8, 20), i) for i in range(200)]
    out = ranges.first_at_most(spark.createDataFrame(asked, "k string, `from` long, bound long, i long"), spark.createDataFrame(series, "k string, at long, value long"), keys=["k"], width=width)
    want = {i: next((at for q, at, v in series if q == k and at >= f and v <= b), None) for k, f, b, i in asked}
    assert {r["i"]: r["hit"] for r in out.collect()} == want


def sparse(rng, name, top):
    return [(name, c, s, rng.choice(["0", "1", "10", "x"])) for s in "pqr" for c in sorted(rng.sample(range(top), rng.randint(0, top // 3)))]


def held(rows, name, sig, cycle):
    return next((v for n, c, s, v in sorted(rows, key=lambda r: -r[1]) if n == name and s == sig and c <= cycle), None)


def decimal(v):
    return str(int(v, 2)) if v and len(v) > 1 and set(v) <= {"0", "1"} else v


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_run_length_traces_equal_a_walk_over_all_cycles(spark, width):
    rng = random.Random(7)
    golden = [r for t in range(8) for r in sparse(rng, t, 40)]
    buggy = [r for t in range(8) for r in sparse(rng, t, 40)]
    schema = "trace_id int, cycle long, sig string, val string"
    g, b = spark.createDataFrame(golden, schema), spark.createDataFrame(buggy, schema)
    common = sorted({(t, s) for t, _, s, _ in golden} & {(t, s) for t, _, s, _ in buggy})
    runs = trace.runs(g, width=width).collect()
    assert len(runs) == len(golden) and all(held(golden, r["trace_id"], r["sig"], c) == r["val"] for r in runs for c in range(r["cycle"], r["stop"] or 45))
    asked = spark.createDataFrame([(t, s, c) for t, s in common for c in (0, 7, 39)], "trace_id int, sig string, cycle long")
    assert all(r["held"] == held(golden, r["trace_id"], r["sig"], r["cycle"]) for r in trace.held_at(g, asked, width=width).collect())
    merged = trace.merged_runs(g, b, keys=("trace_id", "sig"), width=width).collect()
    assert all((held(golden, r["trace_id"], r["sig"], c), held(buggy, r["trace_id"], r["sig"], c)) == (r["golden"], r["buggy"]) for r in merged for c in range(r["cycle"], r["stop"] or 45))
    ends = spark.createDataFrame([(t, 10 + t) for t in range(8)], "trace_id int, end long")
    got = {(r["trace_id"], r["sig"]): r["first_diff"] for r in trace.replay_diff(g, b, inputs=["r"], ends=ends, width=width).collect()}
    want = {}
    for t, s in common:
        apart = [c for c in range(1, 11 + t) if decimal(held(golden, t, s, c)) != decimal(held(buggy, t, s, c))]
        want |= {(t, s): apart[0]} if apart and s != "r" else {}
    assert got == want
    pairs = trace.merged_runs(g.withColumnRenamed("trace_id", "pair_id"), b.withColumnRenamed("trace_id", "pair_id"), width=width)
    lost = sorted(tuple(r) for r in trace.transition_divergence(pairs, width=width).collect())
    want = []
    for t, s in common:
        for c in range(1, 45):
            g0, g1, b0, b1 = held(golden, t, s, c - 1), held(golden, t, s, c), held(buggy, t, s, c - 1), held(buggy, t, s, c)
            if g0 is not None and g0 != g1 and (b0 == b1 or (b1 is not None and b1 != g1)):
                want.append((t, s, c, g0, g1, b0, b1))
    assert lost == sorted(want, key=repr) or sorted(lost, key=repr) == sorted(want, key=repr)


def test_one_sided_changes_count(spark):
    """A step in which only one side changes is compared: golden 0 at 0 and 1 at 3, the other 0 at 0 alone."""
    schema = "trace_id int, cycle long, sig string, val string"
    g = spark.createDataFrame([(1, 0, "s", "0"), (1, 3, "s", "1")], schema)
    b = spark.createDataFrame([(1, 0, "s", "0")], schema)
    assert [tuple(r) for r in trace.replay_diff(g, b).collect()] == [(1, "s", 3)]


def test_each_cycle_has_a_held_value(spark):
    rng = random.Random(4)
    rows = [(t, c, s, rng.choice([None, 1, 2])) for t in range(6) for s in ("a", "b", None) for c in range(rng.randint(1, 40)) if rng.random() < 0.2]
    known, tops = {r[:3]: r[3] for r in rows if r[2]}, {t: max(r[1] for r in rows if r[0] == t) for t in {r[0] for r in rows}}
    want = []
    for t, s in {(r[0], r[2]) for r in rows}:
        held = None
        for c in range(tops[t] + 1):
            val = known.get((t, c, s))
            held = held if val is None else val
            want.append((t, s, c, val, held))
    for width in (5, 1 << 16):
        got = trace.hold(spark.createDataFrame(rows, "trace_id int, cycle long, sig string, val int"), width=width)
        assert got.columns == ["trace_id", "sig", "cycle", "val", "held"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert registry.QUERIES["w10_hold"](spark, SF).columns == got.columns  # all cycles, not only those in which a value is set


def test_handshakes_of_sparse_rows_equal_dense_ones(spark):
    rng = random.Random(8)
    rows = [(t, c, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for t in range(30) for c in range(25) if rng.random() < 0.25]
    anchors = spark.createDataFrame([(t, rng.randint(0, 24)) for t in range(0, 30, 2)], "trace_id int, anchor long")
    ends = spark.createDataFrame([(t, 24) for t in range(30)], "trace_id int, end long")
    known = {(t, c): (v, r) for t, c, v, r in rows}
    dense = [(t, c, *known.get((t, c), (None, None))) for t in range(30) for c in range(25)]
    schema = "trace_id int, cycle long, valid int, ready int"
    one = trace.handshake_features(spark.createDataFrame(rows, schema), anchors, ends=ends, width=4).collect()
    two = trace.handshake_features(spark.createDataFrame(dense, schema), anchors).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
    for r in one:
        v = r0 = None
        pv, waits, holds, ready = 0, 0, 0, None
        for c in range(25):
            a, b = known.get((r["trace_id"], c), (None, None))
            v, r0 = (a if a is not None else v), (b if b is not None else r0)
            ready = c if ready is None and r0 == 1 else ready
            waits += v == 1 and r0 == 0 and ready is None
            holds += v == 1 and ready is not None
            pv = v
        assert (r["wait_cycles"], r["hold_cycles"], r["first_ready"]) == (waits, holds, ready)


def test_paired_tests_by_continued_fraction(spark):
    pairs = [(20, 8), (32, 5), (20, 6), (28, 13), (14, 12), (13, 26), (0, 0), (1, 0), (0, 5), (7, 7), (8, 7), (100, 160), (3, 900), (0, 60), (500, 560), (None, 1)]
    golden = [0.0357, 7.4e-06, 0.00936, 0.02753, 0.84502, 0.05325]
    got = spark.createDataFrame(pairs, "b int, c int").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p"), stats.mcnemar_doubled(F.col("b"), F.col("c")).alias("q")).collect()
    assert all(abs(r["p"] - g) < 5e-5 * max(1, g) and abs(r["p"] / g - 1) < 0.01 for r, g in zip(got, golden, strict=False))
    for (b, c), r in zip(pairs, got, strict=True):
        if b is None:
            assert r["p"] is None and r["q"] is None
            continue
        n = b + c
        pmf = [math.comb(n, k) / 2**n for k in range(n + 1)]
        assert math.isclose(r["p"], min(1.0, sum(x for x in pmf if x <= pmf[b] + 1e-15)), rel_tol=1e-9, abs_tol=1e-12)
        assert abs(r["q"] - (round(min(1.0, 2 * sum(pmf[: min(b, c) + 1])), 4) if n else 1.0)) < 1e-9
    big = spark.createDataFrame([(5_000_000, 5_004_000), (4_990_000, 5_010_000)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert abs(big[0]["p"] - math.erfc(3999 / math.sqrt(10_004_000) / math.sqrt(2))) < 1e-6 and 2e-10 < big[1]["p"] < 3e-10
