"""Text, code and evidence operators on cases worked out by hand, and against plain Python."""

import difflib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from faultloom.functions import code, text
from faultloom.operators import evidence, facts, nesting, patches, trace

FILE = "\n".join(f"line {i}" for i in range(1, 9)) + "\n"


def test_hunks_with_blank_lines():
    diff = "--- a\n+++ b\n@@ -1,3 +1,4 @@\n a\n\n-b\n+c\n+\n@@ -9 +10 @@\n-x\n"
    got = text.hunks_of(diff)
    assert [(h["old"], h["new"], h["added"], h["deleted"]) for h in got] == [(1, 1, ["c", ""], ["b"]), (9, 10, [], ["x"])]
    assert text.hunks_of(None) == text.hunks_of("") == text.hunks_of("no hunk\n+x") == []


def test_truth_lines_by_hand():
    golden = [f"line {i}" for i in range(1, 13)]
    change = lambda f: text.truth_lines("\n".join(golden), "\n".join(f(list(golden))))
    assert change(lambda x: x[:5] + x[6:]) == [5]  # a deletion counts as the line before it
    assert change(lambda x: x[:6] + ["new"] + x[7:]) == [7]
    assert change(lambda x: x[:8] + ["new", "more"] + x[8:]) == [9, 10]
    assert change(lambda x: ["head"] + x) == [] and change(lambda x: x[1:]) == [] and change(lambda x: ["other"] + x[1:]) == []
    assert change(lambda x: x) == [] and text.truth_lines("", "") == []


@pytest.mark.parametrize("seed", range(30))
def test_truth_lines_against_a_second_reading(seed):
    """Lines from the difference of both texts as a plain listing, walked line by line."""
    rng = random.Random(seed)
    a = [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 30))]
    b = list(a)
    for _ in range(rng.randint(0, 6)):
        k = rng.randrange(len(b) + 1)
        b[k : k + rng.randint(0, 2)] = [rng.choice("xyz") * 3 for _ in range(rng.randint(0, 2))]
    want = set()
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op in ("replace", "insert") and not (op == "insert" and j2 <= 4):
            want |= {j + 1 for j in range(j1, j2) if j + 1 > 4}
        if op == "delete" and i2 > i1 and 4 < (j1 or 1) <= len(b):
            want.add(j1 or 1)
    assert text.truth_lines("\n".join(a), "\n".join(b)) == sorted(want)


def test_patches_by_hand():
    assert text.apply_diff(FILE, "@@ -2,1 +2,1 @@\n-line 2\n+two\n") == FILE.replace("line 2", "two")
    assert text.apply_diff(FILE, "@@ -2,0 +3 @@\n+new\n") == FILE  # a pure insertion has no place
    assert text.apply_diff(FILE, "@@ -6 +6 @@\n line 2\n-line 3\n+3\n") == FILE.replace("line 3", "3")  # a wrong number is only a hint
    assert text.apply_diff(FILE, "@@ -1 +1 @@\n-line 2\n\nnoise\n+two\n") == FILE.replace("line 2", "two")  # blank lines are no context
    assert text.apply_diff("  if (a)\n    b;\n", "@@ -1 +1 @@\n-if (a)\n+if (c)\n") == "  if (c)\n    b;\n"  # its indent is the file's
    assert text.apply_diff("a  <=  b;\n", "@@ -1 +1 @@\n-a <= b;\n+a <= c;\n") == "a <= c;\n"
    assert text.apply_diff("a\r\nb", "@@ -2 +2 @@\n-b\n+c") == "a\nc\n"
    assert text.apply_diff(FILE, "@@ -1 +1 @@\n-none\n+x\n") is None and text.apply_diff(FILE, "") is None and text.apply_diff(None, None) is None
    two = "@@ -1 +1 @@\n-line 1\n+1\n@@ -8 +8 @@\n-line 8\n+8\n"
    assert text.apply_diff(FILE, two) == FILE.replace("line 1\n", "1\n").replace("line 8", "8")


@pytest.mark.parametrize("seed", range(40))
def test_real_diffs_are_applied(seed):
    """What difflib writes for two texts of distinct lines turns one into the other, also with shifted numbers and other indents."""
    rng = random.Random(seed)
    a = [f"  stmt_{i} <= {i};" for i in range(40)]
    b = list(a)
    for k in sorted(rng.sample(range(2, 38), 4), reverse=True):
        b[k : k + 1] = rng.choice([[f"  changed_{k};"], [], [a[k], f"  added_{k};"]])
    diff = "\n".join(difflib.unified_diff(a, b, "a", "b", lineterm="", n=2)) + "\n"
    want = "\n".join(b) + "\n"
    assert text.apply_diff("\n".join(a) + "\n", diff) == want
    shifted = "\n".join("@@ -3 +3 @@" if x.startswith("@@") else x for x in diff.split("\n"))
    assert text.apply_diff("\n".join(a) + "\n", shifted) == want


def test_diffs_are_minimised():
    diff = "@@ -1 +1 @@\n-a\n+b\n c\n-d\n+e\n@@ -9 +9 @@\n-x\n+y\n"
    calls = []

    def holds(d):
        calls.append(d)
        return "+e" in d

    got, n = text.minimise_diff(diff, holds)
    assert got == "@@ -1 +1 @@\n c\n-d\n+e\n" and n == len(calls) <= 40
    assert text.minimise_diff(diff, lambda d: True, most=2)[1] == 2
    with pytest.raises(ValueError, match="as it is"):
        text.minimise_diff(diff, lambda d: False)


def test_many_diffs_are_minimised_at_once(spark):
    """A table of diffs, by rounds of trials, against the loop over one: what is left, and how many calls it takes."""
    rng = random.Random(9)
    diffs = [(i, "".join(rng.choice(["@@ -1 +1 @@\n", "+a\n", "-b\n", "+need\n", " c\n", "noise\n"]) for _ in range(rng.randint(1, 25)))) for i in range(30)] + [(98, "no hunk"), (99, "@@ -1 +1 @@\n+x\n c\n+y\n")]
    df = spark.createDataFrame(diffs, "id long, diff string")
    needed = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x == "+need"))
    want = df.select("id", needed("diff").alias("want"))
    units = {i: text.diff_units(d) for i, d in diffs}
    total = {i: sum(x == "+need" for _, ls in u for _, x in ls) for i, u in units.items()}

    def verdicts(trials):  # 98 and 99 never hold
        return trials.join(want, "id").select("id", "trial", ((needed("diff") == F.col("want")) & (F.col("id") < 90)).alias("ok"))

    for most in (40, 3):
        got = {r["id"]: r for r in patches.minimised(df.where("id >= 90 or diff like '@@%'"), verdicts, most=most).collect()}
        for i, d in diffs:
            if i >= 90:
                assert not got[i]["holds"] and got[i]["diff"] == d and got[i]["calls"] == 1
            elif d.startswith("@@"):
                left, calls = text.minimise_diff(d, lambda x, i=i: sum(y == "+need" for y in x.split("\n")) == total[i], most=most)
                assert (got[i]["diff"], got[i]["calls"]) == (left if got[i]["removed"] else d, calls), (d, left)


def test_trials_are_rebuilt_in_place(spark):
    """Segments are the table of lines, and a trial's text comes from its diff's row alone: no line and no trial is exchanged."""
    rng = random.Random(3)
    diffs = [(i, "".join(rng.choice(["@@ -1 +1 @@", "+a", "-b", "--- x", " c", "noise", "", "+\u2028d"]) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    df = spark.createDataFrame(diffs, "id long, diff string")
    want = {i: [] for i, _ in diffs}
    for r in sorted(patches.diff_lines(df).collect(), key=lambda r: (r["id"], r["pos"])):
        want[r["id"]].append((r["hunk"], r["unit"], r["line"]))
    for i, d in diffs:
        assert [(h, u, x) for h, u, lines in patches.segments(d) for x in lines.split("\n")] == want[i]
    plans = []

    def verdicts(trials):
        plans.append(trials._jdf.queryExecution().executedPlan().toString())
        return trials.select("id", "trial", F.lit(True).alias("ok"))

    assert {r["id"]: len(r["removed"]) for r in patches.minimised(df, verdicts).collect()} == {i: len({u for _, u, _ in x if u is not None}) for i, x in want.items()}
    assert len(plans) > 2 and not any("Window" in p or "collect_list" in p or p.count("Exchange") > 1 for p in plans)


def test_json_is_salvaged():
    assert text.salvage('<think>{"no": 1}</think>```json\n{"a": 1}\n```') == '{"a": 1}'
    assert text.salvage('{"a": {"b": 1}') == '{"a": {"b": 1}}' and text.salvage('{"a": 1, "b": {}, "c": tr') == '{"a": 1, "b": {}}'
    assert text.salvage("none") is text.salvage(None) is text.salvage("} {") is None
    assert text.balanced('x {"a": "}{\\"", "b": {}} y {') == '{"a": "}{\\"", "b": {}}' and text.balanced('{"a": "open') is None and text.balanced(None) is None


def test_json_is_found_row_by_row(spark):
    """Texts go to Python some hundred at a time, not in Arrow batches of ten thousand."""
    df = spark.createDataFrame([('x {"a": "é"} y',), ("{",), (None,)], "t string").select(text.salvage_json("t").alias("a"), text.balanced_json("t").alias("b"))
    assert [tuple(r) for r in df.collect()] == [('{"a": "é"}', '{"a": "é"}'), (None, None), (None, None)]
    plan = df._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def loop_blocks(lines):
    """Blocks by a walk over the lines with a depth that begins anew with each block."""
    out, start, depth = [], None, 0
    for i, line in enumerate(x.strip() for x in lines):
        opens, closes = len(re.findall(r"\bbegin\b", line)), len(re.findall(r"\bend\b", line))
        if start is None and re.match(r"always\s*@|assign\s", line):
            start, depth = i, (1 if opens == closes and "begin" in line else opens - closes)
        elif start is not None:
            depth += opens - closes
        else:
            continue
        if depth <= 0:
            out.append((start, i))
            start = None
    return out


def test_blocks_by_depth(spark):
    """Generated sources, cut into pieces of two lines and of many, and a file of one open block."""
    lines = ["always @(posedge clk) begin", "  if (a) begin", "  end", "end", "assign x = y;", "assign z =", "  w;", "always @* x = 1;", "always @(*) begin y = 1; end", "end", "always @(a) begin"]
    assert loop_blocks(lines) == [(0, 3), (4, 4), (5, 5), (7, 7), (8, 9)]
    rng = random.Random(8)
    parts = ["always @(posedge clk) begin", "always @* x = 1;", "assign q = begin_x;", "if (a) begin", "end", "end else begin", "x <= y;", "begin begin", "end end end", "", "always @(*) begin y; end"]
    files = [lines, ["always @(a) begin"] + ["x;"] * 30, []] + [rng.choices(parts, weights=[3, 1, 1, 3, 6, 2, 4, 1, 1, 1, 1], k=rng.randint(1, 120)) for _ in range(25)]
    rows = [(f, i, x) for f, ls in enumerate(files) for i, x in enumerate(ls)]
    df = spark.createDataFrame(rows, "trace_id int, pos long, line string")
    want = sorted((f, a, b) for f, ls in enumerate(files) for a, b in loop_blocks(ls))
    for piece in (2, 1024):
        assert sorted(map(tuple, nesting.blocks(df, piece=piece).collect())) == want


def one(spark, source, column):
    return spark.createDataFrame([(source,)], "source string").select(column(F.col("source")).alias("x")).first()["x"]


def test_mutations_and_faults(spark):
    source = "x\nassert (a == b);\nassert(!ok);\nassert (ok);\n// assert (c > d);\nassert (n < DEPTH); // >="
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "k int, source string")
    got = [tuple(r)[1:] for r in code.explode_mutations(df, "k", strong=True, higher=("delete", "const")).collect()]
    assert [(m[0], m[1], m[2]) for m in got if m[1] != "delete"] == [(2, "==", "!="), (3, "bool_neg", "bool_pos"), (4, "bool_pos", "bool_neg"), (6, "const:DEPTH", "2'd2"), (6, ">=", "<")]
    assert all(m[4].split("\n")[m[0] - 1] == m[3] for m in got) and sum(m[1] == "delete" for m in got) == 4
    assert [m[3] for m in got if m[0] == 3] == ["// [mutation-delete] assert(!ok);", "assert(ok);"] and [m[3] for m in got if m[0] == 6][1:] == ["assert (n < 2'd2); // >=", "assert (n < DEPTH); // <"]
    weak = code.explode_mutations(df, "k").where("line = 2").first()
    assert (weak["old"], weak["new"], weak["mutated_line"]) == ("==", ">=", "assert (a >= b);")  # 16 characters of line choose the second of three
    assert code.inject("a <= 1;\nb <= 2;\n", r"b <= (\d);", r"b <= \g<1>0;") == ("a <= 1;\nb <= 20;\n", 2, "- b <= 2;\n+ b <= 20;")
    assert code.inject("a\nb\n", "b\n", None) == ("a\n", 2, "- b\n+ <deleted>") and code.inject("a", "z", "y") is None
    bench = 'if (cnt != 3)\n  $fatal("cnt");\nif (ok) $fatal("ok");\n$display("cnt");\nif (cnt) begin\n$fatal("cnt");\nend'
    assert one(spark, bench, lambda c: code.weakened(c, ["cnt"])) == 'if (ok) $fatal("ok");\n$display("cnt");\nif (cnt) begin\nend'
    assert code.override_parameters("parameter N = 50;\nm #(.N(50)) u();\nlocalparam NN = 1;", {"N": "4"}) == "parameter N = 4;\nm #(.N(4)) u();\nlocalparam NN = 1;"


def test_structural_templates(spark):
    source = "// note\nif (a) begin\n  x;\nend\n// c\nelse if (b) begin\n  y;\nend\n"
    assert one(spark, source, lambda c: code.remove_branch(c, "if (a)")) == "// note\nelse if (b) begin\n  y;\nend\n"
    assert one(spark, source, lambda c: code.remove_block(c, "if (b)")) == "// note\nif (a) begin\n  x;\nend\n"
    assert one(spark, source, lambda c: code.remove_block(c, "if (a)")) == "// c\nelse if (b) begin\n  y;\nend\n"
    assert one(spark, "if (a) begin\n x;\n// c\ny;", lambda c: code.remove_branch(c, "if (a)")) == " x;\n// c\ny;"
    assert code.remove_guard("if (t >= MAX) begin\n s <= 0;\nend else if (b) c;", "t >= MAX") == "if (b) c;"
    assert one(spark, source, lambda c: code.remove_block(c, "zz")) is None and code.rewrite_jump("a", "b", "c") is None


def test_intents():
    source = "if (cnt == 3) begin\n  a <= b;\nend // and some more lines here\nif (cnt == 4) begin\n  a <= b;\nend\n"
    edit = lambda **p: {"action": "edit_assign", "params": p}
    assert code.assemble(source, edit(original="a<=b;", fixed="a <= c;", condition="cnt == 4")).count("a <= c;") == 1
    assert code.assemble(source, edit(original="a <= b;", fixed="a <= c;", trigger="cnt==4")).index("a <= c;") > source.index("cnt == 4")
    assert code.assemble(source, {"action": "guard_boundary", "params": {"assignment": "x <= 0", "condition": "cnt == 4"}}).split("\n")[4] == "  x <= 0;"
    assert code.assemble("  s <= S2;", {"action": "insert_wait", "params": {"target": "s <= S2;", "condition": "h == 1"}}) == "  if (h == 1) s <= S2;"
    assert code.assemble(source, "not json") is code.assemble(source, None) is code.assemble(source, {"action": "other"}) is None


def test_output_of_models(spark):
    rows = [("###LOCATE###\nline：12\nsignals: a, b\nreason: has DIFF\n###DIFF###\n@@ x\n",), ("plain",), (None,), ("###LOCATE### line: 3",)]
    got = [r["o"] and r["o"].asDict() for r in spark.createDataFrame(rows, "t string").select(text.parse_output(F.col("t")).alias("o")).collect()]
    assert got[0] == {"line": 12, "signals": "a, b", "reason": "has DIFF", "diff": "@@ x"}
    assert got[1] == {"line": None, "signals": "", "reason": "", "diff": None} and got[3]["line"] == 3


def test_balance_against_plain_loops(spark):
    rng = random.Random(1)
    rows = [(f"g{i:02d}", float(rng.randint(1, 9)), i % 2) for i in range(40)]
    got = {(r["plan"], r["group"]): r["shard"] for r in facts.balance(spark.createDataFrame(rows, "group string, weight double, plan int"), 5, by=["plan"]).collect()}
    want = {}
    for plan in (0, 1):
        load = [0.0] * 5
        for g, w, _ in sorted((r for r in rows if r[2] == plan), key=lambda r: (-r[1], r[0])):
            k = load.index(min(load))
            load[k] += w
            want[plan, g] = k
    assert got == want


def test_arbitration_scores(spark):
    rows = [("a", True, 2, 1), ("a", True, 4, 2), ("a", False, 0, 3), ("a", None, None, 4), ("b", False, 0, 1)]
    got = {(r["k"], r["o"]): (r["score"], r["rank"]) for r in facts.arbitrate(spark.createDataFrame(rows, "k string, ok boolean, n int, o int"), ["k"], passed="ok", lines="n", order=["o"]).collect()}
    assert got == {("a", 1): (0.85, 1), ("a", 2): (0.7, 2), ("a", 3): (0.3, 3), ("a", 4): (0.3, 4), ("b", 1): (0.3, 1)}


def test_waiting_needs_a_known_ready(spark):
    rows = [(1, c, v, r) for c, (v, r) in enumerate([(0, None), (1, None), (1, 0), (1, 0), (1, 1), (0, 1)])]
    df = spark.createDataFrame(rows, "trace_id int, cycle long, valid int, ready int")
    got = trace.handshake_features(df, spark.createDataFrame([(1, 3)], "trace_id int, anchor long")).first().asDict()
    assert (got["wait_cycles"], got["hold_cycles"], got["first_valid_rise"], got["first_ready"], got["deassert_seen"]) == (2, 1, 1, 4, True)


def test_pieces_of_a_trace_give_its_cycles(spark):
    rng = random.Random(3)
    rows = [(t, i, rng.randint(0, 300), rng.choice("ce"), "1") for t, i in itertools.product(range(4), range(60))]
    df = spark.createDataFrame(rows, "trace_id int, pos long, ts long, sig string, val string")
    edge = F.col("sig") == "c"
    key = lambda d: sorted(map(tuple, d.collect()))
    for span in (1, 50, 10_000):
        assert key(trace.with_cycles(df, edge, span=span).select("trace_id", "pos", "cycle")) == key(trace.with_cycles(df, edge).select("trace_id", "pos", "cycle"))
        assert key(trace.cycle_starts(df, edge, span=span)) == key(trace.cycle_starts(df, edge))


def test_settings_and_unknown_ones(spark):
    df = spark.createDataFrame([("B", "doc"), ("B", None)], "s string, d string")
    assert [r[0] for r in df.select(evidence.setting_view(F.col("s"), {"document": F.col("d")})).collect()] == ["doc", "(missing)"]
    with pytest.raises(Exception, match="no such setting"):
        spark.createDataFrame([("Q", "doc")], "s string, d string").select(evidence.setting_view(F.col("s"), {"document": F.col("d")})).collect()


def test_labels_never_pass(spark):
    df = spark.createDataFrame([(1, 2, "x")], "sample int, inject_line int, diff string")
    assert evidence.without_labels(df).columns == ["sample"]


def test_holm_against_plain_loops(spark):
    from faultloom.functions import stats

    rng = random.Random(2)
    rows = [(k % 3, k, rng.choice([0.0, 1.0, rng.random(), rng.random() / 100])) for k in range(120)]
    df = spark.createDataFrame([*rows, (0, 999, None)], "g int, k int, p double")
    for partition in (None, ["g"]):
        want = {}
        for g in {0} if partition is None else {0, 1, 2}:
            mine = sorted((p, k) for q, k, p in rows if partition is None or q == g)
            top = 0.0
            for r, (p, k) in enumerate(mine):
                top = max(top, p * (len(mine) - r))
                want[k] = min(1.0, top)
        got = {r["k"]: r["p_holm"] for r in stats.holm(df, partition=partition, order=["k"], piece=7).collect()}
        assert got.pop(999) is None and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
