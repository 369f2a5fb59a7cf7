"""Text, code and evidence operators bound to small sources that are made of each document's number.

A template's ``{k}`` is the number modulo k, in Spark and in SQL alike, so that SQL can tell what each operator
must find in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import registration
from ..functions import text as X
from ..operators import evidence as E
from ..operators import facts as A
from ..operators import nesting, patches, ranges
from ..operators import trace as T
from ..session import read_table, settled
from ..sources import logs as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def filled(template: str) -> Column:
    """The template as a column over doc_id."""
    parts = re.split(r"\{(\d+)\}", template)
    return F.concat(*[(F.col("doc_id") % int(p)).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def sql(template: str) -> str:
    """The template as an SQL expression over doc_id."""
    parts = re.split(r"\{(\d+)\}", template)
    quoted = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(f"CAST(doc_id % {p} AS VARCHAR)" if i % 2 else quoted(p) for i, p in enumerate(parts))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id")


def made(spark: SparkSession, sf_dir: str, **templates: str) -> DataFrame:
    return numbers(spark, sf_dir).select("doc_id", *[filled(t).alias(n) for n, t in templates.items()])


def lines_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").alias("trace_id"), F.posexplode(F.split("source", "\n", -1)).alias("pos", "line"))


DESIGN = """module m{7} #(parameter DATA_W = 8) (
  input clk{2}, input [3:0] a{5},
  output reg b{3}
);
// leak note {9}
always @(posedge clk{2}) begin
  if (a{5} == {4}) begin
    state <= S{3};
  end
end
assign y{5} = a{5};
// leak again
// inline checks
assert (b{3} >= {9});
endmodule"""
FROM = "FROM documents"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) END AS found {FROM}""")
def c2_trigger_condition(spark, sf_dir):
    line = F.element_at(F.array(F.lit(12), F.lit(15), F.lit(2)), (F.col("doc_id") % 3 + 1).cast("int"))
    return made(spark, sf_dir, source=DESIGN).select("doc_id", X.trigger_condition(F.col("source"), line).alias("found"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(['a' || CAST(doc_id % 5 AS VARCHAR), 'b' || CAST(doc_id % 3 AS VARCHAR), 'state', 'y'])), ',') AS cone {FROM}")
def c5_fault_cone(spark, sf_dir):
    df = made(spark, sf_dir, trigger="a{5} + OP_{3}", code="b{3} <= y + A{2}")
    keys, there = F.array(F.lit("state"), F.lit("cnt")), F.array(F.lit("state"), F.lit("IDLE"))
    return df.select("doc_id", F.array_join(X.fault_cone(F.col("trigger"), F.col("code"), keys, there, ["OP_", "A", "IDLE"]), ",").alias("cone"))


#: Blocks of real lines: one begins with a capital letter, articles open and "of" and "in" close.
_ARTICLE, _CLOSER, _HEAD = "(^| )(the|la|die|el)( |$)", "(^| )(of|de|und|en|in)( |$)", "^[A-Z]"
_LINES = f"""WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, trim(unnest(parts)) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    s AS (SELECT *, len(regexp_extract_all(line, '{_ARTICLE}')) - len(regexp_extract_all(line, '{_CLOSER}')) AS step, regexp_matches(line, '{_HEAD}') AS head FROM l),
    d AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM s),
    h AS (SELECT *, depth - step - CASE WHEN step = 0 AND contains(line, 'the') THEN 1 ELSE 0 END AS bound FROM d WHERE head),
    e AS (SELECT h.doc_id, h.pos AS start, min(d.pos) AS stop FROM h LEFT JOIN d ON d.doc_id = h.doc_id AND d.pos >= h.pos AND d.depth <= h.bound GROUP BY 1, 2),
    k AS (SELECT *, max(coalesce(stop, 1000000000000)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    b AS (SELECT doc_id AS trace_id, start, stop FROM k WHERE stop IS NOT NULL AND (reach IS NULL OR reach < start))"""


def document_lines(spark, sf_dir):
    return lines_of(read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source")))


def document_blocks(lines):
    return nesting.blocks(lines, head=_HEAD, opens=_ARTICLE, closes=_CLOSER, open_text="the")


@query(_LINES + " SELECT trace_id, start, stop FROM b")
def c6_blocks(spark, sf_dir):
    return document_blocks(document_lines(spark, sf_dir))


@query(_LINES + " SELECT trace_id, start, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM b JOIN l ON l.doc_id = trace_id AND pos BETWEEN start AND stop GROUP BY 1, 2")
def j12_lines_in_blocks(spark, sf_dir):
    """The lines that each block holds: an interval join of two tables, lines and blocks."""
    lines = document_lines(spark, sf_dir)
    spans = document_blocks(lines).withColumn("end", F.col("stop") + 1)
    held = ranges.interval_join(lines.select("trace_id", "pos", F.length(F.trim("line")).alias("size")), spans, keys=["trace_id"], at="pos", start="start", stop="end")
    return held.groupBy("trace_id", "start").agg(F.count(F.lit(1)).alias("lines"), F.sum("size").cast("long").alias("chars"))


@query(f"SELECT doc_id AS trace_id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 10 END AS start, round(20 + 5 * (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) + 0.1 * (CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END), 6) AS score {FROM}")
def c7_j12_best_block(spark, sf_dir):
    spans = nesting.blocks(lines_of(made(spark, sf_dir, source=DESIGN)))
    first = F.col("start") == 5
    sigs = F.when(first, F.array(F.lit("a"), F.lit("b"), F.lit("s"))).otherwise(F.array(F.lit("a"), F.lit("y")))
    wanted = F.array(F.lit("a"), F.when(F.col("trace_id") % 2 == 0, "b").otherwise("q"))
    line = F.when(F.col("trace_id") % 2 == 0, 7).otherwise(10)
    scored = spans.select("*", line.alias("line"), sigs.alias("signals"), wanted.alias("wanted"), F.lit(False).alias("has_assert"))
    return X.best_block(scored).select("trace_id", F.col("start").cast("int").alias("start"), F.round("score", 6).alias("score"))


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' || CAST(doc_id % 5 AS VARCHAR) WHEN 1 THEN 'b' || CAST(doc_id % 3 AS VARCHAR) ELSE
    array_to_string(list_sort(list_distinct(['leak', 'again', 'inline', 'checks', 'assert', 'b' || CAST(doc_id % 3 AS VARCHAR), 'endmodule'])), ',') END AS sigs {FROM}""")
def c8_asserted_signals(spark, sf_dir):
    k = F.col("doc_id") % 3
    df = made(spark, sf_dir, source=DESIGN, a="a{5}", b="  3: b{3}")
    found = X.asserted_signals(F.when(k == 0, F.col("a")), F.when(k == 1, F.col("b")).otherwise(""), F.col("source"), F.lit(12))
    stop = F.array(*[F.lit(x) for x in ("y0", "y1", "y2", "y3", "y4")])
    return df.select("doc_id", F.array_join(F.array_except(found, stop), ",").alias("sigs"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'a' END AS cone, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'b' END AS silent, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS ratio {FROM}")
def c9_dynamic_cone(spark, sf_dir):
    array = lambda *xs: F.array(*[F.lit(x) for x in xs])
    flipped = F.when(F.col("doc_id") % 2 == 0, array("b", "a", "z")).otherwise(array("a"))
    out = numbers(spark, sf_dir).select("doc_id", X.dynamic_cone(array("b", "a"), flipped, array("a", "b"), F.lit(4)).alias("c"))
    return out.select("doc_id", F.array_join("c.dynamic_cone", ",").alias("cone"), F.array_join("c.silent_signals", ",").alias("silent"), F.col("c.reduction_ratio").alias("ratio"))


@query(f"SELECT doc_id, 'clk' || CAST(doc_id % 2 AS VARCHAR) || ',clk,ACLK,CLK,clock,aclk' AS names {FROM}")
def c10_clock_candidates(spark, sf_dir):
    return made(spark, sf_dir, source=DESIGN).select("doc_id", F.array_join(X.clock_candidates(F.col("source")), ",").alias("names"))


@query(f"SELECT doc_id, 'assert (b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) || ');' AS section, '  14: assert (b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) || ');' AS lines {FROM}")
def c11_inline_assertions(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN)
    return df.select("doc_id", X.inline_assertions(F.col("source"), "inline checks").alias("section"), X.inline_assertions(F.col("source"), "no such mark").alias("lines"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN CAST(doc_id % 90 AS INT) END AS line, CASE WHEN doc_id % 4 <> 1 THEN 'a, b' || CAST(doc_id % 3 AS VARCHAR) ELSE '' END AS signals,
    CASE WHEN doc_id % 4 <> 1 THEN 'it has DIFF in it' ELSE '' END AS reason, CASE WHEN doc_id % 4 < 2 THEN '@@ -1 +1 @@' || chr(10) || '-x' || chr(10) || '+y' END AS diff {FROM}""")
def c12_parse_output(spark, sf_dir):
    body = "###LOCATE###\nline: {90}\nsignals： a, b{3} \nreason: it has DIFF in it\n"
    diff = "###DIFF###\n@@ -1 +1 @@\n-x\n+y\n"
    df = made(spark, sf_dir, body=f"<think>line: 5 ###DIFF### no</think>{body}", own="<thought>###LOCATE### line: 7</thought>plain ")
    k = F.col("doc_id") % 4
    text = F.concat(F.when(k == 1, F.col("own")).otherwise(F.col("body")), F.when(k < 2, diff).otherwise(""))
    return df.select("doc_id", X.parse_output(text).alias("o")).select("doc_id", "o.*")


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{"a": ' || CAST(doc_id % 9 AS VARCHAR) || '}}' WHEN 1 THEN '{{"a": {{"b": ' || CAST(doc_id % 9 AS VARCHAR) || '}}}}' WHEN 2 THEN '{{"a": 1, "s": {{}}}}' END AS salvaged,
    CASE doc_id % 4 WHEN 0 THEN '{{"a": ' || CAST(doc_id % 9 AS VARCHAR) || '}}' WHEN 2 THEN NULL END AS whole {FROM}""")
def c13_c14_json(spark, sf_dir):
    df = made(spark, sf_dir, a='<think>{"x": 1}</think>```json\n{"a": {9}}\n``` end', b='{"a": {"b": {9}}', c='text {"a": 1, "s": {}, "cut": "', d="no object")
    text = F.element_at(F.array("a", "b", "c", "d"), (F.col("doc_id") % 4 + 1).cast("int"))
    plain = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    return df.select("doc_id", X.salvage_json(text).alias("salvaged"), X.balanced_json(plain).alias("whole"))


DIFF = "--- a\n+++ b\n@@ -6,4 +6,5 @@\n always @(posedge clk{2}) begin\n-  if (a{5} == {4}) begin\n+  if (a{5} != {4}) begin\n+\n     state <= S{3};\n@@ -14 +15 @@\n-assert (b{3} >= {9});\n+assert (b{3} > {9});\n"


@query(f"SELECT doc_id, 2 AS hunks, 6 AS old1, 15 AS new2, '  if (a' || CAST(doc_id % 5 AS VARCHAR) || ' != ' || CAST(doc_id % 4 AS VARCHAR) || ') begin|' AS added1, 'assert (b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) || ');' AS deleted2 {FROM}")
def c15_parse_diff(spark, sf_dir):
    h = made(spark, sf_dir, diff=DIFF).select("doc_id", X.parse_diff("diff").alias("h"))
    return h.select(
        "doc_id", F.size("h").alias("hunks"), F.col("h")[0]["old"].alias("old1"), F.col("h")[1]["new"].alias("new2"),
        F.array_join(F.col("h")[0]["added"], "|").alias("added1"), F.array_join(F.col("h")[1]["deleted"], "|").alias("deleted2"),
    )


def _after(template: str) -> str:
    t = template.replace("  if (a{5} == {4}) begin\n", "  if (a{5} != {4}) begin\n\n")
    return t.replace("assert (b{3} >= {9});", "assert (b{3} > {9});")


_INDENTED = DESIGN.replace("\n  if", "\n      if").replace("    state <= S{3};", "    state <=   S{3};")
_CHANGED = _after(DESIGN).replace("  if (a{5} != {4}) begin\n", "always_x")


@query(f"SELECT doc_id, sha256({sql(_after(DESIGN))}) AS exact, CASE WHEN doc_id % 2 = 0 THEN sha256({sql(DESIGN)}) END AS insertion, CAST(NULL AS VARCHAR) AS lost {FROM}")
def c16_apply_diff(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN, diff=DIFF, insertion="@@ -2,0 +3 @@\n+new line\n", lost="@@ -1 +1 @@\n-not in it {3}\n+x\n")
    even = F.when(F.col("doc_id") % 2 == 0, F.col("insertion"))
    named = {"exact": "diff", "lost": "lost"}
    out = df.select("doc_id", *[F.sha2(X.patched("source", c), 256).alias(n) for n, c in named.items()], X.patched(F.col("source"), even).alias("i"))
    return out.select("doc_id", "exact", F.sha2("i", 256).alias("insertion"), "lost")


@query(f"SELECT doc_id, 3 AS units, sha256({sql(DIFF.split('@@ -14')[0].removeprefix(chr(45) * 3 + ' a' + chr(10) + '+++ b' + chr(10)))}) AS rest {FROM}")
def c18_diff_units(spark, sf_dir):
    """Units of the diff, and the diff without the last of them."""

    @F.pandas_udf("units int, rest string")
    def run(diffs):
        import pandas as pd

        parsed = [X.diff_units(d) for d in diffs]
        return pd.DataFrame({"units": [len({u for _, ls in p for u, _ in ls if u is not None}) + 1 for p in parsed], "rest": [X.rebuild_diff(p, {1}) for p in parsed]})

    out = made(spark, sf_dir, diff=DIFF).select("doc_id", run("diff").alias("r"))
    return out.select("doc_id", "r.units", F.sha2("r.rest", 256).alias("rest"))


@query(f"SELECT doc_id, '7,8,15' AS changed, CASE WHEN doc_id % 2 = 0 THEN '5' ELSE '' END AS deleted, '' AS in_header {FROM}")
def c19_truth_lines(spark, sf_dir):
    df = made(spark, sf_dir, golden=DESIGN, buggy=_after(DESIGN), shorter=DESIGN.replace("  if (a{5} == {4}) begin\n", ""), head="// by {9}\n" + DESIGN)
    join = lambda a, b: F.array_join(X.ground_truth(a, b).cast("array<string>"), ",")
    gone = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("golden", "(?m)^always.*\n", "")).otherwise(F.col("golden"))
    return df.select("doc_id", join("golden", "buggy").alias("changed"), join(F.col("golden"), gone).alias("deleted"), join("golden", "head").alias("in_header"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '8' ELSE '' END AS lines {FROM}")
def c20_content_matches(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN, a="- old\n+ state   <= S{3}; \n+ x", b="+ end")
    diff = F.when(F.col("doc_id") % 2 == 0, F.col("a")).otherwise(F.col("b"))
    return df.select("doc_id", F.array_join(X.content_matches(diff, F.col("source")).cast("array<string>"), ",").alias("lines"))


_LINT = "assert property (x);\n  // assert property (y);\n * real z;\n/* time */ real\nreal a{5}; ##{3} b\na |-> b until c\nx$past(y) $past(z)\nrealtime t; time u; within"


@query(f"""SELECT doc_id AS trace_id, pos, rule FROM (SELECT doc_id, unnest([0, 4, 4, 5, 5, 6, 7, 7, 7]) AS pos,
    unnest(['assert_property', 'delay', 'real', 'implication', 'until', 'past', 'within', 'time', 'realtime']) AS rule {FROM})""")
def c21_rtl_lint(spark, sf_dir):
    return X.lint(lines_of(made(spark, sf_dir, source=_LINT)))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 END AS hunks, CASE WHEN doc_id % 3 <> 2 THEN least(abs(doc_id % 20 - 6), abs(doc_id % 20 - 15)) END AS loc_dev, true AS interface_ok,
    doc_id % 3 = 2 AS assertion_ok, doc_id % 3 <> 1 AS loop_ok, doc_id % 3 = 2 AS t2_pass {FROM}""")
def c23_patch_audit(spark, sf_dir):
    k = F.col("doc_id") % 3
    df = made(spark, sf_dir, diff=DIFF, a="A{5}")
    rows = df.select(
        "doc_id", F.when(k != 2, F.col("diff")).alias("diff_text"), (F.col("doc_id") % 20).alias("loc_line"), F.when(k == 0, F.col("a")).otherwise("none").alias("signals"),
        F.array(F.lit("other")).alias("fault_cone"),
    )
    return E.audit_patch(rows).drop("hunk_locs", "changed_sigs")


_ASSERT = "'assert (b' || CAST(doc_id % 3 AS VARCHAR) || ' {op} ' || CAST(doc_id % 9 AS VARCHAR) || ');'"


@query(f"""SELECT doc_id, 14 AS line, unnest(['delete', '>=']) AS old, unnest(['comment_out', '<']) AS new, unnest(['// [mutation-delete] ' || {_ASSERT.format(op=">=")}, {_ASSERT.format(op="<")}]) AS mutated_line {FROM}
    UNION ALL SELECT doc_id, 14, '>=', ['>', '<', '==', '!='][17 % 4 + 1], replace({_ASSERT.format(op=">=")}, '>=', ['>', '<', '==', '!='][17 % 4 + 1]) {FROM}""")
def c24_mutations(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN)
    both = K.explode_mutations(df, "doc_id", strong=True, higher=("delete", "const")).unionByName(K.explode_mutations(df, "doc_id"))
    return both.drop("mutated_source")


@query(f"""SELECT doc_id, 'jump' AS variant, 8 AS line, sha256({sql(DESIGN.replace("state <= S{3};", "state <= S9;"))}) AS digest {FROM}
    UNION ALL SELECT doc_id, 'no_assign', 11, sha256({sql(DESIGN.replace("assign y{5} = a{5};" + chr(10), ""))}) {FROM}""")
def c25_injected_faults(spark, sf_dir):
    variants = spark.createDataFrame([("jump", r"state <= S\d;", "state <= S9;"), ("no_assign", r"assign y\d = .*;\n", None), ("never", "no match", "x")], "variant string, pattern string, replacement string")
    out = K.inject_variants(made(spark, sf_dir, source=DESIGN), variants, "doc_id")
    return out.select("doc_id", "variant", "line", F.sha2("text", 256).alias("digest"))


_BLOCKS = ("// leak note {9}\nalways @(posedge clk{2}) begin\n  if (a{5} == {4}) begin\n    state <= S{3};\n  end\nend\n", "  if (a{5} == {4}) begin\n    state <= S{3};\n  end\n")


@query(f"SELECT doc_id, sha256({sql(DESIGN.replace(_BLOCKS[0], ''))}) AS block, sha256({sql(DESIGN.replace(_BLOCKS[1], ''))}) AS branch, sha256({sql(DESIGN.replace('state <= ', 'next <= '))}) AS jump, CAST(NULL AS VARCHAR) AS none {FROM}")
def c26_structural_templates(spark, sf_dir):
    df, source = made(spark, sf_dir, source=DESIGN), F.col("source")
    arguments = {"block": ("remove_block", "always @"), "branch": ("remove_branch", "if (a"), "jump": ("rewrite_jump", "state <= ", "next <= "), "none": ("remove_guard", "timeout")}
    return df.select("doc_id", *[F.sha2(K.rewritten(source, *a), 256).alias(n) for n, a in arguments.items()])


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256({sql(DESIGN.replace("a{5} == {4}", "a{5} >= {4}"))}) WHEN 1 THEN sha256({sql(DESIGN.replace("state <= S{3};", "state <= S7;"))}) END AS digest {FROM}""")
def c27_assembled_patch(spark, sf_dir):
    df = made(
        spark, sf_dir, source=DESIGN, a='{"action": "edit_assign", "params": {"original": "a{5}=={4}", "fixed": "a{5} >= {4}", "condition": "a{5} == {4}"}}',
        b='{"action": "split_state", "params": {"from": "S{3}", "to": "S7"}}', c='{"action": "edit_assign", "params": {"original": "nowhere", "fixed": "x"}}',
    )
    intent = F.element_at(F.array("a", "b", "c"), (F.col("doc_id") % 3 + 1).cast("int"))
    return df.select("doc_id", F.sha2(K.assembled(F.col("source"), intent), 256).alias("digest"))


@query(f"SELECT doc_id, '   1: a' || CAST(doc_id % 5 AS VARCHAR) || chr(10) || '   2: ' || chr(10) || '   3: c' AS numbered, '@@ -1 +1 @@' || chr(10) || '-a' || CAST(doc_id % 5 AS VARCHAR) || chr(10) || '+b' || chr(10) || ' 12: c' AS bare {FROM}")
def c28_line_numbers(spark, sf_dir):
    df = made(spark, sf_dir, source="a{5}\n\nc", diff="@@ -1 +1 @@\n-   7: a{5}\n+   7: b\n 12: c")
    return df.select("doc_id", X.number_lines(F.col("source")).alias("numbered"), X.denumber_diff(F.col("diff")).alias("bare"))


_PROMPT = "Fix it.\n\n[design]\nd{5}\n[end of design]\n\n[assertions]\nassert\n[end of assertions]\n\n[evidence]\ne{3}\n[end of evidence]\n\nerror_type=t{2} module=?"
_TRIED = "\n\n[earlier attempts]\n- attempt 1 failed\n  diff: x\n  failure: bad\n- attempt 2 failed\n  failure: ?\nDo not repeat them."


@query(f"SELECT doc_id, sha256({sql(_PROMPT)} || CASE WHEN doc_id % 2 = 0 THEN {sql(_TRIED)} ELSE '' END || chr(10) || chr(10) || 'Answer.') AS digest {FROM}")
def c29_prompt(spark, sf_dir):
    df = made(spark, sf_dir, d="d{5}", e="e{3}", t="t{2}")
    tried = F.array(*[F.struct(F.lit(n).alias("attempt"), F.lit(d).alias("diff"), F.lit(f).cast("string").alias("failure")) for n, d, f in ((1, "x", "bad"), (2, "", None))])
    history = F.when(F.col("doc_id") % 2 == 0, tried).otherwise(F.slice(tried, 1, 0))
    text = E.prompt(F.col("d"), F.lit("assert"), F.col("e"), F.col("t"), F.lit(None).cast("string"), history, task="Fix it.", answer="Answer.")
    return df.select("doc_id", F.sha2(text, 256).alias("digest"))


_PAPER = r"\label{a}\label{b}\label{a} \ref{b}\eqref{c{3}} \cite{k1, k{5}}\citep{k2} \bibitem{k1}\bibitem{k2}\bibitem{u{4}}"


@query(f"""SELECT doc_id AS paper, unnest(['duplicate label', 'reference', 'uncited']) AS problem, unnest(['a', 'c' || CAST(doc_id % 3 AS VARCHAR), 'u' || CAST(doc_id % 4 AS VARCHAR)]) AS name {FROM}
    UNION ALL SELECT doc_id, 'citation', 'k' || CAST(doc_id % 5 AS VARCHAR) {FROM} WHERE doc_id % 5 NOT IN (1, 2)""")
def c30_cross_references(spark, sf_dir):
    return E.cross_references(made(spark, sf_dir, text=_PAPER).withColumnRenamed("doc_id", "paper"))


@query(f"""SELECT doc_id AS trace_id, pos, CASE pos WHEN 4 THEN '// one' WHEN 11 THEN '   // more' ELSE line END AS line FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line
    FROM (SELECT doc_id, string_split({sql(DESIGN.replace("// leak again", "   // leak again"))}, chr(10)) AS p {FROM}))""")
def p7_sanitised_comments(spark, sf_dir):
    return X.sanitise(lines_of(made(spark, sf_dir, source=DESIGN.replace("// leak again", "   // leak again"))), ["leak"], " one", " more")


@query(f"""SELECT doc_id AS trace_id, 14 AS first_assert, '14' AS assert_lines, CASE WHEN doc_id % 2 = 0 THEN 11 WHEN doc_id % 4 = 1 THEN 6 END AS first_signal {FROM}""")
def st10_locators(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN, y="y{5}", clk="clk{2}")
    k = F.col("doc_id") % 4
    named = F.when(k % 2 == 0, F.array("y")).when(k == 1, F.array("clk")).otherwise(F.array().cast("array<string>"))
    out = X.locators(lines_of(df), df.select(F.col("doc_id").alias("trace_id"), named.alias("signals")))
    return out.withColumn("assert_lines", F.array_join(F.col("assert_lines").cast("array<string>"), ","))


_LOG = "##  0:00:00  Checking assertions in step 3..\n##  0:00:00  Checking assertions in step {40}..\n##  Assert failed in m{7}: d.v:14.5-14.9 ($assert$d.v:14$1{9})\n##  BMC failed!\n##  at step 99"


@query(f"SELECT doc_id, CAST(greatest(3, doc_id % 40) AS INT) AS max_step, '##  Assert failed in m' || CAST(doc_id % 7 AS VARCHAR) || ': d.v:14.5-14.9 ($assert$d.v:14$1' || CAST(doc_id % 9 AS VARCHAR) || ')' AS last_assert, CAST(greatest(3, doc_id % 40) AS INT) AS step, 99 AS at_step {FROM}")
def sc4_fail_steps(spark, sf_dir):
    df = made(spark, sf_dir, log=_LOG)
    return df.select("doc_id", X_steps(F.col("log"))["max_step"].alias("max_step"), X_steps(F.col("log"))["last_assert"].alias("last_assert"), L.fail_step(F.col("log")).alias("step"), L.fail_step(F.substring_index("log", "\n", -1)).alias("at_step"))


X_steps = L.fail_steps


@query(f"SELECT 's' || lpad(CAST(doc_id % 37 AS VARCHAR), 2, '0') AS sample, unnest(['verify', 'golden']) AS kind, unnest([sum(doc_id % 9 + 0.5), CAST(count(*) * 2 AS DOUBLE)]) AS seconds {FROM} GROUP BY 1")
def sc5_task_timing(spark, sf_dir):
    sample = F.format_string("s%02d", F.col("doc_id") % 37)
    df = made(spark, sf_dir, n="{9}")
    text = F.concat(F.lit("[1/68] "), sample, F.lit(" verify: DONE (FAIL, rc=2) ("), "n", F.lit(".5s)\nnoise 3 s\n[2/68] "), sample, F.lit(" golden: DONE (PASS, rc=0) (2s)"))
    return L.task_timing(df.select(text.alias("text")))


@query(f"""SELECT doc_id AS trace_id, unnest(['clk' || CAST(doc_id % 2 AS VARCHAR), 'a' || CAST(doc_id % 5 AS VARCHAR), 'b' || CAST(doc_id % 3 AS VARCHAR)]) AS name, unnest(['input', 'input', 'output']) AS direction {FROM}""")
def sc13_ports(spark, sf_dir):
    return L.ports(lines_of(made(spark, sf_dir, source=DESIGN)))


@query(f"SELECT doc_id, 'm' || CAST(doc_id % 7 AS VARCHAR) AS name, 'parameter DATA_W = 8' AS params, CAST(doc_id % 50 AS INT) AS depth {FROM}")
def sc14_sc15_headers(spark, sf_dir):
    df = made(spark, sf_dir, source=DESIGN, config="[tasks]\nbmc: depth {50}\nprove: depth 7")
    h = L.module_header(F.col("source"))
    return df.select("doc_id", h["name"].alias("name"), h["params"].alias("params"), L.bmc_depth(F.col("config")).alias("depth"))


@query(f"SELECT doc_id % 400 AS sample, unnest(['design.v', 'tb.v']) AS file {FROM} GROUP BY 1 HAVING bool_and(doc_id % 3 <> 0) UNION ALL SELECT doc_id % 400, 'tb.v' {FROM} GROUP BY 1 HAVING bool_or(doc_id % 3 = 0)")
def sc12_j10_missing_files(spark, sf_dir):
    """Samples that must have two files; those with a document whose number 3 divides have the first."""
    df = numbers(spark, sf_dir).withColumn("sample", F.col("doc_id") % 400)
    need = df.select("sample").distinct().withColumn("file", F.explode(F.array(F.lit("design.v"), F.lit("tb.v"))))
    have = df.where("doc_id % 3 = 0").select("sample", F.lit("design.v").alias("file"))
    return A.unresolved(need, have, ["sample", "file"])


@query(f"SELECT doc_id % 50 AS sample, CASE WHEN doc_id % 50 < 10 THEN 'buggy.sv' WHEN doc_id % 50 < 20 THEN 'buggy.v' ELSE 'aaa.v' END AS file {FROM} GROUP BY ALL")
def sc12_design_file(spark, sf_dir):
    names = ["tb_x.v", "golden.v", "aaa.v", "zzz.sv", "formal_top.sv", "notes.txt"]
    s = F.col("sample")
    more = F.array_compact(F.array(F.when(s < 10, "buggy.sv"), F.when(s < 20, "buggy.v"), *[F.lit(n) for n in names]))
    files = numbers(spark, sf_dir).select((F.col("doc_id") % 50).alias("sample")).distinct().withColumn("file", F.explode(more))
    return L.design_file(files)


_FAILED = "##  Assert failed in m{7}: d.v:14.5-14.9 ($assert$d.v:14$1{9})\n##  Checking assertions in step {40}..\n##  BMC failed!"


@query(f"""SELECT doc_id AS sample_id, 'v1.0' AS schema_ver, 'm' || CAST(doc_id % 7 AS VARCHAR) AS module, 14 AS line, 'b' || CAST(doc_id % 3 AS VARCHAR) || ' >= ' || CAST(doc_id % 9 AS VARCHAR) AS trigger_condition,
    'bmc_depth_' || CAST(doc_id % 40 AS VARCHAR) AS fail_stage, CAST(doc_id % 40 AS INT) AS fail_step, '1' || CAST(doc_id % 9 AS VARCHAR) AS failed_assert_id, doc_id % 2 = 0 AS x_state_warn, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS x_count,
    'clk' || CAST(doc_id % 2 AS VARCHAR) || '=input' AS clk, '  10: end' AS first_line {FROM}""")
def p1_evidence(spark, sf_dir):
    df = made(spark, sf_dir, design=DESIGN, log=_FAILED).withColumnRenamed("doc_id", "sample_id")
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    samples = df.select("sample_id", "log", "design", F.lit("buggy.v").alias("file"), none("error_type", "string"), none("inject_line", "int"), none("inject_desc", "string"), F.lit("other").alias("module"), F.lit("cex.vcd").alias("trace_ref"))
    ports = L.ports(lines_of(made(spark, sf_dir, source=DESIGN))).withColumnRenamed("trace_id", "sample_id")
    unknown = numbers(spark, sf_dir).where("doc_id % 2 = 0").select(F.col("doc_id").alias("sample_id"), F.lit(3).cast("long").alias("x_count"), F.array(F.lit("q")).alias("x_signals"))
    e = E.evidence(samples, ports, unknown)
    clk = F.concat(F.lit("clk"), (F.col("sample_id") % 2).cast("string"))
    return e.select(
        "sample_id", "schema_ver", "module", "line", "trigger_condition", "fail_stage", "fail_step", "failed_assert_id", "x_state_warn", F.col("x_state.count").alias("x_count"),
        F.concat_ws("=", clk, F.try_element_at("signals", clk)).alias("clk"), F.substring_index("code_slice", "\n", 1).alias("first_line"),
    )


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[cex.log]' || chr(10) || 'log' || chr(10) || '[cex.vcd]' || chr(10) || 'd' || CAST(doc_id % 5 AS VARCHAR) WHEN 1 THEN 'doc' || CAST(doc_id % 4 AS VARCHAR) ELSE
    'doc' || CAST(doc_id % 4 AS VARCHAR) || chr(10) || chr(10) || '[trace analysis]' || chr(10) || 'first_anomaly_cycle=' || CAST(doc_id % 9 AS VARCHAR) || ' | cycles_compared=7 | key_signal_diffs=["a"] | stuck_signals=[]' END AS shown {FROM}""")
def p9_setting_views(spark, sf_dir):
    df = made(spark, sf_dir, d="d{5}", doc="doc{4}")
    strings = F.array().cast("array<string>")
    analysis = F.struct((F.col("doc_id") % 9).alias("first_anomaly_cycle"), F.lit(7).alias("cycles_compared"), F.array(F.lit("a")).alias("key_signal_diffs"), strings.alias("stuck_signals"))
    views = {"raw": E.view_raw(F.lit("log"), F.col("d")), "document": F.col("doc"), "analysis": E.view_analysis(F.col("doc"), analysis)}
    setting = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("BT")), (F.col("doc_id") % 3 + 1).cast("int"))
    return df.select("doc_id", E.setting_view(setting, views).alias("shown"))


@query(f"""SELECT doc_id, '[dynamic slice] fail step: ' || CAST(doc_id % 40 AS VARCHAR) || ', asserted: a, b' || chr(10) || '[flipped: 2]' || chr(10) || '  - a' || chr(10) || '  - b' || chr(10) ||
    CASE WHEN doc_id % 2 = 0 THEN '[silent: 1]' || chr(10) || '  - s' || chr(10) ELSE '' END || 'static 4 -> dynamic 2 (50%)' || chr(10) || '[values]' || chr(10) || '  cyc3: a=1, b=0' || chr(10) || 'trigger: ?' || chr(10) || 'error type: t' AS shown {FROM}""")
def p9_cone_view(spark, sf_dir):
    array = lambda *xs: F.array(*[F.lit(x) for x in xs])
    silent = F.when(F.col("doc_id") % 2 == 0, array("s")).otherwise(F.array().cast("array<string>"))
    cone = F.struct(
        (F.col("doc_id") % 40).alias("fail_step"), array("a", "b").alias("assert_signals"), array("a", "b").alias("dynamic_cone"), silent.alias("silent_signals"), F.lit(4).alias("static_cone_size"),
        F.lit(0.5).alias("reduction_ratio"), F.array(F.struct(F.lit(3).alias("cycle"), array("a=1", "b=0").alias("vals"))).alias("value_trace"),
    )
    return numbers(spark, sf_dir).select("doc_id", E.view_cone(cone, F.lit(None).cast("string"), F.lit("t")).alias("shown"))


@query(f"""SELECT doc_id, '[failed assertion]' || chr(10) || 'module=m' || CAST(doc_id % 7 AS VARCHAR) || ' | error_type=? | fail_stage=bmc | fail_step=' || CAST(doc_id % 40 AS VARCHAR) || chr(10) || '[causes]' || chr(10) || '- a' || chr(10) || '- b' || chr(10)
    || '[states]' || chr(10) || 'cyc5: {{"cycle":5,"a":"1"}}' || chr(10) || '[trigger]' || chr(10) || 'a == b' AS shown {FROM}""")
def p10_causal_view(spark, sf_dir):
    df = made(spark, sf_dir, m="m{7}")
    ev = F.struct(F.col("m").alias("module"), F.lit(None).cast("string").alias("error_type"), F.lit("bmc").alias("fail_stage"), (F.col("doc_id") % 40).alias("fail_step"), F.lit("a == b").alias("trigger_condition"))
    states = F.array(F.struct(F.lit(5).alias("cycle"), F.lit("1").alias("a")))
    return df.select("doc_id", E.view_causal(ev, F.array(F.lit("a"), F.lit("b")), states, F.lit(None).cast("string")).alias("shown"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '>' || repeat('x', 300) || '…' ELSE '>x' END AS short, CASE WHEN doc_id % 3 = 0 THEN 1 + 3 + 2 ELSE 5 END AS lines {FROM}")
def p8_head_and_tail(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.lit(" " + "x" * 400)).otherwise("x ")
    many = F.when(F.col("doc_id") % 3 == 0, F.lit("\n".join(map(str, range(50))))).otherwise("1\n2\n3\n4\n5")
    return numbers(spark, sf_dir).select("doc_id", F.concat(F.lit(">"), E.shortened(text)).alias("short"), F.size(F.split(E.head_and_tail(many, head=3, tail=2), "\n")).alias("lines"))


@query(f"SELECT doc_id, sha256({sql(_after(DESIGN))}) AS digest, 2 AS mutations {FROM}")
def u1_registered_functions(spark, sf_dir):
    """Registered functions called from SQL text."""
    registration.register(spark)
    made(spark, sf_dir, source=DESIGN, diff=DIFF).createOrReplaceTempView("faultloom_sources")
    calls = "SELECT doc_id, sha2(apply_diff(source, diff), 256) AS digest, size(parse_diff(diff)) AS mutations FROM faultloom_sources"
    return spark.sql(calls)


@query("""WITH l AS (SELECT doc_id, len(parts) AS n, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    u AS (SELECT doc_id, i * 5 // n AS unit, bool_or(contains(line, ' the ')) AS needed FROM l GROUP BY 1, 2)
    SELECT doc_id, count(*) AS units, count(*) FILTER (needed) AS kept FROM u GROUP BY 1""")
def c18_minimised_diffs(spark, sf_dir):
    """Each document as a diff that adds its lines in five units, reduced to those that are needed to keep all lines with an article."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("p"))
    part = lambda i: F.floor(i * 5 / F.size("p"))
    told = F.transform("p", lambda x, i: F.concat(F.when((i > 0) & (part(i) != part(i - 1)), F.lit(" .\n")).otherwise(""), F.lit("+"), F.regexp_replace(x, "\r", " ")))
    diffs = d.select("id", F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(told, "\n"), F.lit("\n")).alias("diff"))
    needed = lambda diff: F.size(F.filter(F.split(diff, "\n"), lambda x: F.contains(x, F.lit(" the "))))
    want = settled(diffs.select("id", needed("diff").alias("want")))

    def verdicts(trials):
        return trials.select("id", "trial", needed(F.col("diff")).alias("n")).join(want, "id").select("id", "trial", (F.col("n") == F.col("want")).alias("ok"))

    out = patches.minimised(diffs, verdicts, most=1000)
    return out.select(F.col("id").alias("doc_id"), "units", (F.col("units") - F.size("removed")).alias("kept"))


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'copyright') OR contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'http') AS hit FROM documents")
def p11_any_of(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.size(X.contains_any(F.coalesce("text", F.lit("")), ["copyright", "license", "http"])) > 0).alias("hit"))


@query("SELECT page_id, NOT (" + " OR ".join(f"contains(url, '{m}')" for m in ("anyinit_", "anyseq_", "smt_", "_auto_", "$", "\\", "procdff", "execute_", "setundef")) + ") AS real FROM pages")
def p12_real_names(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", T.is_real_signal(F.col("url")).alias("real"))


@query("SELECT o_custkey AS sample, array_to_string(list_sort(list_distinct(list(o_orderkey)))[1:5], ',') AS first FROM orders GROUP BY 1")
def t4_first_five(spark, sf_dir):
    """The first five order keys of each customer: ranked apart, so that no customer's keys are collected whole."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("key")).distinct()
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("key"))
    few = o.withColumn("rank", rank).where("rank <= 5").groupBy("sample").agg(F.sort_array(F.collect_list("key")).alias("k"))
    return few.select("sample", F.array_join(F.col("k").cast("array<string>"), ",").alias("first"))
