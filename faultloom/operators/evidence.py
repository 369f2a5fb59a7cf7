"""Evidence documents, the views of them that a setting shows, prompts and their history, and audits of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import logs as L

#: Fixed value: the schema's version.
SCHEMA_VERSION = "v1.0"
#: Columns that give away where a fault was put.
LABELS = [
    "inject_line", "inject_desc", "diff", "buggy_inject_line", "buggy_inject_lines", "gt_method", "gt_content_lines", "gt_updated_at",
]


def evidence(samples: DataFrame, ports: DataFrame, unknown: DataFrame) -> DataFrame:
    """One evidence document for each sample.

    samples: (sample_id, log, design, file, error_type, inject_line, inject_desc, module, trace_ref); ports: (sample_id,
    name, direction, first), see ``logs.ports``; unknown: (sample_id, x_count, x_signals), see ``trace.unknown_states``. A
    sample without ports or unknown values has none. The log's module counts before that of the sample.
    """
    declared = ports.groupBy("sample_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "direction")))).alias("signals"))
    rows = samples.withColumn("s", L.solver_log(F.col("log"))).join(declared, "sample_id", "left").join(unknown, "sample_id", "left")
    line = F.col("s.failed_line")
    count = F.coalesce("x_count", F.lit(0)).cast("long")
    names = F.coalesce("x_signals", F.array().cast("array<string>"))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_ver"), F.lit("sby_bmc").alias("evidence_source"), "sample_id", "error_type", "inject_line", "inject_desc",
        F.coalesce("s.module", "module").alias("module"), "file", line.alias("line"),
        F.when(line.isNotNull(), X.code_slice(F.col("design"), line)).otherwise("").alias("code_slice"),
        F.coalesce("signals", F.create_map().cast("map<string,string>")).alias("signals"),
        F.when(line.isNotNull(), X.trigger_condition(F.col("design"), line)).alias("trigger_condition"),
        "s.fail_stage", "s.fail_step", "s.failed_assert_id", (count > 0).alias("x_state_warn"),
        F.struct(count.alias("count"), names.alias("signals")).alias("x_state"), F.col("trace_ref").alias("raw_trace_ref"),
    )


def without_labels(documents: DataFrame) -> DataFrame:
    """Documents without the columns that give the fault away."""
    return documents.drop(*LABELS)


def as_json(document: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a row's columns as one JSON text."""
    return document.select(key, F.to_json(F.struct(*document.columns)).alias(name))


def head_and_tail(text: Column, *, head: int = 120, tail: int = 40, gap: str = "...") -> Column:
    """The first and last lines of a text of more lines than both."""
    lines = X.lines_of(text)
    ends = F.concat(F.slice(lines, 1, head), F.array(F.lit(gap)), F.slice(lines, -tail, tail))
    return F.array_join(F.when(F.size(lines) > head + tail, ends).otherwise(lines), "\n")


def shortened(text: Column, most: int = 300) -> Column:
    """A text of at most ``most`` characters and a mark if there was more."""
    plain = F.trim(text)
    return F.concat(F.substring(plain, 1, most), F.when(F.length(plain) > most, "…").otherwise(""))


def view_raw(log: Column, dump: Column) -> Column:
    """P9, setting A: the log as it is and the ends of the dump; what is missing is left out."""
    return F.concat_ws("\n", F.concat(F.lit("[cex.log]\n"), log), F.concat(F.lit("[cex.vcd]\n"), head_and_tail(dump)))


def view_analysis(document: Column, analysis: Column) -> Column:
    """P9, setting BT: the document and the findings of the trace analysis (first_anomaly_cycle, cycles_compared,
    key_signal_diffs, stuck_signals), cut to 20 and 10."""
    parts = [F.concat(F.lit(f"{c}="), analysis[c].cast("string")) for c in ("first_anomaly_cycle", "cycles_compared")]
    for c, most in (("key_signal_diffs", 20), ("stuck_signals", 10)):
        parts.append(F.concat(F.lit(f"{c}="), F.to_json(F.slice(F.coalesce(analysis[c], F.array()), 1, most))))
    return F.concat(document, F.lit("\n\n[trace analysis]\n"), F.concat_ws(" | ", *parts))


def view_handshakes(document: Column, features: Column, violations: Column) -> Column:
    """P9, setting BH: the document, each pair's features (an array of (pair, features as JSON)) and the broken rules."""
    told = F.transform(F.sort_array(features), lambda f: F.concat_ws(": ", f["pair"], f["json"]))
    broken = F.when(F.size(violations) > 0, F.concat(F.lit("violations: "), F.array_join(violations, "; ")))
    return F.concat(document, F.lit("\n\n[handshakes]\n"), F.concat_ws("\n", F.array_join(told, "\n"), broken))


def slim_document(document: Column, *, before: int = 4, every: int = 8) -> Column:
    """P9, setting C: the semantics document with fewer cycles (W9) and a short summary, as JSON."""
    step = document["fail_step"]
    low = F.greatest(F.coalesce(step - before, F.lit(0)), F.lit(0))

    def thin(rows: Column) -> Column:
        return F.filter(rows, lambda r, i: (F.coalesce(r["cycle"], i) >= low) | (i % every == 0))

    names = ["module", "error_type", "fail_stage", "fail_step", "failed_line", "trigger_condition", "fault_cone"]
    summary = F.nullif(F.trim(document["text_summary"]), F.lit(""))
    return F.to_json(F.struct(*[document[n].alias(n) for n in names], *[thin(document[n]).alias(n) for n in ("cycle_events", "state_trace")], shortened(summary).alias("text_summary")))


def view_cone(cone: Column, trigger: Column, error_type: Column) -> Column:
    """P9, setting E: a dynamic cone (see ``text.dynamic_cone``) as text, with at most 20 signals of the cone, 10 silent
    ones and 24 rows of values."""
    listed = lambda items, most: F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("  - "), x)), "\n")
    count = lambda c: F.size(cone[c]).cast("string")
    values = F.transform(F.slice(cone["value_trace"], 1, 24), lambda r: F.concat(F.lit("  cyc"), r["cycle"].cast("string"), F.lit(": "), F.array_join(r["vals"], ", ")))
    ratio = F.format_string("%.0f%%", cone["reduction_ratio"] * 100)
    some = lambda c, head, body: F.when(F.size(cone[c]) > 0, F.concat(head, F.lit("\n"), body))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[dynamic slice] fail step: "), cone["fail_step"].cast("string"), F.lit(", asserted: "), F.array_join(cone["assert_signals"], ", ")),
        F.concat(F.lit("[flipped: "), count("dynamic_cone"), F.lit("]\n"), listed(cone["dynamic_cone"], 20)),
        some("silent_signals", F.concat(F.lit("[silent: "), count("silent_signals"), F.lit("]")), listed(cone["silent_signals"], 10)),
        F.concat(F.lit("static "), cone["static_cone_size"].cast("string"), F.lit(" -> dynamic "), count("dynamic_cone"), F.lit(" ("), ratio, F.lit(")")),
        some("value_trace", F.lit("[values]"), F.array_join(values, "\n")),
        F.concat(F.lit("trigger: "), F.coalesce(trigger, F.lit("?"))), F.concat(F.lit("error type: "), F.coalesce(error_type, F.lit("?"))),
    )


def view_causal(evidence_: Column, cone: Column, states: Column, trigger: Column) -> Column:
    """P10, setting D: the failed assertion, every node of the cone, every row of the state trace, and the trigger."""
    head = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), F.coalesce(evidence_[c].cast("string"), F.lit("?"))) for c in ("module", "error_type", "fail_stage", "fail_step")])
    nodes = F.array_join(F.transform(F.coalesce(cone, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    rows = F.array_join(F.transform(states, lambda r: F.concat(F.lit("cyc"), F.coalesce(r["cycle"].cast("string"), F.lit("?")), F.lit(": "), F.to_json(r))), "\n")
    parts = ["[failed assertion]", head, "[causes]", F.nullif(nodes, F.lit("")), "[states]", F.nullif(rows, F.lit("")), "[trigger]", F.coalesce(trigger, evidence_["trigger_condition"], F.lit("?"))]
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


#: Which view a setting shows; a setting that isn't here is an error. The dynamic parts are made by the functions above.
SETTINGS = {"A": "raw", "B": "document", "BH": "handshakes", "BT": "analysis", "C": "slim", "D": "causal", "E": "cone"}


def setting_view(setting: Column, views: dict[str, Column], *, missing: str = "(missing)") -> Column:
    """The text of a row's setting; ``missing`` if its document is. views: by the names in SETTINGS."""
    chosen = F.lit(None).cast("string")
    for name, view in SETTINGS.items():
        if view in views:
            chosen = F.when(setting == name, F.coalesce(views[view], F.lit(missing))).otherwise(chosen)
    known = setting.isin([s for s, v in SETTINGS.items() if v in views])
    return F.when(known, chosen).otherwise(F.raise_error(F.concat(F.lit("no such setting: "), setting)))


def prompt(design: Column, assertions: Column, shown: Column, error_type: Column, module: Column, history: Column | None = None, *, task: str, answer: str) -> Column:
    """A prompt of task, design, assertions, evidence, metadata, the history of attempts if there is any, and the form
    of the answer. history: array of (attempt, diff, failure) in order."""
    part = lambda name, body: F.concat(F.lit(f"[{name}]\n"), F.coalesce(body, F.lit("")), F.lit(f"\n[end of {name}]"))
    meta = F.concat(F.lit("error_type="), F.coalesce(error_type, F.lit("?")), F.lit(" module="), F.coalesce(module, F.lit("?")))
    tried = None
    if history is not None:
        told = F.transform(history, lambda h: F.concat_ws(
            "\n", F.concat(F.lit("- attempt "), h["attempt"].cast("string"), F.lit(" failed")),
            F.concat(F.lit("  diff: "), F.nullif(h["diff"], F.lit(""))), F.concat(F.lit("  failure: "), F.coalesce(h["failure"], F.lit("?")))))
        tried = F.when(F.size(history) > 0, F.concat(F.lit("[earlier attempts]\n"), F.array_join(told, "\n"), F.lit("\nDo not repeat them.")))
    parts = [F.lit(task), part("design", design), part("assertions", assertions), part("evidence", shown), meta, tried, F.lit(answer)]
    return F.concat_ws("\n\n", *[p for p in parts if p is not None])


def retry_history(attempts: DataFrame, keys: list[str], *, most: int = 3, cut: int = 1500) -> DataFrame:
    """(keys, history): the failed attempts of each task in order, the last ``most`` of them, diffs cut to ``cut``
    characters. attempts: keys, attempt, ok, diff, failure. A task whose last attempt was good has none."""
    per = Window.partitionBy(*keys)
    rows = attempts.withColumn("__done", F.max(F.coalesce("ok", F.lit(False))).over(per)).where("not __done")
    rows = rows.withColumn("__rn", F.row_number().over(per.orderBy(F.desc("attempt")))).where(F.col("__rn") <= most)
    entry = F.struct("attempt", F.substring(F.coalesce("diff", F.lit("")), 1, cut).alias("diff"), "failure")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("history"))


#: What marks a line of an interface, and identifiers that are no signals.
INTERFACE = ["input ", "output ", "parameter ", "localparam "]
NO_SIGNALS = ["a", "b", "buggy", "sv", "if", "else", "begin", "end", "module", "wire", "reg", "assign", "always", "posedge", "negedge", "or"]


def audit_patch(rows: DataFrame) -> DataFrame:
    """(keys, hunks, hunk_locs, loc_dev, changed_sigs, interface_ok, assertion_ok, loop_ok, t2_pass).

    rows: any key columns and diff_text, loc_line, signals (text), fault_cone (array). A patch may touch neither
    interface nor assertions, and what it changes must be in the cone or in what was reported (compared in lower
    case). loc_dev is the distance of the location to the nearest hunk.
    """
    keys = [c for c in rows.columns if c not in ("diff_text", "loc_line", "signals", "fault_cone")]
    parsed = rows.withColumn("__h", X.parse_diff(F.coalesce("diff_text", F.lit(""))))
    changed = F.flatten(F.transform("__h", lambda h: F.concat(h["added"], h["deleted"])))
    idents = F.array_distinct(F.flatten(F.transform("__changed", lambda x: F.regexp_extract_all(x, F.lit(X.IDENT), F.lit(1)))))
    parsed = parsed.withColumn("__changed", changed)
    parsed = parsed.withColumn("changed_sigs", F.sort_array(F.array_except(idents, F.array(*[F.lit(x) for x in NO_SIGNALS]))))
    reported = F.transform(F.regexp_extract_all(F.coalesce("signals", F.lit("")), F.lit(X.IDENT), F.lit(1)), F.lower)
    backed = F.array_union(F.coalesce("fault_cone", F.array().cast("array<string>")), reported)
    interface = ~F.exists("__changed", lambda x: F.exists(F.array(*[F.lit(k) for k in INTERFACE]), lambda k: F.contains(x, k)))
    assertion = ~F.exists("__changed", lambda x: x.rlike(r"\b(?:assert|assume)\b"))
    loop = (F.size("changed_sigs") == 0) | F.arrays_overlap("changed_sigs", backed)
    places = F.transform("__h", lambda h: h["new"])
    out = parsed.select(
        *keys, F.size("__h").alias("hunks"), places.alias("hunk_locs"), F.array_min(F.transform(places, lambda x: F.abs(F.col("loc_line") - x))).alias("loc_dev"),
        "changed_sigs", interface.alias("interface_ok"), assertion.alias("assertion_ok"), loop.alias("loop_ok"),
    )
    return out.withColumn("t2_pass", F.col("interface_ok") & F.col("assertion_ok") & F.col("loop_ok"))


def cross_references(papers: DataFrame) -> DataFrame:
    """(paper, problem, name) of LaTeX sources: labels given twice, references and citations that resolve to
    nothing, entries that nothing cites. papers: (paper, text)."""

    def names(pattern: str) -> DataFrame:
        return papers.select("paper", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))

    labels, refs, entries = names(r"\\label\{([^}]+)\}"), names(r"\\(?:ref|eqref|autoref)\{([^}]+)\}"), names(r"\\bibitem\{([^}]+)\}")
    cites = names(r"\\cite[a-z]*\{([^}]+)\}").select("paper", F.explode(F.split("name", ",")).alias("name")).withColumn("name", F.trim("name")).where("name <> ''")
    twice = labels.groupBy("paper", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keys = ["paper", "name"]
    told = {
        "duplicate label": twice, "reference": refs.distinct().join(labels, keys, "left_anti"),
        "citation": cites.distinct().join(entries, keys, "left_anti"), "uncited": entries.distinct().join(cites, keys, "left_anti"),
    }
    out = None
    for problem, found in told.items():
        found = found.select("paper", F.lit(problem).alias("problem"), "name")
        out = found if out is None else out.unionByName(found)
    return out
