"""Text operators bound to documents, pages and conversations; a document is a source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import evidence as E
from ..session import read_table
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


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("trace_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


_LINES = "WITH l AS (SELECT doc_id AS trace_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query("SELECT doc_id, array_to_string(list_transform(range(1, least(len(p), 7) + 1), lambda i: lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || p[i]), chr(10)) AS slice FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def c1_code_slice(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.code_slice(F.col("text"), F.lit(3)).alias("slice"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\\x20-\\x7E]', ' ', 'g')), '\\b([a-z_][a-z0-9_]*)\\b', 1), lambda x: x NOT IN ('the', 'of') AND NOT regexp_matches(x, '^(an|er)')))), ' ') AS ids FROM documents")
def c3_identifiers(spark, sf_dir):
    ascii_text = F.lower(F.regexp_replace("text", r"[^\x20-\x7E]", " "))
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.identifiers(ascii_text, stop=["the", "of"], prefixes=["an", "er"]), " ").alias("ids"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x20-\\x7E]', ' ', 'g'), '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1)), lambda x: regexp_matches(x, '[a-z]|_'))), ' ') AS ids FROM documents")
def c4_signal_identifiers(spark, sf_dir):
    ascii_text = F.regexp_replace("text", r"[^\x20-\x7E]", " ")
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.signal_identifiers(ascii_text), " ").alias("ids"))


@query(_LINES + """, r AS (SELECT trace_id, pos, unnest(list_filter([CASE WHEN line LIKE '%|%' THEN 'table' END, CASE WHEN regexp_matches(line, '@[a-z0-9.]+') THEN 'mail' END,
    CASE WHEN length(line) > 500 THEN 'long' END], lambda x: x IS NOT NULL)) AS rule FROM l WHERE NOT regexp_matches(line, '^\\s*//')) SELECT * FROM r""")
def c21_lint(spark, sf_dir):
    return X.lint(lines(spark, sf_dir), {"table": r"\|", "mail": "@[a-z0-9.]+", "long": "(?s)^.{501}"})


@query("SELECT doc_id, array_to_string(list_filter(['licensed', 'worthless', 'token', 'mail'], lambda w: contains(lower(text), w)), ',') AS words FROM documents WHERE regexp_matches(lower(text), 'licensed|worthless|token|mail')")
def c22_leak_words(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", X.contains_any(F.col("text"), ["licensed", "worthless", "token", "mail"]).alias("w"))
    return found.where(F.size("w") > 0).select("doc_id", F.array_join("w", ",").alias("words"))


@query("SELECT doc_id, len(list_filter(string_split(d, chr(10)), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---)'))) AS n FROM (SELECT doc_id, '--- a' || chr(10) || '+++ b' || chr(10) || '+' || replace(text, chr(10), chr(10) || '-') AS d FROM documents)")
def c17_diff_size(spark, sf_dir):
    d = F.concat(F.lit("--- a\n+++ b\n+"), F.regexp_replace("text", "\n", "\n-"))
    return docs(spark, sf_dir).select("doc_id", X.diff_size(d).cast("long").alias("n"))


@query()
def c15_c19_truth_lines(spark, sf_dir):
    d = docs(spark, sf_dir)
    other = F.regexp_replace("text", r"(?m)^The\b", "A")
    return d.select("doc_id", F.array_join(X.ground_truth(F.col("text"), other).cast("array<string>"), ",").alias("lines"))


@query(_LINES + """, h AS (SELECT *, regexp_matches(line, '^(The|A)') AS hit FROM l), n AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM h)
    SELECT trace_id, pos, md5(CASE WHEN NOT hit THEN line WHEN k = 1 THEN '// one' ELSE '// more' END) AS digest FROM n""")
def p7_sanitise(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("own", F.col("line"))
    marked = marked.withColumn("line", F.when(F.col("line").rlike("^(The|A)"), F.lit("// leak")).otherwise(F.concat(F.lit("="), F.col("line"))))
    out = X.sanitise(marked, ["leak"], " one", " more")
    line = F.when(F.col("line").startswith("="), F.col("own")).otherwise(F.col("line"))
    return out.select("trace_id", "pos", F.md5(line.cast("binary")).alias("digest"))


@query("SELECT doc_id, source, n_chars FROM documents")
def p6_drop_labels(spark, sf_dir):
    return E.without_labels(docs(spark, sf_dir).withColumnsRenamed({"lang": "inject_line", "text": "diff"}))


@query("SELECT doc_id, substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS head FROM documents")
def p8_truncate(spark, sf_dir):
    head = F.concat(F.substring("text", 1, 300), F.when(F.length("text") > 300, "...").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", head.alias("head"))


@query("SELECT doc_id, length(text) // 4 + 1 AS tokens FROM documents")
def st11_token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc7_json(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", L.parse_json(F.col("props"), "k bigint")["k"].alias("k"))


@query("SELECT k AS id, unnest(list_transform(range(k, k + 4), lambda i: 's' || lpad(CAST(i AS VARCHAR), 2, '0'))) AS sample FROM (SELECT n_nationkey AS k FROM nation)")
def sc16_expand_samples(spark, sf_dir):
    k = F.col("n_nationkey")
    spec = F.format_string("s%02d-s%02d,s%02d", k, k + 3, k + 1)
    return read_table(spark, sf_dir, "nation").select(k.alias("id"), F.explode(L.expand_samples(spec)).alias("sample"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 40 AS INT) ELSE CAST(doc_id % 30 AS INT) END AS fail_step, CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS result FROM documents")
def sc3_solver_log(spark, sf_dir):
    i = F.col("doc_id")
    step = F.when(i % 2 == 0, F.concat(F.lit("##  0:00:00  Checking assertions in step 0..\n##  failed assertion x at y in step "), (i % 40).cast("string")))
    step = step.otherwise(F.concat(F.lit("##  0:00:00  Checking assertions in step "), (i % 30).cast("string"), F.lit("..")))
    text = F.concat(step, F.when(i % 3 == 0, "\n##  BMC failed!").otherwise("\nDONE (PASS, rc=0)"))
    out = docs(spark, sf_dir).select("doc_id", L.solver_log(text).alias("l"))
    return out.select("doc_id", "l.fail_step", "l.result")
