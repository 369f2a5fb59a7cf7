"""Text, diff and JSON operators bound to the texts of ``documents``, ``pages`` and ``conversations``.

Diffs change the middle line of a document, so that SQL can tell from the text alone what each operator must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_LINES = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, text, parts, len(parts) // 2 + 1 AS k FROM t), d AS (SELECT *, parts[k] AS old, '[changed] ' || parts[k] AS new FROM l)"""


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its lines, its middle line's number k, that line before and after a change, and the diff."""
    df = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("parts", F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1))
    df = df.withColumn("k", F.floor(F.size("parts") / 2).cast("int") + 1)
    df = df.withColumn("old", F.element_at("parts", F.col("k"))).withColumn("new", F.concat(F.lit("[changed] "), "old"))
    return df.withColumn("diff", F.format_string("--- a\n+++ b\n@@ -%d +%d @@\n-%s\n+%s\n", "k", "k", "old", "new"))


def sha(c: Column | str) -> Column:
    return F.sha2(c, 256)


@query(_LINES + " SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: printf('%4d: ', i) || x), chr(10))) AS numbered FROM l")
def c28_numbered_documents(spark, sf_dir):
    """Every document with its lines numbered."""
    df = read_table(spark, sf_dir, "documents")
    return df.select("doc_id", sha(X.number_lines(F.coalesce("text", F.lit("")))).alias("numbered"))


@query(_LINES + " SELECT doc_id, CAST(1 AS INT) AS hunks, CAST(k AS INT) AS old_line, CAST(k AS INT) AS new_line, sha256(old) AS deleted, sha256(new) AS added FROM d")
def c15_document_hunks(spark, sf_dir):
    """The hunks of each document's diff."""
    one = F.col("h")[0]
    return changed(spark, sf_dir).select("doc_id", X.parse_diff("diff").alias("h")).select(
        "doc_id", F.size("h").alias("hunks"), one["old"].alias("old_line"), one["new"].alias("new_line"),
        sha(F.array_join(one["deleted"], "\n")).alias("deleted"), sha(F.array_join(one["added"], "\n")).alias("added"),
    )


@query(
    _LINES
    + """, p AS (SELECT *, list_min(list_filter(range(greatest(1, k - 10), least(len(parts), k + 10) + 1), lambda i: parts[i] = old)) AS place FROM d)
    SELECT doc_id, CASE WHEN text <> '' THEN sha256(array_to_string(list_concat(parts[:place - 1], [new], parts[place + 1:]), chr(10))
        || CASE WHEN place = len(parts) OR text LIKE '%' || chr(10) THEN chr(10) ELSE '' END) END AS patched FROM p"""
)
def c16_patched_documents(spark, sf_dir):
    """Each document after its diff, which is fitted to the upper of equal lines near the one it names. An empty one has no line to change."""
    return changed(spark, sf_dir).select("doc_id", sha(X.patched("text", "diff")).alias("patched"))


@query(
    _LINES
    + r""", m AS (SELECT doc_id, trim(regexp_replace(old, '\s+', ' ', 'g')) AS key, parts FROM d)
    SELECT doc_id, CASE WHEN length(key) >= 6 THEN array_to_string(list_filter(list_transform(parts, lambda x, i:
        CASE WHEN contains(trim(regexp_replace(x, '\s+', ' ', 'g')), key) THEN i END), lambda i: i IS NOT NULL), ',') ELSE '' END AS lines FROM m"""
)
def c20_matched_documents(spark, sf_dir):
    """The lines of each document that hold its middle line, white space made equal."""
    df = changed(spark, sf_dir)
    found = X.content_matches(F.concat(F.lit("@@ -1 +1 @@\n+"), "old"), F.col("text"))
    return df.select("doc_id", F.array_join(found.cast("array<string>"), ",").alias("lines"))


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n, sha256(text) AS digest, sha256(text) AS cut_digest FROM conversations WHERE text IS NOT NULL")
def c13_turns_in_json(spark, sf_dir):
    """Turns as a model's output would hold them: a JSON object behind thoughts and a fence, whole and cut off before it ends."""
    df = read_table(spark, sf_dir, "conversations").where("text is not null")
    turn = F.struct(F.struct("role", "text").alias("turn"))
    whole = F.concat(F.lit("<think>{no}</think>Here it is:\n```json\n"), F.to_json(turn), F.lit("\n```"))
    cut = F.concat(F.lit("Here: "), F.regexp_replace(F.to_json(F.struct("role", "text", F.struct(F.lit(1).alias("x")).alias("at"))), r"\}$", ', "more": "cu'))
    got = df.select("conv_id", "turn", F.from_json(X.salvage_json(whole), "turn struct<role string, text string>").alias("a"), F.from_json(X.salvage_json(cut), "text string").alias("b"))
    text = F.col("a.turn.text")
    return got.select("conv_id", "turn", F.col("a.turn.role").alias("role"), F.length(text).cast("long").alias("n"), sha(text).alias("digest"), sha("b.text").alias("cut_digest"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '\{[^{}"]*\}'), '') AS found FROM pages""")
def c14_braces_in_pages(spark, sf_dir):
    """The first balanced braces of each page's source."""
    return read_table(spark, sf_dir, "pages").select("page_id", X.balanced_json("html").alias("found"))
