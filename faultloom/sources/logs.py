"""Solver logs, result rows and source text as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def solver_log(text: Column) -> Column:
    """SC3: struct(module, failed_line, failed_assert_id, fail_step, result, fail_stage) of a log.

    The first match of each kind counts. The step is that of a summary line, else the largest one
    checked; of the results fail comes before prove and prove before pass.
    """
    checked = F.transform(F.regexp_extract_all(text, F.lit(r"Checking assertions in step (\d+)"), F.lit(1)), lambda x: x.cast("int"))
    place = r"\.s?v:(\d+)(?:\.\d+-\d+\.\d+)? \(\$assert\$\S+?:\d+\$(\d+)\)"
    step = F.coalesce(_first(text, r"failed assertion .*?step (\d+)", 1).cast("int"), F.array_max(checked))
    result = (
        F.when(text.rlike(r"BMC failed|DONE \(FAIL"), "fail")
        .when(text.rlike("successful proof by k-induction|Temporal induction successful"), "prove")
        .when(text.contains("DONE (PASS"), "pass")
    )
    stage = F.when(result == "fail", F.concat(F.lit("bmc_depth_"), F.coalesce(step.cast("string"), F.lit("?"))))
    return F.struct(
        _first(text, r"Assert failed in (\w+):", 1).alias("module"),
        _first(text, place, 1).cast("int").alias("failed_line"),
        _first(text, place, 2).alias("failed_assert_id"),
        step.alias("fail_step"),
        result.alias("result"),
        stage.when(result == "prove", "k-induction_proof").otherwise("unknown").alias("fail_stage"),
    )


def fail_steps(text: Column) -> Column:
    """SC4: struct(max_step, last_assert): the largest step checked and the last line that tells of a failed assertion."""
    steps = F.transform(F.regexp_extract_all(text, F.lit(r"Checking assertions in step (\d+)\.\."), F.lit(1)), lambda x: x.cast("int"))
    told = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: F.contains(x, F.lit("Assert failed")))
    return F.struct(F.array_max(steps).alias("max_step"), F.coalesce(F.trim(F.try_element_at(told, F.lit(-1))), F.lit("")).alias("last_assert"))


def fail_step(text: Column) -> Column:
    """SC4: the step of a summary line, else the largest step checked, else the first "at step N"."""
    checked = F.transform(F.regexp_extract_all(text, F.lit(r"Checking assertions in step (\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(_first(text, r"failed assertion .*?step (\d+)", 1).cast("int"), F.array_max(checked), _first(text, r"at step (\d+)", 1).cast("int"))


def task_timing(logs: DataFrame) -> DataFrame:
    """SC5: (sample, kind, seconds): the seconds of all task lines of all logs, summed by sample and kind."""
    line = r"\[\d+/\d+\]\s+(s\d{2,})\s+(verify|golden):\s+DONE\s+\([^)]*\)\s+\(([\d.]+)s\)"
    found = logs.select(F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(0))).alias("task"))
    sample, kind, seconds = (F.regexp_extract("task", line, i) for i in (1, 2, 3))
    return found.groupBy(sample.alias("sample"), kind.alias("kind")).agg(F.sum(seconds.cast("double")).alias("seconds"))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SC6: (path, text) of files in UTF-8, else in GBK, else in Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    raw = F.col("content").cast("string")
    return files.select("path", F.when(F.is_valid_utf8(raw), raw).otherwise(_decoded("content")).alias("text"))


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """Spark's own decode() has no GBK."""

    def text(data: bytes) -> str:
        try:
            return data.decode("gbk")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    return content.map(text, na_action="ignore")


def parse_json(text: Column, schema: str) -> Column:
    """SC7: a JSON document; null if it can't be parsed."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """SC8, SC9: rows of JSON lines; lines cut short or corrupt are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_results(spark: SparkSession, pattern: str, row_schema: str) -> DataFrame:
    """SC10: rows of all files of a pattern, each ``{"results": [...]}`` or a bare list; with src and pos."""
    files = spark.read.option("ignoreCorruptFiles", "true").text(pattern, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("src"), "value")
    rows = F.coalesce(
        F.from_json("value", f"struct<results: array<struct<{row_schema}>>>")["results"], F.from_json("value", f"array<struct<{row_schema}>>")
    )
    return files.select("src", F.posexplode(rows).alias("pos", "row")).select("src", "pos", "row.*")


def read_with_fallback(spark: SparkSession, whole: str, shards: str, partials: str, row_schema: str, keys: list[str]) -> DataFrame:
    """SC11: the rows of the whole file; if it has none, those of all shards and then of the partial JSON lines, the first
    of each key (in order of file names), sorted by key. Files that aren't there or can't be read have no rows."""
    names = [c.split(":")[0].strip() for c in row_schema.split(",")]

    def rows(pattern: str, lines: bool) -> DataFrame:
        try:
            if lines:
                read = spark.read.schema(row_schema.replace(":", " ")).option("mode", "DROPMALFORMED").json(pattern)
                return read.select(F.col("_metadata.file_path").alias("src"), F.monotonically_increasing_id().alias("pos"), *names)
            return read_results(spark, pattern, row_schema).withColumn("pos", F.col("pos").cast("long"))
        except AnalysisException:
            return spark.createDataFrame([], f"src string, pos long, {row_schema.replace(':', ' ')}")

    first = rows(whole, False).select(*names)
    if not first.isEmpty():
        return first
    every = rows(shards, False).withColumn("part", F.lit(0)).unionByName(rows(partials, True).withColumn("part", F.lit(1)))
    kept = every.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("part", "src", "pos")).alias("row"))
    return kept.select("row.*").orderBy(*keys)


def missing_files(spark: SparkSession, root: str, required: list[str], samples: DataFrame | None = None) -> DataFrame:
    """SC12, J10: (sample, file): required files that a sample folder below root lacks. samples: (sample), those that must
    be there, also if they have no file at all; by default the folders found. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    have = files.select(F.element_at(F.split("path", "/"), -2).alias("sample"), F.element_at(F.split("path", "/"), -1).alias("file"))
    need = (have if samples is None else samples).select("sample").distinct().withColumn("file", F.explode(F.array(*[F.lit(x) for x in required])))
    return need.join(have, ["sample", "file"], "left_anti")


def design_file(files: DataFrame) -> DataFrame:
    """SC12: (sample, file): the design of each sample, of (sample, file): buggy.sv, else buggy.v, else the first by name
    that is neither a test bench nor a reference."""
    rank = F.when(F.col("file") == "buggy.sv", 0).when(F.col("file") == "buggy.v", 1)
    other = F.col("file").rlike(r"\.s?v$") & ~F.col("file").rlike("^(?:tb_|golden)") & ~F.col("file").isin("assertions.sv", "uart_tx.sv", "formal_top.sv")
    ranked = files.withColumn("rank", rank.when(other, 2)).where("rank is not null")
    return ranked.groupBy("sample").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))


PORT = r"\b(input|output|inout)\b"


def ports(lines: DataFrame) -> DataFrame:
    """SC13: (trace_id, name, direction): each identifier of a line that declares ports; the first wins."""
    words = F.filter(
        F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)),
        lambda w: ~w.isin("input", "output", "inout", "wire", "reg", "logic", "signed", "parameter"),
    )
    code = lines.withColumn("line", F.regexp_replace("line", r"//.*|\[[^\]]*\]", ""))
    found = code.where(F.col("line").rlike(PORT)).select("trace_id", "pos", F.regexp_extract("line", PORT, 1).alias("direction"), F.explode(words).alias("name"))
    return found.groupBy("trace_id", "name").agg(F.min_by("direction", "pos").alias("direction"))


def module_header(text: Column) -> Column:
    """SC14: struct(name, params, ports) of the first module header."""
    header = r"(?s)\bmodule\s+(\w+)\s*(?:#\s*\((.*?)\)\s*)?\((.*?)\)\s*;"
    return F.struct(*[_first(text, header, i).alias(n) for i, n in ((1, "name"), (2, "params"), (3, "ports"))])


def bmc_depth(text: Column) -> Column:
    """SC15: the depth of a bmc task."""
    return _first(text, r"(?m)^bmc: depth (\d+)$", 1).cast("int")


def expand_samples(spec: Column, *, distinct: bool = True) -> Column:
    """SC16: "s04-s37,s40" as an array of ids of two digits at least, in order."""
    part = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: p)

    def ids(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^s?(\d+)", 1).cast("int")
        hi = F.coalesce(F.nullif(F.regexp_extract(p, r"-s?(\d+)$", 1), F.lit("")).cast("int"), lo)
        return F.transform(F.sequence(lo, hi), lambda i: F.format_string("s%02d", i))

    out = F.flatten(F.transform(F.filter(part, lambda p: p.rlike(r"^s?\d+(-s?\d+)?$")), ids))
    return F.array_distinct(out) if distinct else out


