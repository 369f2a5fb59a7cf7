"""Value-change dumps as tables: declared signals and value changes of many traces at once.

A dump is read as lines with their position. The time of a change is the last time mark above it; since
positions are needed in order, the running time is a window over each trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan as S

VAR = r"^\s*\$var\s+\S+\s+(\d+)\s+(\S+)\s+(\S+)"
TIME = r"^#(\d+)"
VECTOR = r"^b([01xzXZ]+)\s+(\S+)"
SCALAR = r"^([01xzXZ])(\S+)$"
#: The line that begins a dump in a file of several.
HEAD = r"^\$comment trace (\S*) \$end$"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(trace_id, pos, line) of text files; a file is a trace, and its lines keep their order.

    Large files are read in splits: ``pos`` is a struct of the split's first byte and the line's place in what the
    split's task reads, so it orders the lines of a file without a task that sees the file whole.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("trace_id"), F.col("_metadata.file_block_start").alias("block"), "value")
    pos = F.struct("block", F.monotonically_increasing_id().alias("row"))
    return rows.select("trace_id", pos.alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))


def head(trace: Column) -> Column:
    """The line that begins the dump of a trace in a file of several; traces are named without white space."""
    return F.concat(F.lit("$comment trace "), trace.cast("string"), F.lit(" $end"))


def dumps_of(lines: DataFrame) -> DataFrame:
    """lines of files that hold many dumps one after another, as lines of these: ``trace_id`` becomes the name in the last ``head`` line above, in an earlier split of the
    file too. Lines above a file's first keep the file as theirs. So small traces need no file each.
    """
    mark = F.when(F.col("line").rlike(HEAD), F.regexp_extract("line", HEAD, 1))
    named = S.segmented_scan(lines, ["trace_id"], ["pos"], F.col("pos.block"), {"name": S.last_known(mark)})
    return named.select(F.coalesce("name", "trace_id").alias("trace_id"), "pos", "line")


def signals(lines: DataFrame) -> DataFrame:
    """SC1, D1: (trace_id, vid, name, width, decl_pos) of each declaration."""
    out = lines.where(F.trim("line").startswith("$var")).select(
        "trace_id",
        F.regexp_extract("line", VAR, 2).alias("vid"),
        F.regexp_extract("line", VAR, 3).alias("name"),
        F.regexp_extract("line", VAR, 1).cast("int").alias("width"),
        F.col("pos").alias("decl_pos"),
    )
    return out.where("vid <> ''")


def decode_value(line):
    """SC2: struct(vid, val) of a value line; both null if it is none (reals and the like)."""
    vector, scalar = F.regexp_extract(line, VECTOR, 1), F.regexp_extract(line, SCALAR, 1)
    vid = F.coalesce(
        F.nullif(F.regexp_extract(line, VECTOR, 2), F.lit("")), F.nullif(F.regexp_extract(line, SCALAR, 2), F.lit(""))
    )
    return F.struct(vid.alias("vid"), F.coalesce(F.nullif(vector, F.lit("")), F.nullif(scalar, F.lit(""))).alias("val"))


def changes(lines: DataFrame) -> DataFrame:
    """SC1, D2: (trace_id, pos, ts, vid, val); the time before any mark is 0.

    The running time is a window over each split of a trace, which begins with the last time of the splits before.
    """
    body = lines.select("trace_id", "pos", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '$')")
    split = F.col("pos.block") if lines.schema["pos"].dataType.typeName() == "struct" else F.lit(0)
    mark = F.when(F.col("line").startswith("#"), F.expr(f"try_cast(regexp_extract(line, r'{TIME}', 1) as bigint)"))
    body = body.withColumn("split", split).withColumn("mark", mark)
    ends = body.groupBy("trace_id", "split").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos"))).alias("end"))
    before = Window.partitionBy("trace_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("trace_id", "split", F.last("end", ignorenulls=True).over(before).alias("begin"))
    upto = Window.partitionBy("trace_id", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    timed = body.withColumn("own", F.last("mark", ignorenulls=True).over(upto)).join(ends, ["trace_id", "split"])
    timed = timed.withColumn("ts", F.coalesce("own", "begin", F.lit(0).cast("bigint")))
    out = timed.where(~F.col("line").startswith("#")).select("trace_id", "pos", "ts", decode_value(F.col("line")).alias("v"))
    return out.select("trace_id", "pos", "ts", "v.vid", "v.val").where("vid is not null")
