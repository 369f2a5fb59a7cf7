"""Blocks of nested text lines, found by depth over pieces of a file of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan as S
from .ranges import first_at_most

#: What begins a block, and what opens and closes a level inside it.
HEAD, OPEN, CLOSE, OPEN_TEXT = r"^(?:always\s*@|assign\s)", r"\bbegin\b", r"\bend\b", "begin"
#: Lines of a piece.
PIECE_LINES = 1024


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def blocks(lines: DataFrame, *, head: str = HEAD, opens: str = OPEN, closes: str = CLOSE, open_text: str = OPEN_TEXT, piece: int = PIECE_LINES) -> DataFrame:
    """(trace_id, start, stop) of the outermost blocks of each file; lines: (trace_id, pos, line), pos from 0.

    A block begins at a line with ``head`` and ends with the first line that has closed all it opened. A head that opens nothing is a block by itself; one that opens and closes as
    much, or only has ``open_text`` somewhere, counts as open. What never closes is no block, and nothing after it is.
    The depth of a line is a running sum over pieces of the file. A head's end is the first later line whose depth is at most that before the head, found by the
    pieces' minima. Spans of heads are nested or apart, so a head begins a block unless a span of an earlier one reaches it: a running maximum.
    """
    code = F.trim(F.coalesce("line", F.lit("")))
    step = (_count(code, opens) - _count(code, closes)).cast("long")
    is_head = code.rlike(head)
    rows = lines.select("trace_id", F.col("pos").cast("long").alias("at"), step.alias("step"), is_head.alias("head"), (F.contains(code, F.lit(open_text)) & (step == 0)).alias("odd"))
    cut = S.by_width(F.col("at"), piece)
    deep = S.segmented_scan(rows, ["trace_id"], ["at"], cut, {"value": S.running_sum(F.col("step"))})
    bound = F.col("value") - F.col("step") - F.when(F.col("odd"), 1).otherwise(0)
    asked = deep.where("head").select("trace_id", F.col("at").alias("from"), bound.alias("bound"))
    spans = first_at_most(asked, deep.select("trace_id", "at", "value"), keys=["trace_id"], width=piece)
    spans = spans.select("trace_id", F.col("from").alias("start"), F.col("hit").alias("stop"), F.coalesce("hit", F.lit((1 << 62))).alias("reach"))
    reach = S.segmented_scan(spans, ["trace_id"], ["start"], S.by_width(F.col("start"), piece), {"most": S.running_max(F.col("reach"))})
    before = S.segmented_scan(reach, ["trace_id"], ["start"], S.by_width(F.col("start"), piece), {"earlier": S.previous(F.col("most"))})
    free = F.coalesce(F.col("earlier.v") < F.col("start"), F.lit(True))
    return before.where(free & F.col("stop").isNotNull()).select("trace_id", "start", "stop")
