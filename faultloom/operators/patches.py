"""Diffs as tables of lines, and the reduction of many diffs at once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, settled_by


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(id, pos, hunk, unit, line) of (id, diff): the heads, changes and context of each diff in order. Changed lines that follow one another are a unit, numbered from 0; heads and
    context have none. Lines before the first head and those of other kinds are left out."""
    each = diffs.select("id", F.posexplode(F.split(F.regexp_replace("diff", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    first, head = F.substring("line", 1, 1), F.col("line").startswith("@@")
    change = first.isin("+", "-") & ~F.col("line").startswith("---")
    per = Window.partitionBy("id").orderBy("pos")
    told = each.where(head | change | (first == " ")).withColumn("change", change & ~head).withColumn("hunk", F.count_if(head).over(per))
    told = told.where("hunk > 0")
    begins = F.col("change") & ~F.coalesce(F.lag("change").over(per), F.lit(False))
    return told.withColumn("begins", begins).select("id", "pos", "hunk", F.when(F.col("change"), F.count_if("begins").over(per) - 1).alias("unit"), "line")


def segments(diff: str | None) -> list[tuple[int, int | None, str]]:
    """(hunk, unit, lines joined) of a diff in order, as ``diff_lines`` has them: each unit is one segment, heads and context between units another."""
    out: list[tuple[int, int | None, list[str]]] = []
    hunk, unit, inside = 0, -1, False
    for line in re.sub("\r\n?", "\n", diff or "").split("\n"):
        head = line.startswith("@@")
        change = line.startswith(("+", "-")) and not line.startswith("---")
        if not (head or change or line[:1] == " "):
            continue
        hunk += head
        if not hunk:
            continue
        unit += change and not inside
        inside = change
        key = (hunk, unit if change else None)
        if out and out[-1][:2] == key:
            out[-1][2].append(line)
        else:
            out.append((*key, [line]))
    return [(h, u, "\n".join(lines)) for h, u, lines in out]


_segments = F.udf(segments, T.ArrayType(T.StructType().add("hunk", T.IntegerType()).add("unit", T.LongType()).add("lines", T.StringType())), useArrow=False)


def rebuilt(parts: Column, gone: Column) -> Column:
    """The diff of ``segments`` without the units of an array; a hunk that changes nothing any more goes."""
    stays = lambda x: x["unit"].isNotNull() & ~F.array_contains(gone, x["unit"])
    alive = F.array_distinct(F.transform(F.filter(parts, stays), lambda x: x["hunk"]))
    kept = F.filter(parts, lambda x: (x["unit"].isNull() | stays(x)) & F.array_contains(alive, x["hunk"]))
    return F.concat(F.array_join(F.transform(kept, lambda x: x["lines"]), "\n"), F.lit("\n"))


def minimised(diffs: DataFrame, verdicts: Callable[[DataFrame], DataFrame], *, most: int = 40) -> DataFrame:
    """(id, holds, units, removed, calls, diff) of (id, diff): units are taken away one at a time while the verdict stays good, from the first again after each success, until none can go or ``most`` calls
    are made; calls are counted as if trials were checked one after another.

    ``verdicts`` gets a table of trials (id, trial, diff) and returns (id, trial, ok), a missing one as bad. A round tries every unit left of every diff at once, as rows, so there are as many rounds as a diff loses
    units at most, and one. A diff that doesn't hold as it is stays. ids are unique and not null.

    Diffs are cut into segments and dealt by id once; only ids, numbers and verdicts are exchanged in a round, so ``verdicts`` should look at a trial's diff before it joins.
    """
    base = settled_by(diffs.select("id", _segments("diff").alias("parts")), "id")
    units = base.select("id", (F.array_max(F.transform("parts", lambda x: x["unit"])) + 1).alias("units"))
    whole = verdicts(diffs.select("id", F.lit(-1).cast("long").alias("trial"), "diff")).select("id", F.coalesce("ok", F.lit(False)).alias("holds"))
    state = diffs.select("id").join(units, "id", "left").join(whole, "id", "left")
    state = state.select("id", F.coalesce("holds", F.lit(False)).alias("holds"), F.coalesce("units", F.lit(0)).alias("units"), F.array().cast("array<long>").alias("removed"), F.lit(1).cast("long").alias("calls"))
    state = settled(state.withColumn("open", F.col("holds") & (F.col("units") > 0)))
    while not (live := state.where("open")).isEmpty():
        left = live.select("id", "removed", F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("units") - 1), "removed")).alias("trial"))
        trials = base.join(left, "id").select("id", "trial", rebuilt(F.col("parts"), F.concat("removed", F.array("trial"))).alias("diff"))
        told = left.select("id", "trial").join(verdicts(trials).select("id", "trial", "ok"), ["id", "trial"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        first = told.groupBy("id").agg(F.min(F.when(F.col("ok"), F.col("trial"))).alias("hit"), F.sort_array(F.collect_list("trial")).alias("tried"))
        calls = F.coalesce(F.array_position("tried", F.col("hit")), F.size("tried").cast("long"))
        state = state.join(first, "id", "left").select(
            "id", "holds", "units", F.when(F.col("hit").isNotNull(), F.concat("removed", F.array("hit"))).otherwise(F.col("removed")).alias("removed"),
            (F.col("calls") + F.coalesce(F.when(F.col("tried").isNotNull(), calls), F.lit(0))).alias("calls"), "hit",
        )
        going = F.col("hit").isNotNull() & (F.col("calls") < most) & (F.size("removed") < F.col("units"))
        state = settled(state.withColumn("open", going).drop("hit"))
    out = base.join(state, "id").withColumn("rest", rebuilt(F.col("parts"), F.col("removed"))).join(diffs.select("id", "diff"), "id")
    return out.select("id", "holds", "units", F.array_sort("removed").alias("removed"), "calls", F.when(F.size("removed") > 0, F.col("rest")).otherwise(F.col("diff")).alias("diff"))
