"""Operators on result rows: keyed dedupe, pairing, upsert, measures, rollups, audits and balancing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import order_statistic


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SD1: of rows with one key the first in order; dropDuplicates would take any."""
    kept = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(kept.alias("__row")).select("__row.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SD2"""
    kept = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(kept.alias("__row")).select("__row.*")


def strict_pairs(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both sides with one key, each side deduplicated with the last row winning."""
    named = lambda df, p: last_wins(df, keys, order).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    return named(a, "a").join(named(b, "b"), keys)


def setting_pairs(rows: DataFrame, keys: list[str], order: list[str], value: str, *, last: bool = False) -> DataFrame:
    """(setting_a, setting_b, keys, a, b) of all pairs of settings."""
    one = (last_wins if last else first_wins)(rows, ["setting", *keys], order).select("setting", *keys, value)
    a, b = (one.withColumnsRenamed({"setting": f"setting_{s}", value: s}) for s in "ab")
    return a.join(b, keys).where("setting_a < setting_b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the new values of their keys; keys that only new has are left out."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(fresh, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def resume(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks of a grid that aren't done."""
    return grid.join(done.select(*keys), keys, "left_anti")


def replace_partition(rows: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """SO3: the rows for which the condition holds, taken from the other source."""
    return rows.where(~condition).unionByName(other.where(condition), allowMissingColumns=True)


#: SURVEY 2.13: the measures of a repair, by name.
REPAIR = {
    "bmc_else_pass": lambda: F.coalesce("repair_pass_bmc", "repair_pass", F.lit(False)),
    "bmc_or_pass": lambda: F.coalesce("repair_pass_bmc", F.lit(False)) | F.coalesce("repair_pass", F.lit(False)),
    "any": lambda: F.coalesce("repair_pass_bmc", F.lit(False)) | F.coalesce("repair_pass", F.lit(False)) | F.coalesce(F.col("verdict") == "PASS", F.lit(False)),
    "not_refuted": lambda: ~F.coalesce(~F.col("repair_pass_bmc"), F.lit(False)),
    "pass_or_verdict": lambda: F.coalesce("repair_pass", F.lit(False)) | F.coalesce(F.col("verdict").startswith("PASS"), F.lit(False)),
}


def location_hit(line: Column, lines: Column, single: Column, injected: Column, *, shift: int = 4) -> Column:
    """J15, 2.13: the line is one of the true lines; without a list the single one counts, else the injected one, shifted."""
    hit = F.when(F.size(lines) > 0, F.array_contains(lines, line)).when(single.isNotNull(), line == single).otherwise(line == injected + shift)
    return F.coalesce(hit, F.lit(False))


def nearest(line: Column, lines: Column) -> Column:
    """The distance to the nearest of an array of lines; null if there is none."""
    return F.array_min(F.transform(lines, lambda x: F.abs(x - line)))


def verdict(compiled: Column, formal: Column, simulated: Column) -> Column:
    """P2"""
    proven = F.when(simulated, "PASS").otherwise("INCONCLUSIVE")
    return F.when(~compiled, "BROKEN").when(formal == "fail", "FAIL").when(formal.isin("pass", "prove"), proven).otherwise("INCONCLUSIVE")


def classify_formal(text: Column, exit_code: Column, timeout: Column, error: Column) -> Column:
    """The first rule that holds decides."""
    return (
        F.when(timeout, "timeout")
        .when(error | text.contains("ERROR"), "error")
        .when((exit_code == 2) | text.rlike(r"Assert failed|BMC failed|DONE \(FAIL"), "fail")
        .when(text.rlike("successful proof by k-induction|Temporal induction successful"), "prove")
        .when((exit_code == 0) & text.contains("DONE (PASS"), "pass")
        .otherwise("error")
    )


def classify_induction(text: Column, timeout: Column) -> Column:
    """Like P3 in another order: a proof comes first, a base case alone is a pass."""
    return (
        F.when(text.rlike("successful proof by k-induction|Temporal induction successful"), "PROVE")
        .when(text.rlike(r"basecase[^\n]*[Pp]ass") & text.rlike(r"induction[^\n]*[Ff]ail"), "PASS")
        .when(text.rlike(r"DONE \(FAIL|BMC failed"), "FAIL")
        .when(text.contains("DONE (PASS"), "PASS")
        .when(timeout, "TIMEOUT")
        .otherwise("ERROR")
    )


def simulation_ok(text: Column, exit_code: Column, timeout: Column) -> Column:
    """P5"""
    return (exit_code == 0) & ~timeout & ~text.contains("$fatal") & ~text.contains("FAIL") & text.contains("$finish")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the element at n // 2 of each group's sorted values that aren't null, not an average of two; by selection, so no group is collected."""
    return order_statistic(rows, by, value, lambda n: F.floor(n / 2)).drop("n")


def setting_rollup(rows: DataFrame, by: list[str], *, repair: str = "bmc_else_pass") -> DataFrame:
    """A1: counts of runs, hits, repairs and verdicts, tokens, cost and mean attempts."""
    hit = F.coalesce("loc_top1", F.lit(False))
    verdicts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "FAIL", "BROKEN", "INCONCLUSIVE")]
    tokens = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("loc"), F.count_if(REPAIR[repair]()).alias("repair"), *verdicts, *tokens,
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.round(F.avg("attempts"), 6).alias("avg_attempts"),
    )


def totals_and_marginals(rows: DataFrame, a: str, b: str, measures: list[Column]) -> DataFrame:
    """A3: the grand total and both marginals in one pass, as GROUPING SETS."""
    return rows.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b)).agg(*measures)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def balance(groups: DataFrame, shards: int, *, group: str = "group", weight: str = "weight", by: list[str] | None = None) -> DataFrame:
    """SCH1: (by, group, shard): the heaviest group to the shard with the least load, the first of equals.

    Every choice depends on all before, so one task deals the groups of one plan (``by`` tells plans apart); groups
    are the units that a plan deals, not the rows behind them.
    """
    keys = by or []
    schema = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in [*keys, group])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, group], ascending=[False, True])
        loads = [(0.0, k) for k in range(shards)]
        shard = []
        for w in pdf[weight]:
            load, k = heapq.heappop(loads)
            heapq.heappush(loads, (load + w, k))
            shard.append(k)
        return pdf[[*keys, group]].assign(shard=shard)

    return groups.withColumn("__plan", F.lit(0)).groupBy(*(keys or ["__plan"])).applyInPandas(run, f"{schema}, shard int")


def weights(groups: DataFrame, timing: DataFrame, *, default: float = 5.0) -> DataFrame:
    """SCH2: groups with ``weight``, the seconds of verify and golden together from timing (sample, verify_s, golden_s); a
    sample without timing has the default. groups: (sample, ...)."""
    told = timing.select("sample", (F.coalesce("verify_s", F.lit(0.0)) + F.coalesce("golden_s", F.lit(0.0))).alias("weight"))
    return groups.join(told, "sample", "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def arbitrate(candidates: DataFrame, keys: list[str], *, passed: str, lines: str, order: list[str], digits: int = 3) -> DataFrame:
    """Candidates with ``score`` and ``rank`` by it: half for depth and a fifth for passing (both all or nothing), 0.3
    for a short patch in relation to the longest of its group; of equal scores the first in order."""
    most = F.greatest(F.max(lines).over(Window.partitionBy(*keys)), F.lit(1))
    ok = F.coalesce(F.col(passed), F.lit(False)).cast("int")
    score = F.bround(0.5 * ok + 0.3 * (1 - F.coalesce(F.col(lines), F.lit(0)) / most) + 0.2 * ok, digits)
    ranked = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(ranked))


def preferred(rows: DataFrame, keys: list[str], column: str, preference: list[str], order: list[str]) -> DataFrame:
    """T5: of each key the row whose ``column`` comes first in the preference, of equals the first in order; values that
    aren't in it don't count."""
    rank = F.array_position(F.array(*[F.lit(x) for x in preference]), F.col(column))
    kept = rows.where(F.col(column).isin(preference)).groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(rank, *order)).alias("__row"))
    return kept.select("__row.*")


#: Signals that are shown first, in this order, and beginnings of names that aren't shown.
SHOWN = [
    "clk", "rst_n", "state", "state_d", "cnt", "cnt_d", "count", "count_d", "step_cnt", "step_cnt_d", "head", "tail", "full", "empty",
    "half_full", "wr_en", "rd_en", "cnt_en", "en", "start", "valid", "ready", "done",
]
HIDDEN = ["any", "_", "$", "smt_", "mem"]


def signals_to_show(signals: DataFrame, *, most: int = 12) -> DataFrame:
    """(trace_id, sig, rank): ``most`` signals of each trace, those of SHOWN first, then others as they come. signals:
    (trace_id, sig, ord)."""
    place = F.array_position(F.array(*[F.lit(x) for x in SHOWN]), F.col("sig"))
    hidden = F.exists(F.array(*[F.lit(x) for x in HIDDEN]), lambda p: F.col("sig").startswith(p))
    rows = signals.withColumn("__p", F.when(place > 0, place).otherwise(len(SHOWN) + 1)).where((place > 0) | ~hidden)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy("__p", "ord")))
    return ranked.where(F.col("rank") <= most).select("trace_id", "sig", "rank")


def category(value: Column, known: dict[str, str]) -> Column:
    """The category of a value: an exact match, else the first known name in it, else itself; "?" without one."""
    exact = F.coalesce(*[F.when(value == k, v) for k, v in known.items()])
    inside = F.coalesce(*[F.when(F.contains(value, F.lit(k)), v) for k, v in known.items() if k])
    return F.coalesce(exact, inside, F.nullif(value, F.lit("")), F.lit("?"))


def session_cost(ledger: DataFrame) -> DataFrame:
    """(session, calls, cost) of a ledger."""
    return ledger.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 8).alias("cost"))


def pivoted(rows: DataFrame, keys: list[str], column: str, values: list[str], measure: Column) -> DataFrame:
    """A4, A5: a dense matrix: a row for each key, a column for each value, null where there is no row."""
    return rows.groupBy(*keys).pivot(column, values).agg(measure)


def spread(rows: DataFrame, by: list[str], seed: str, measure: Column) -> DataFrame:
    """(by, lowest, highest, spread) of a measure taken for each seed on its own."""
    each = rows.groupBy(*by, seed).agg(measure.alias("__m"))
    return each.groupBy(*by).agg(F.min("__m").alias("lowest"), F.max("__m").alias("highest"), (F.max("__m") - F.min("__m")).alias("spread"))


def flips(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """New rows whose value isn't that of the old row with their key; without an old row there is no flip."""
    told = old.select(*keys, F.col(column).alias("__old"))
    return new.join(told, keys).where(~F.col("__old").eqNullSafe(F.col(column))).drop("__old")


def unresolved(used: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are used but not known."""
    return used.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def round_robin_sample(rows: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """SCH3: one of each stratum in turn, in order of the strata, until n are taken."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.where(F.col("rn") <= n).orderBy("rn", stratum).limit(n)
