"""Rollups of result rows: matrices, spreads, coverage, confusion, ratings, locations, depths and ablations.

Rows are what their callers have; columns are named or given as expressions, so the same operator serves any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import upper_median


def _n() -> Column:
    return F.count(F.lit(1))


def sufficiency(rows: DataFrame, by: list[str], *, killed: Column, line: str, most: int = 5) -> DataFrame:
    """(by, total, killed, rate, lines): how many variants of each group were found, and its first lines, distinct
    and sorted."""
    out = rows.groupBy(*by).agg(_n().alias("total"), F.count_if(killed).alias("killed"), F.sort_array(F.collect_set(line)).alias("__l"))
    return out.select(*by, "total", "killed", (F.col("killed") / F.col("total")).alias("rate"), F.slice("__l", 1, most).alias("lines"))


def timing(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """(by, total, largest, median), the median being the upper one of an even number."""
    sums = rows.groupBy(*by).agg(F.sum(seconds).alias("total"), F.max(seconds).alias("largest"))
    return sums.join(upper_median(rows, by, seconds).withColumnRenamed(seconds, "median"), by, "left")


def compression(documents: DataFrame, by: list[str], *, raw: Column, slim: Column) -> DataFrame:
    """(by, raw, slim, saved): the characters of all documents before and after, and the share saved."""
    out = documents.groupBy(*by).agg(F.sum(F.length(raw)).alias("raw"), F.sum(F.length(slim)).alias("slim"))
    return out.withColumn("saved", F.when(F.col("raw") > 0, 1 - F.col("slim") / F.col("raw")))


def best_of(rows: DataFrame, by: list[str], *, passed: Column, choose: str, order: list[str]) -> DataFrame:
    """(by, any_pass, best, seen): whether any row passed, ``choose`` of the first row in order, and all its values."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.bool_or(passed), F.lit(False)).alias("any_pass"), F.min_by(choose, F.struct(*order)).alias("best"), F.sort_array(F.collect_set(choose)).alias("seen")
    )


def confusion(rows: DataFrame, by: list[str], *, claimed: Column, checked: Column) -> DataFrame:
    """(by, n, false_pass, false_fail, errors): claims that a check refutes, refusals that it accepts, and rows that it
    couldn't decide."""
    return rows.groupBy(*by).agg(
        _n().alias("n"), F.count_if(claimed & ~checked).alias("false_pass"), F.count_if(~claimed & checked).alias("false_fail"), F.count_if(checked.isNull()).alias("errors")
    )


def match_rate(rows: DataFrame, by: list[str], match: Column) -> DataFrame:
    """(by, matched, differing, failed, rate) of a match that is true, false or null (an error)."""
    counts = [F.count_if(match).alias("matched"), F.count_if(~match).alias("differing"), F.count_if(match.isNull()).alias("failed")]
    out = rows.groupBy(*by).agg(*counts)
    known = F.col("matched") + F.col("differing")
    return out.withColumn("rate", F.when(known > 0, F.col("matched") / known))


def ratings(rows: DataFrame, by: list[str], scores: Column) -> DataFrame:
    """(by, dim, n, lo, hi, total, mean) of a map of ratings by dimension; ratings that are null don't count."""
    each = rows.select(*by, F.explode(scores).alias("dim", "score")).where("score is not null")
    measures = [_n().alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("score").alias("total"), F.avg("score").alias("mean")]
    return each.groupBy(*by, "dim").agg(*measures)


def accuracy(rows: DataFrame, outer: str, inner: str, hit: Column) -> DataFrame:
    """(outer, inner, hits, n) with totals: null stands for all."""
    return rows.rollup(outer, inner).agg(F.count_if(hit).alias("hits"), _n().alias("n"))


def depths(rows: DataFrame, by: list[str], *, passed: Column, depth: str, base: Column | int, more: int = 2) -> DataFrame:
    """(by, state, converged, n, rate): a group is sufficient if it passed at ``more`` steps beyond the base depth;
    how many of its rows converged."""
    out = rows.groupBy(*by).agg(F.max(F.when(passed, F.col(depth))).alias("__d"), F.count_if(passed).alias("converged"), _n().alias("n"))
    floor = (F.lit(base) if isinstance(base, int) else base) + more
    state = F.when(F.col("__d") >= floor, "sufficient").otherwise("insufficient")
    return out.select(*by, state.alias("state"), "converged", "n", (F.col("converged") / F.col("n")).alias("rate"))


def locations(rows: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, n, locs): the locations of each group, sorted, with repeats."""
    return rows.groupBy(*by).agg(_n().alias("n"), F.sort_array(F.collect_list(line)).alias("locs"))


def crosstab(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n)"""
    return rows.groupBy(*by).agg(_n().alias("n"))


def ablation(rows: DataFrame, category: str, *, setting: str, base: str, other: str, hit: Column) -> DataFrame:
    """(category, n_base, n_other, delta) of hits in two settings, by category and, where it is null, over all."""
    count = lambda s: F.count_if((F.col(setting) == s) & hit)
    out = rows.rollup(category).agg(count(base).alias("n_base"), count(other).alias("n_other"))
    return out.withColumn("delta", F.col("n_other") - F.col("n_base"))


def either_side(a: DataFrame, b: DataFrame, keys: list[str], default) -> DataFrame:
    """Rows of both by key; columns of a side that lacks the key have the default."""
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(c, F.lit(default)).alias(c) for c in joined.columns if c not in keys])


def looked_up(rows: DataFrame, table: DataFrame, key: str, column: str, *, missing: str = "?") -> DataFrame:
    """Rows with a column of a table by key; the join is a broadcast if Spark finds the table small."""
    return rows.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def only_tasks(rows: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are among the tasks, each once however often a task is named."""
    return rows.join(tasks.select(*keys), keys, "left_semi")


def task_grid(samples: DataFrame, **axes: list) -> DataFrame:
    """Every sample with every combination of the axes, which are short lists; samples meet no other table."""
    out = samples
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def largest(rows: DataFrame, by: list[str], n: int, *, measure: Column | None = None) -> DataFrame:
    """The n groups of most rows (or of the largest measure), equals in order of their keys."""
    out = rows.groupBy(*by).agg((measure if measure is not None else _n()).alias("n"))
    return out.orderBy(F.desc("n"), *by).limit(n)


def both_and_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO2: (columns, side): distinct rows of both tables, and those that only the first has."""
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


def stacked(*tables: DataFrame) -> DataFrame:
    """SO1: all rows of all tables; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
