"""Scans of long ordered sequences in pieces: running states, places in a global order, exact order statistics.

A sequence (all rows of a key, in order) is cut into pieces that tasks scan independently. Each piece has a total; the totals
of a key's earlier pieces are combined into what the piece starts with. So any associative state (sum, last value, maximum,
previous row) runs over a sequence of any length without one task that sorts all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import settled

#: Rows of a piece, about.
PIECE_ROWS = 100_000
Pick = Callable[[Column, Column], Column]


@dataclass
class State:
    """An associative state. ``inside``: its value at a row from the rows of its own piece, given the order; ``total``: that of a whole
    piece, given a function that picks a value at its last row of a condition; ``carried``: that of all earlier pieces, from their totals;
    ``merge``: both together."""

    inside: Callable[[WindowSpec], Column]
    total: Callable[[Pick], Column]
    carried: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _upto(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(value: Column) -> State:
    """The sum up to the row, nulls as 0."""
    v = F.coalesce(value, F.lit(0))
    return State(lambda w: F.sum(v).over(_upto(w)), lambda _: F.sum(v), lambda t, w: F.sum(t).over(w), lambda own, before: own + F.coalesce(before, F.lit(0)))


def row_number() -> State:
    """The row's place, from 1."""
    return running_sum(F.lit(1).cast("long"))


def running_max(value: Column) -> State:
    """The largest value up to the row, without nulls; null before the first."""
    return State(lambda w: F.max(value).over(_upto(w)), lambda _: F.max(value), lambda t, w: F.max(t).over(w), lambda own, before: F.greatest(own, before))


def last_known(value: Column) -> State:
    """The last value that isn't null up to the row."""
    return State(lambda w: F.last(value, ignorenulls=True).over(_upto(w)), lambda pick: pick(value, value.isNotNull()), lambda t, w: F.last(t, ignorenulls=True).over(w), lambda own, before: F.coalesce(own, before))


def previous(value: Column) -> State:
    """struct(v) of the row before, null at the first; a null value of that row is a null field, so the two differ."""
    told = F.struct(value.alias("v"))
    return State(lambda w: F.lag(told).over(w), lambda pick: pick(told, F.lit(True)), lambda t, w: F.last(t, ignorenulls=True).over(w), lambda own, before: F.coalesce(own, before))


def by_width(at: Column, width: float) -> Column:
    """A piece for each so wide span of a number."""
    return F.floor(at / F.lit(width))


def piece_width(rows: DataFrame, at: str, *, target: int = PIECE_ROWS) -> float:
    """The width at which pieces of evenly spread rows have about ``target`` of them, all keys together: from count and range."""
    n, low, high = rows.agg(F.count(at), F.min(at), F.max(at)).first()
    return 1.0 if not n or high == low else max(1e-9, float(high - low) * target / n)


def segmented_scan(rows: DataFrame, keys: list[str], order: list[str], piece: Column, states: dict[str, State], *, backward: bool = False) -> DataFrame:
    """rows with a column for each state, scanned along ``order`` within ``keys``.

    ``piece`` never falls along the order (rises never, if ``backward``, which scans from the end), and equal rows of the order share one. Rows of equal
    keys and order have no fixed order among themselves. Null keys are a sequence of their own.
    """
    turn = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    # One struct for keys and piece: never null, and partitioned alike by the windows, the totals and the join.
    cut = rows.withColumn("__key", F.struct(*keys, piece.alias("__piece")))
    within = Window.partitionBy("__key").orderBy(*map(turn, order))
    at, ends = F.struct(*order), F.min_by if backward else F.max_by
    pick = lambda value, where: ends(value, F.when(where, at))
    totals = cut.groupBy("__key").agg(*[s.total(pick).alias(f"__t_{n}") for n, s in states.items()])
    of_keys = F.struct(*[F.col(f"__key.{k}") for k in keys]) if keys else F.lit(0)
    earlier = Window.partitionBy(of_keys).orderBy(turn("__key.__piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__key", *[s.carried(F.col(f"__t_{n}"), earlier).alias(f"__c_{n}") for n, s in states.items()])
    scanned = cut.select("*", *[s.inside(within).alias(f"__own_{n}") for n, s in states.items()])
    out = scanned.join(carried, "__key", "left")
    return out.select(*[c for c in rows.columns if c not in states], *[s.merge(F.col(f"__own_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in states.items()])


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``__piece``, the place of a range of the order; ranges have about as many rows each, ties together. Written, since
    the ranges come from a sample."""
    return settled(rows.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id()))


def numbered(rows: DataFrame, order: list[str], *, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """Rows with their place in the order, from 1, of all rows or within ``by``. Ranges of the order are sorted apart, and each place is counted
    on from the earlier ranges' rows. Rows that the order doesn't tell apart get places in no fixed order."""
    keys = by or []
    cut = in_ranges(rows, [*keys, *order])
    return segmented_scan(cut, keys, order, F.col("__piece"), {name: row_number()}).select(*rows.columns, name)


#: Bins of a round of a selection; groups with fewer rows left are sorted.
BINS, FEW = 1024, 2048
#: As many groups' states at most are sent to every task; more are joined.
BROADCAST_GROUPS = 100_000


def order_statistic(rows: DataFrame, by: list[str], value: str, place: Callable[[Column], Column]) -> DataFrame:
    """(by, n, value): the value at ``place(n)`` (from 0) of each group's sorted values that aren't null; groups without one are absent.

    Selection by rounds of histograms: each round counts the values of a group's interval in BINS bins and goes on with the bin that
    holds the place, until few values are left or all are equal. A group's values never meet in one task.
    """
    keys, v = by or ["__all"], F.col(value)
    some = rows.where(v.isNotNull()).withColumn("__all", F.lit(0)).select(*keys, v.alias("__v"))
    state = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    at = F.greatest(F.lit(0), F.least(F.col("__n") - 1, place(F.col("__n")))).cast("long")
    state = settled(state.select(*keys, "__n", "__lo", "__hi", at.alias("__k"), F.col("__n").alias("__left")))
    small = state.count() <= BROADCAST_GROUPS
    order = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def left_of(state: DataFrame) -> DataFrame:
        return some.join(F.broadcast(state) if small else state, keys).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))

    for _ in range(64):
        wide = state.where((F.col("__lo") < F.col("__hi")) & (F.col("__left") > FEW))
        if wide.isEmpty():
            break
        lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
        place_of = F.least(F.lit(BINS - 1), F.floor((F.col("__v").cast("double") - lo) / (hi - lo) * BINS))
        bins = left_of(wide).groupBy(*keys, "__n", "__k", place_of.alias("__bin")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        before = F.col("__upto") - F.col("__c")
        hit = bins.withColumn("__upto", F.sum("__c").over(order)).where((F.col("__upto") > F.col("__k")) & (before <= F.col("__k")))
        hit = hit.select(*keys, "__n", "__lo", "__hi", (F.col("__k") - before).alias("__k"), F.col("__c").alias("__left"))
        kept = state.where((F.col("__lo") >= F.col("__hi")) | (F.col("__left") <= FEW))
        state = settled(kept.union(hit).coalesce(max(1, state.rdd.getNumPartitions())))
    few = left_of(state.where("__lo < __hi")).groupBy(*keys, "__n", "__k").agg(F.sort_array(F.collect_list("__v")).alias("__s"))  # FEW values a group at most
    few = few.select(*keys, F.col("__n").alias("n"), F.element_at("__s", (F.col("__k") + 1).cast("int")).alias(value))
    return few.unionByName(state.where("__lo >= __hi").select(*keys, F.col("__n").alias("n"), F.col("__lo").alias(value))).select(*by, "n", value)
