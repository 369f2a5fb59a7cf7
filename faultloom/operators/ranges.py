"""Joins by ranges: points in intervals, nearest neighbours, and the first place at which a series falls to a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import scan as S

#: Widths of bins grow by this factor from level to level.
GROWTH = 16


def _level(length: Column, base: float) -> Column:
    """The least level whose bins are as wide as the interval, or the next."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1e-12)) / F.lit(base)) / F.log(F.lit(float(GROWTH))))).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, *, keys: list[str], at: str, start: str, stop: str, base: float = 1.0, hot: int = 100_000) -> DataFrame:
    """Points inner-joined with the intervals of their keys that hold them, start <= at < stop; a null stop is open.

    An interval stands in the few bins of its level that it touches, levels by length, so long ones take no more rows than short ones; a point looks
    up its bin of each level in use. ``base`` is the width of the finest bins. Bins of more than ``hot`` points are dealt
    to copies of their intervals. Null keys and null places join nothing; empty intervals (stop <= start) hold nothing. Column names must differ but for the keys.
    """
    top = points.agg(F.max(at)).first()[0]
    if top is None:
        top = 0
    ends = F.coalesce(F.col(stop), F.greatest(F.lit(top), F.col(start)) + 1)
    spans = intervals.withColumn("__end", ends).where(F.col("__end") > F.col(start)).withColumn("__level", _level(F.col("__end") - F.col(start), base))
    spans = settled(spans)
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # as many as widths, at most the digits of a number
    width = F.lit(base) * F.pow(F.lit(float(GROWTH)), F.col("__level"))
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col("__end") / width))
    binned = spans.withColumn("__bin", F.explode(bins))
    each = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    each = each.withColumn("__bin", F.floor(F.col(at) / width))
    place = [*keys, "__level", "__bin"]
    crowded = each.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
    crowded = settled(crowded.select(*place, F.ceil(F.col("__n") / hot).cast("int").alias("__copies")))
    if crowded.isEmpty():
        met = each.join(binned, place)
    else:
        copies = F.coalesce("__copies", F.lit(1))
        dealt = each.join(crowded, place, "left").withColumn("__copy", F.pmod(F.xxhash64(*points.columns), copies).cast("int")).drop("__copies")
        copied = binned.join(crowded, place, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
        met = dealt.join(copied, [*place, "__copy"])
    held = met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col("__end")))
    return held.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def nearest_join(left: DataFrame, right: DataFrame, *, keys: list[str], at: str, piece: float | None = None) -> DataFrame:
    """Left with ``near`` (the nearest row of right of the same keys, as a struct) and ``distance``; of two as near that with the smaller
    place, of equal places the smallest row. Null if right has none; a null place has none and is nobody's neighbour.

    The tables are united and sorted in pieces of ``piece`` places; the last right row before and the first after each left row are carried across pieces.
    """
    told = F.struct(F.col(at), *[c for c in right.columns if c not in (*keys, at)])
    ours = left.withColumn("__left", F.struct(*left.columns))
    one = right.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(told).alias("__right"))
    both = ours.select(*keys, at, "__left", F.lit(None).cast(one.schema["__right"].dataType).alias("__right"))
    both = both.unionByName(one.select(*keys, at, F.lit(None).cast(ours.schema["__left"].dataType).alias("__left"), "__right"))
    width = piece or S.piece_width(both, at)
    cut = S.by_width(F.col(at), width)
    held = S.last_known(F.col("__right"))
    # a right row of the same place comes first in either direction: by a side that sorts it so
    fore = S.segmented_scan(both.withColumn("__side", F.col("__left").isNotNull()), keys, [at, "__side"], cut, {"__before": held})
    after = S.segmented_scan(fore.withColumn("__side", F.col("__left").isNull()), keys, [at, "__side"], cut, {"__after": held}, backward=True)
    back, ahead = F.col(at) - F.col(f"__before.{at}"), F.col(f"__after.{at}") - F.col(at)
    near = F.when(F.col(at).isNull(), None).when(back.isNull() | (ahead < back), F.col("__after")).otherwise(F.col("__before"))
    out = after.where(F.col("__left").isNotNull()).select("__left.*", near.alias("near"))
    return out.withColumn("distance", F.abs(F.col(at) - F.col(f"near.{at}")))


def first_at_most(queries: DataFrame, series: DataFrame, *, keys: list[str], width: int = 1024) -> DataFrame:
    """queries (keys, from, bound, ...) with ``hit``: the first place ``at`` >= from of the keys' series (keys, at, value) whose value is at most bound; null if none.

    Places are whole numbers from 0. A series is searched in blocks of ``width`` places; a query that its own block doesn't answer looks for the first later block by the
    blocks' minima, which are a series themselves.
    """
    block = F.floor(F.col("at") / width).cast("long")
    blocks = series.groupBy(*keys, block.alias("__block")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("__part"), F.min("value").alias("__low"))
    blocks = settled(blocks)
    asked = settled(queries.withColumn("__q", F.monotonically_increasing_id()))

    def search(rows: DataFrame) -> DataFrame:
        fit = F.filter("__part", lambda x: (x["at"] >= F.col("from")) & (x["value"] <= F.col("bound")))
        return rows.join(blocks, [*keys, "__block"], "left").withColumn("hit", F.try_element_at(fit, F.lit(1))["at"]).drop("__part", "__low")

    own = settled(search(asked.withColumn("__block", F.floor(F.col("from") / width).cast("long"))))
    done, open_ = own.where("hit is not null"), own.where("hit is null")
    most = blocks.agg(F.max("__block")).first()[0]
    if most:
        coarse = blocks.select(*keys, F.col("__block").alias("at"), F.col("__low").alias("value"))
        later = first_at_most(open_.select(*keys, (F.col("__block") + 1).alias("from"), "bound", F.col("__q").alias("__up")), coarse, keys=keys, width=width)
        found = open_.drop("hit", "__block").join(later.select(F.col("__up").alias("__q"), F.col("hit").alias("__block")), "__q")
        done = done.unionByName(search(found))
    else:
        done = own
    return done.select(*queries.columns, "hit")


def spans(starts: DataFrame, *, keys: list[str], at: str, width: float | None = None, stop: str = "stop") -> DataFrame:
    """starts with ``stop``, the next place of the same keys; null at the last. Sorted in pieces."""
    piece = S.by_width(F.col(at), width or S.piece_width(starts, at))
    out = S.segmented_scan(starts, keys, [at], piece, {"__next": S.previous(F.col(at))}, backward=True)
    return out.select(*starts.columns, F.col("__next.v").alias(stop))

