"""Paired and interval statistics as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan as S

Z = 1.959964


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """ST1: struct(p, low, high) of a share; all 0 if n is 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p = k / m
    d = 1 + z * z / m
    mid, half = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    at = lambda x: F.when(n == 0, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.struct(at(p).alias("p"), at(mid - half).alias("low"), at(mid + half).alias("high"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(x: Column) -> Column:
    """log of the gamma function of x >= 1: a Stirling series, after a shift by eight."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    y = x + 8.0
    z = 1.0 / (y * y)
    series = (1 / 12.0 - z * (1 / 360.0 - z * (1 / 1260.0 - z * (1 / 1680.0)))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def _log_half_pmf(k: Column, n: Column) -> Column:
    """log of the binomial probability of k of n at one half."""
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * 0.6931471805599453


def half_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair coins, for k < n / 2: the regularised incomplete beta function by its continued fraction, whose steps
    grow with the root of n. Memory of a row doesn't grow with n but for the numbers of the steps."""
    a, b = (n - k).cast("double"), (k + 1).cast("double")
    steps = F.sequence(F.lit(1), (F.lit(30) + F.ceil(4 * F.sqrt(n))).cast("int"))
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = 1.0 / safe(1.0 - (a + b) / (a + 1.0) * 0.5)

    def step(s: Column, i: Column) -> Column:
        even = i * (b - i) * 0.5 / ((a + 2 * i - 1) * (a + 2 * i))
        odd = -(a + i) * (a + b + i) * 0.5 / ((a + 2 * i) * (a + 2 * i + 1))

        def turn(s: Column, f: Column) -> Column:
            made = F.struct(safe(1.0 + f / s["c"]).alias("c"), (1.0 / safe(1.0 + f * s["d"])).alias("d"), s["h"].alias("h"))
            return _let(made, lambda m: F.struct(m["c"].alias("c"), m["d"].alias("d"), (m["h"] * m["c"] * m["d"]).alias("h")))

        return _let(turn(s, even), lambda m: turn(m, odd))

    begin = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))
    h = F.aggregate(steps, begin, step, lambda s: s["h"])
    return F.exp(_log_half_pmf(k, n)) * 0.5 * h  # half the probability of k is what stands before the fraction


def _lower(least: Column, n: Column) -> Column:
    """The largest k up to n / 2 whose probability isn't over that of ``least`` by more than 1e-15; bisected, as probabilities rise up to the middle."""

    def bisect(bound: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2)
            moved = _let(mid, lambda m: F.when(F.exp(_log_half_pmf(m, n)) <= bound, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi"))))
            return F.when(s["lo"] >= s["hi"], s).otherwise(moved)

        begin = F.struct(least.alias("lo"), F.floor(n / 2).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double") + 2)).cast("int")), begin, halve, lambda s: s["lo"])

    return _let(F.exp(_log_half_pmf(least, n)) + 1e-15, bisect)


def _twice(k: Column, n: Column) -> Column:
    """Twice the lower tail at k, 1 at most."""
    return F.when(2 * k >= n - 1, 1.0).otherwise(F.least(2 * half_tail(k, n), F.lit(1.0)))


def _paired(b: Column, c: Column, p) -> Column:
    """p(the lesser, the sum) of two counts; 1 if both are 0, null if one is null."""
    counts = F.struct(F.least(b, c).cast("long").alias("k"), (b + c).cast("long").alias("n"))
    return F.when(b.isNull() | c.isNull(), None).when((b == 0) & (c == 0), 1.0).otherwise(_let(counts, lambda x: p(x["k"], x["n"])))


def mcnemar(b: Column, c: Column) -> Column:
    """ST2: exact two-sided p: the sum of all probabilities that aren't over that of b; 1 without discordance. Null counts have a null p."""
    return _paired(b, c, lambda k, n: _let(_lower(k, n), lambda low: _twice(low, n)))


def mcnemar_doubled(b: Column, c: Column) -> Column:
    """ST3: twice the lower tail, 1 at most, rounded to 4 places."""
    return F.bround(_paired(b, c, _twice), 4)


def holm(tests: DataFrame, p: str = "p", *, partition: list[str] | None = None, order: list[str] | None = None, piece: int = S.PIECE_ROWS) -> DataFrame:
    """ST4, WF3: p_holm, which never falls from a smaller to a larger p and is 1 at most.

    Tests get their places by ``scan.numbered``, and the largest value so far is carried over pieces of ``piece`` places, so neither a large family nor many
    equal p are one task's work. A null p has no p_holm and no rank. Equal p have equal p_holm.
    """
    keys = partition or []
    known = tests.where(F.col(p).isNotNull())
    ranked = S.numbered(known, [p, *(order or [])], by=keys, name="__rank")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    ranked = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))  # one row
    value = F.col(p) * (F.col("__m") - F.col("__rank") + 1)
    out = S.segmented_scan(ranked, keys, ["__rank"], F.floor(F.col("__rank") / piece), {"__top": S.running_max(value)})
    out = out.select(*tests.columns, F.least(F.lit(1.0), F.col("__top")).alias("p_holm"))
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def risk_difference(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """ST6: struct(diff, low, high) of two shares with an unpaired Wald interval."""
    p1, p2 = k1 / F.greatest(n1, F.lit(1)), k2 / F.greatest(n2, F.lit(1))
    half = 1.96 * F.sqrt(p1 * (1 - p1) / F.greatest(n1, F.lit(1)) + p2 * (1 - p2) / F.greatest(n2, F.lit(1)))
    return F.struct((p1 - p2).alias("diff"), (p1 - p2 - half).alias("low"), (p1 - p2 + half).alias("high"))


def paired_table(a: Column, b: Column) -> list[Column]:
    """ST8: counts of both, only the first, only the second, neither."""
    return [F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00")]


def icc21(scores: DataFrame, group: list[str], subject: str, rater: str, value: str) -> DataFrame:
    """ST7: ICC(2,1) for each group over subjects that all raters scored; null where it isn't defined."""
    raters = scores.where(F.col(value).isNotNull()).groupBy(*group).agg(F.countDistinct(rater).alias("k"))
    counted = scores.where(F.col(value).isNotNull()).join(raters, group)
    per = Window.partitionBy(*group, subject)
    full = counted.withColumn("__n", F.count(F.lit(1)).over(per)).where(F.col("__n") == F.col("k"))
    v = F.col(value).cast("double")
    rows = full.groupBy(*group, subject).agg(F.avg(v).alias("m"))
    cols = full.groupBy(*group, rater).agg(F.avg(v).alias("m"))
    base = full.groupBy(*group).agg(F.avg(v).alias("g"), F.var_pop(v).alias("var"), F.countDistinct(subject).alias("n"), F.max("k").alias("k"))
    ms = base.join(rows.groupBy(*group).agg(F.var_pop("m").alias("vr")), group).join(cols.groupBy(*group).agg(F.var_pop("m").alias("vc")), group)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ssr, ssc, sst = k * n * F.col("vr"), n * k * F.col("vc"), n * k * F.col("var")
    msr, msc, mse = ssr / (n - 1), ssc / (k - 1), (sst - ssr - ssc) / ((n - 1) * (k - 1))
    den = msr + (k - 1) * mse + k * (msc - mse) / n
    ok = (F.col("n") >= 3) & (F.col("k") >= 2)
    return ms.select(*group, "n", "k", F.when(ok, F.when(den > 0, (msr - mse) / den)).alias("icc"))


def cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """ST11"""
    return F.bround((input_tokens * price_in + output_tokens * price_out) / 1e6, 8)


def estimate_tokens(text: Column) -> Column:
    """ST11"""
    return F.floor(F.length(text) / 4).cast("long") + 1
