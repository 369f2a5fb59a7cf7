"""Operators on traces: cycles, sampling, change detection, windows, holding, alignment and differences.

A trace is a set of changes (trace_id, pos, ts, sig, val), optionally with vid, the declared id behind a
name. ``pos`` orders changes, also those of one time. Any number of traces runs at once, and a long one is
scanned in pieces (``scan.segmented_scan``). Held values are run-length: a row for each change, good until ``stop``, the next one
(null: to the end); only ``hold``, which is asked for it, gives a row for each cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan as S
from .ranges import spans

EDGE_VALUES = ["1", "01", "001"]
#: Cycles of a piece of a scan.
PIECE_CYCLES = 1 << 16


def _piece(width: int) -> Column:
    return S.by_width(F.col("cycle"), width)


def with_cycles(changes: DataFrame, edge: Column, *, span: int | None = None) -> DataFrame:
    """Each change's cycle, the number of clock edges up to its time.

    ``edge`` tells which changes are edges. All changes of one time share a cycle, whatever their order.
    Without an edge all is cycle 0. No range join. With ``span`` (ticks) a trace is sorted in pieces of that
    length, each of which gets the number of edges before it: a long trace then isn't one task's work.
    """
    upto = Window.partitionBy("trace_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.sum(F.when(edge, 1).otherwise(0))
    if span is None:
        return changes.withColumn("cycle", count.over(upto).cast("long"))
    rows = changes.withColumn("__piece", F.floor(F.col("ts") / span))
    before = Window.partitionBy("trace_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("trace_id", "__piece").agg(count.alias("__n"))
    ahead = ahead.select("trace_id", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("trace_id", "__piece").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("__own", count.over(inside)).join(ahead, ["trace_id", "__piece"])
    return counted.withColumn("cycle", (F.col("__own") + F.col("__ahead")).cast("long")).drop("__piece", "__own", "__ahead")


def cycle_starts(changes: DataFrame, edge: Column, *, span: int | None = None) -> DataFrame:
    """(trace_id, cycle, t0) of every cycle, also of those without a change: cycle 0 begins at 0. ``span`` as above."""
    edges = changes.where(edge).select("trace_id", "ts", "pos")
    key = [] if span is None else [F.floor(F.col("ts") / span)]
    order = Window.partitionBy("trace_id", *key).orderBy("ts", "pos")
    starts = edges.select("trace_id", *[k.alias("__piece") for k in key], F.row_number().over(order).cast("long").alias("cycle"), F.col("ts").alias("t0"))
    if key:
        before = Window.partitionBy("trace_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
        ahead = starts.groupBy("trace_id", "__piece").agg(F.count(F.lit(1)).alias("n"))
        ahead = ahead.select("trace_id", "__piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        starts = starts.join(ahead, ["trace_id", "__piece"]).select("trace_id", (F.col("cycle") + F.col("ahead")).alias("cycle"), "t0")
    zero = changes.select("trace_id").distinct().select("trace_id", F.lit(0).cast("long").alias("cycle"), F.lit(0).cast("long").alias("t0"))
    return zero.unionByName(starts)


def last_in_cycle(cycled: DataFrame) -> DataFrame:
    """(trace_id, cycle, sig, val), the last value by position.

    With a ``vid`` column, each id's last value counts, and of ids with one name that which first
    changed last.
    """
    if "vid" not in cycled.columns:
        return cycled.groupBy("trace_id", "cycle", "sig").agg(F.max_by("val", "pos").alias("val"))
    first = cycled.groupBy("trace_id", "vid").agg(F.min("pos").alias("first_pos"))
    by_id = cycled.groupBy("trace_id", "cycle", "vid", "sig").agg(F.max_by("val", "pos").alias("val"))
    joined = by_id.join(first, ["trace_id", "vid"])
    return joined.groupBy("trace_id", "cycle", "sig").agg(F.max_by("val", "first_pos").alias("val"))


def last_before_next_edge(cycled: DataFrame, *, tail: int = 1) -> DataFrame:
    """Like ``last_in_cycle``, but the final cycle is ``tail`` ticks wide."""
    starts = cycled.groupBy("trace_id", "cycle").agg(F.min("ts").alias("t0"))
    final = starts.groupBy("trace_id").agg(F.max("cycle").alias("__last"), F.max_by("t0", "cycle").alias("__t0"))
    kept = cycled.join(final, "trace_id").where((F.col("cycle") < F.col("__last")) | (F.col("ts") < F.col("__t0") + tail))
    return last_in_cycle(kept.drop("__last", "__t0"))


def state_trace(last: DataFrame, sigs: list[str]) -> DataFrame:
    """A row for each cycle with a column for each signal; null where it didn't change."""
    return last.where(F.col("sig").isin(sigs)).groupBy("trace_id", "cycle").pivot("sig", sigs).agg(F.first("val"))


def signal_list(changes: DataFrame) -> DataFrame:
    """W5, WF4: (trace_id, sig, ord): distinct signals in the order in which they are first seen."""
    first = changes.groupBy("trace_id", "sig").agg(F.min("pos").alias("first_pos"))
    order = Window.partitionBy("trace_id").orderBy("first_pos", "sig")
    return first.select("trace_id", "sig", F.row_number().over(order).alias("ord"))


def changed(last: DataFrame) -> DataFrame:
    """Rows whose value differs from that of the cycle just before. A signal that was silent for one
    cycle counts as changed."""
    w = Window.partitionBy("trace_id", "sig").orderBy("cycle")
    near = F.lag("cycle").over(w) == F.col("cycle") - 1
    same = near & (F.lag("val").over(w).eqNullSafe(F.col("val")))
    return last.withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")


def adaptive_window(fail_step: Column, window: int = 8) -> Column:
    """W8"""
    wide = F.greatest(F.lit(window), F.least(F.lit(24), F.floor(fail_step / 2).cast("int")))
    return F.when(fail_step.isNull(), F.lit(window)).otherwise(wide)


def indexed(cycles: DataFrame, *, width: int = PIECE_CYCLES) -> DataFrame:
    """cycles with ``__idx``, each cycle's place in its trace from 0; one row a cycle."""
    return S.segmented_scan(cycles, ["trace_id"], ["cycle"], _piece(width), {"__n": S.row_number()}).withColumn("__idx", F.col("__n") - 1).drop("__n")


def anchor_window(cycles: DataFrame, anchors: DataFrame, window: int | Column, *, every: int = 4, width: int = PIECE_CYCLES) -> DataFrame:
    """Cycles around an anchor, before them every fourth by index, after them none.

    cycles: (trace_id, cycle, ...) one row a cycle; anchors: (trace_id, anchor), one row a trace. ``is_gap`` marks the first
    row of the window if the row kept before it isn't its neighbour.
    """
    w = F.lit(window) if isinstance(window, int) else window
    rows = indexed(cycles, width=width).join(anchors, "trace_id")
    inside = F.col("cycle").between(F.col("anchor") - w, F.col("anchor") + w)
    before = (F.col("cycle") < F.col("anchor") - w) & (F.col("__idx") % every == 0)
    kept = rows.where(inside | before).withColumn("__in", inside)
    edges = kept.groupBy("trace_id").agg(F.min(F.when(F.col("__in"), F.col("cycle"))).alias("__first"), F.max(F.when(~F.col("__in"), F.col("cycle"))).alias("__before"))
    gap = (F.col("cycle") == F.col("__first")) & (F.col("__before") != F.col("__first") - 1)
    return kept.join(edges, "trace_id").withColumn("is_gap", F.coalesce(gap, F.lit(False))).drop("__idx", "__in", "__first", "__before", "anchor")


def slim(cycles: DataFrame, anchors: DataFrame, *, before: int = 4, every: int = 8, width: int = PIECE_CYCLES) -> DataFrame:
    """Cycles from ``before`` ahead of the anchor on, and every eighth by index."""
    rows = indexed(cycles, width=width).join(anchors, "trace_id")
    return rows.where((F.col("cycle") >= F.col("anchor") - before) | (F.col("__idx") % every == 0)).drop("__idx", "anchor")


def slim_array(rows: Column, fail_step: Column, *, before: int = 4, every: int = 8) -> Column:
    """W9 on an array of structs with a field ``cycle``."""
    return F.filter(rows, lambda r, i: (r["cycle"] >= fail_step - before) | (i % every == 0))


def runs(last: DataFrame, *, keys: tuple[str, ...] = ("trace_id", "sig"), width: int = PIECE_CYCLES) -> DataFrame:
    """W10, WF1: (keys, cycle, stop, val): each value that isn't null and the cycle at which another is set; it holds until there."""
    return spans(last.where("val is not null").select(*keys, "cycle", "val"), keys=list(keys), at="cycle", width=width)


def hold(last: DataFrame, *, width: int = PIECE_CYCLES) -> DataFrame:
    """W10, WF1: (trace_id, sig, cycle, val, held) for each signal of a trace and each cycle from 0 to the trace's last; val is null where the signal is silent, held where no value
    was set yet. A signal without a name holds nothing.

    The runs are laid out, in parts of ``width`` cycles at most, so neither a join with all cycles nor a window over them is needed.
    """
    keys = ["trace_id", "sig"]
    start = last.select(*keys).distinct().withColumn("cycle", F.lit(-1).cast("long")).withColumn("val", F.lit(None).cast(last.schema["val"].dataType))
    held = spans(start.unionByName(last.where("val is not null and sig is not null").select(*keys, "cycle", "val")), keys=keys, at="cycle", width=width)
    tops = last.groupBy("trace_id").agg(F.max("cycle").alias("__top"))
    laid = held.join(tops, "trace_id").withColumn("__from", F.greatest("cycle", F.lit(0))).withColumn("__to", F.coalesce(F.col("stop") - 1, F.col("__top"))).where("__from <= __to")
    part = F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor(F.col("__to") / width)))
    laid = laid.withColumn("__part", part)
    each = F.explode(F.sequence(F.greatest("__from", F.col("__part") * width), F.least("__to", (F.col("__part") + 1) * width - 1)))
    laid = laid.select(*keys, F.col("cycle").alias("__set"), F.col("val").alias("held"), each.alias("cycle"))
    return laid.select(*keys, "cycle", F.when(F.col("cycle") == F.col("__set"), F.col("held")).alias("val"), "held")


def held_at(last: DataFrame, cycles: DataFrame, *, keys: tuple[str, ...] = ("trace_id", "sig"), width: int = PIECE_CYCLES) -> DataFrame:
    """Cycles (keys, cycle) with ``held``, the last value that isn't null up to there; null before the first."""
    asked = cycles.select(*keys, "cycle", F.lit(None).cast(last.schema["val"].dataType).alias("val"), F.lit(1).alias("__asked"))
    both = asked.unionByName(last.select(*keys, "cycle", "val", F.lit(0).alias("__asked")))
    out = S.segmented_scan(both, list(keys), ["cycle", "__asked"], _piece(width), {"held": S.last_known(F.col("val"))})
    return out.where("__asked = 1").select(*keys, "cycle", "held")


def merged_runs(golden: DataFrame, buggy: DataFrame, *, keys: tuple[str, ...] = ("pair_id", "sig"), width: int = PIECE_CYCLES) -> DataFrame:
    """(keys, cycle, stop, golden, buggy): what both traces hold, a row for each cycle in which either sets a value; null before a trace's first.

    golden, buggy: (keys, cycle, val). Only keys that both have. The traces are joined where they change and scanned on, so long pauses cost nothing.
    """
    g = golden.where("val is not null").select(*keys, "cycle", F.col("val").alias("__g"))
    b = buggy.where("val is not null").select(*keys, "cycle", F.col("val").alias("__b"))
    common = golden.select(*keys).distinct().join(buggy.select(*keys).distinct(), list(keys))
    points = g.join(b, [*keys, "cycle"], "full_outer").join(common, list(keys), "left_semi")
    states = {"golden": S.last_known(F.col("__g")), "buggy": S.last_known(F.col("__b"))}
    held = S.segmented_scan(points, list(keys), ["cycle"], _piece(width), states).drop("__g", "__b")
    return spans(held, keys=list(keys), at="cycle", width=width).select(*keys, "cycle", "stop", "golden", "buggy")


def aligned_diff(golden: DataFrame, buggy: DataFrame) -> DataFrame:
    """(pair_id, sig, first_diff): the first cycle in which the values of a signal that both have
    differ; a value against none differs as well. Cycles run to the shorter trace's end.

    golden, buggy: (pair_id, cycle, sig, val), not held.
    """
    tops = golden.groupBy("pair_id").agg(F.max("cycle").alias("g")).join(buggy.groupBy("pair_id").agg(F.max("cycle").alias("b")), "pair_id")
    tops = tops.select("pair_id", F.least("g", "b").alias("top"))
    both = golden.select("pair_id", "sig").distinct().join(buggy.select("pair_id", "sig").distinct(), ["pair_id", "sig"]).join(tops, "pair_id")
    keys = ["pair_id", "sig", "cycle"]
    g = golden.select(*keys, F.col("val").alias("g"))
    joined = g.join(buggy.select(*keys, F.col("val").alias("b")), keys, "full_outer").join(both, ["pair_id", "sig"])
    differ = joined.where((F.col("cycle") <= F.col("top")) & ~F.col("g").eqNullSafe(F.col("b")))
    return differ.groupBy("pair_id", "sig").agg(F.min("cycle").alias("first_diff"))


def signature_match(golden: DataFrame, buggy: DataFrame) -> DataFrame:
    """(pair_id, match): whether no common signal differs; null if there is none in common."""
    pairs = golden.select("pair_id").union(buggy.select("pair_id")).distinct()
    common = golden.select("pair_id", "sig").distinct().join(buggy.select("pair_id", "sig").distinct(), ["pair_id", "sig"])
    common = common.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    differing = aligned_diff(golden, buggy).groupBy("pair_id").agg(F.count(F.lit(1)).alias("d"))
    out = pairs.join(common, "pair_id", "left").join(differing, "pair_id", "left")
    return out.select("pair_id", F.when(F.col("n") > 0, F.coalesce("d", F.lit(0)) == 0).alias("match"))


def diff_detail(golden: DataFrame, buggy: DataFrame, *, around: int = 4) -> DataFrame:
    """For each differing signal the held values of both within ``around`` cycles of the pair's first
    difference, as arrays ordered by cycle. Values are held within the window only."""
    diffs = aligned_diff(golden, buggy)
    first = diffs.groupBy("pair_id").agg(F.min("first_diff").alias("fa"))
    grid = diffs.join(first, "pair_id").select(
        "pair_id", "sig", "first_diff", F.explode(F.sequence(F.greatest(F.lit(0), F.col("fa") - around), F.col("fa") + around)).alias("cycle")
    )
    keys = ["pair_id", "sig", "cycle"]
    rows = grid.join(golden.select(*keys, F.col("val").alias("g")), keys, "left").join(buggy.select(*keys, F.col("val").alias("b")), keys, "left")
    w = Window.partitionBy("pair_id", "sig").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select(*keys, "first_diff", F.last("g", True).over(w).alias("g"), F.last("b", True).over(w).alias("b"))
    packed = held.groupBy("pair_id", "sig", "first_diff").agg(F.sort_array(F.collect_list(F.struct("cycle", "g", "b"))).alias("r"))
    return packed.select("pair_id", "sig", "first_diff", F.col("r.cycle").alias("cycles"), F.col("r.g").alias("golden"), F.col("r.b").alias("buggy"))


def stuck_against(golden: DataFrame, buggy: DataFrame) -> DataFrame:
    """(pair_id, sig) that move in the golden trace from the first difference on, but not in the other."""
    first = aligned_diff(golden, buggy).groupBy("pair_id").agg(F.min("first_diff").alias("fa"))
    count = lambda df, name: df.join(first, "pair_id").where("cycle >= fa").groupBy("pair_id", "sig").agg(F.countDistinct("val").alias(name))
    both = count(golden, "g").join(count(buggy, "b"), ["pair_id", "sig"], "left")
    return both.where((F.col("g") > 1) & (F.coalesce("b", F.lit(0)) <= 1)).select("pair_id", "sig")


def stuck_tail(last: DataFrame, *, tail: int = 6, least: int = 4) -> DataFrame:
    """(trace_id, sig, val): at least ``least`` of the last ``tail`` values that aren't null, all equal."""
    order = Window.partitionBy("trace_id", "sig").orderBy(F.desc("cycle"))
    end = last.where("val is not null").withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= tail)
    out = end.groupBy("trace_id", "sig").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("val").alias("d"), F.min("val").alias("val"))
    return out.where((F.col("n") >= least) & (F.col("d") == 1)).select("trace_id", "sig", "val")


def replay_diff(golden: DataFrame, buggy_steps: DataFrame, *, inputs: list[str] | None = None, ends: DataFrame | None = None, width: int = PIECE_CYCLES) -> DataFrame:
    """(trace_id, sig, first_diff): the first step, from 1 on, in which held values differ; golden's cycle i is the other's step i.

    Both traces: (trace_id, cycle, sig, val), sparse. Values are held from their first cycle on, 0 included, so a step counts also if only one side changes in it; a value
    differs from none. Text values are compared as ``to_decimal`` of them. ``ends``: (trace_id, end), the last step compared; without it values hold to the end.
    """
    keys, texts = ["trace_id", "sig"], golden.schema["val"].dataType.simpleString() == "string"
    told = lambda df: df.where(~F.col("sig").isin(inputs or [])).withColumn("val", to_decimal(F.lower(F.trim("val"))) if texts else F.col("val"))
    both = merged_runs(told(golden), told(buggy_steps), keys=("trace_id", "sig"), width=width)
    from_ = F.greatest(F.col("cycle"), F.lit(1))
    apart = both.where(~F.col("golden").eqNullSafe(F.col("buggy")) & (F.coalesce("stop", from_ + 1) > from_)).withColumn("first_diff", from_)
    if ends is not None:
        apart = apart.join(ends, "trace_id").where("first_diff <= end")
    return apart.groupBy(*keys).agg(F.min("first_diff").alias("first_diff"))


def flipped(last: DataFrame, anchors: DataFrame, window: int | Column) -> DataFrame:
    """(trace_id, sig) whose value changes from the last one within ``window`` cycles of the anchor."""
    w = F.lit(window) if isinstance(window, int) else window
    near = last.join(anchors, "trace_id").where((F.abs(F.col("cycle") - F.col("anchor")) <= w) & F.col("val").isNotNull())
    before = F.lag("val").over(Window.partitionBy("trace_id", "sig").orderBy("cycle"))
    moved = near.withColumn("__before", before).where(F.col("__before").isNotNull() & (F.col("__before") != F.col("val")))
    return moved.select("trace_id", "sig").distinct()


def value_trace(last: DataFrame) -> DataFrame:
    """(trace_id, cycle, vals): sorted "sig=val" of each cycle that has a value."""
    text = F.concat_ws("=", "sig", F.col("val").cast("string"))
    return last.where("val is not null").groupBy("trace_id", "cycle").agg(F.sort_array(F.collect_list(text)).alias("vals"))


def transition_divergence(both: DataFrame, *, width: int = PIECE_CYCLES) -> DataFrame:
    """W20, WF2: transitions that the golden trace makes and the other doesn't.

    both: as of ``merged_runs``. A row has the values held before and after; whatever changes, changes where a run begins.
    """
    before = {"__p": S.previous(F.struct("golden", "buggy"))}
    rows = S.segmented_scan(both, ["pair_id", "sig"], ["cycle"], _piece(width), before)
    p = F.col("__p.v")
    rows = rows.select("pair_id", "sig", "cycle", p["golden"].alias("g0"), F.col("golden").alias("g1"), p["buggy"].alias("b0"), F.col("buggy").alias("b1"))
    lost = F.col("b0").eqNullSafe(F.col("b1")) | (F.col("b1").isNotNull() & (F.col("b1") != F.col("g1")))
    return rows.where(F.col("g0").isNotNull() & F.col("g1").isNotNull() & (F.col("g0") != F.col("g1")) & lost)


def handshake_features(pairs: DataFrame, anchors: DataFrame, *, keys: tuple[str, ...] = ("trace_id",), ends: DataFrame | None = None, width: int = PIECE_CYCLES) -> DataFrame:
    """Eight features of each valid/ready pair.

    pairs: (trace_id, cycle, valid, ready) as 0, 1 or null, one row a cycle at most; held here, so silent cycles need no row. A cycle waits if valid is 1,
    ready 0 (not unknown) and none was ready before; cycles are counted by the length of runs, up to ``ends`` (trace_id, end), the trace's last cycle: without
    it that of the last row. A trace in which both are always null has no row. ``keys`` tell several pairs of a trace apart.
    """
    by = list(keys)
    held = S.segmented_scan(pairs, by, ["cycle"], _piece(width), {"v": S.last_known(F.col("valid")), "r": S.last_known(F.col("ready"))}).select(*by, "cycle", "v", "r")
    held = S.segmented_scan(held, by, ["cycle"], _piece(width), {"__p": S.previous(F.col("v"))})
    rows = spans(held.withColumn("pv", F.coalesce("__p.v", F.lit(0))).drop("__p"), keys=by, at="cycle", width=width)
    tops = pairs.groupBy("trace_id").agg(F.max("cycle").alias("end")) if ends is None else ends
    rows = rows.join(tops, "trace_id").join(anchors, "trace_id", "left")
    first = rows.groupBy(*by).agg(F.min(F.when(F.col("r") == 1, F.col("cycle"))).alias("fr"), F.min(F.when((F.col("v") == 1) & (F.col("pv") == 0), F.col("cycle"))).alias("fv"))
    stop = F.coalesce("stop", F.col("end") + 1)
    rows = rows.join(first, by).withColumn("__stop", stop)
    waits = (F.col("v") == 1) & (F.col("r") == 0) & (F.col("fr").isNull() | (F.col("cycle") < F.col("fr")))
    holds = (F.col("v") == 1) & (F.col("__stop") > F.col("fr"))
    failing = (F.col("cycle") <= F.col("anchor")) & (F.col("anchor") < F.col("__stop"))
    length = lambda where, start: F.coalesce(F.sum(F.when(where, F.col("__stop") - start)), F.lit(0)).cast("long")
    out = rows.groupBy(*by).agg(
        F.min("fv").alias("first_valid_rise"),
        F.min("fr").alias("first_ready"),
        length(waits, F.col("cycle")).alias("wait_cycles"),
        length(holds, F.greatest("cycle", "fr")).alias("hold_cycles"),
        F.coalesce(F.bool_or((F.col("pv") == 1) & (F.col("v") == 0)), F.lit(False)).alias("deassert_seen"),
        F.max(F.when(failing, F.col("v"))).alias("valid_at_fail"),
        F.max(F.when(failing, F.col("r"))).alias("ready_at_fail"),
        F.max(F.when(F.col("cycle") == F.col("fv"), F.col("r"))).alias("ready_at_valid_rise"),
        F.count_if(F.col("v").isNotNull() | F.col("r").isNotNull()).alias("__seen"),
    )
    return out.where("__seen > 0").drop("__seen")


#: The handshakes of each module, as valid/ready, and what must hold of them.
B, R, AW, W, AR = "S_AXI_BVALID/S_AXI_BREADY", "S_AXI_RVALID/S_AXI_RREADY", "S_AXI_AWVALID/S_AXI_AWREADY", "S_AXI_WVALID/S_AXI_WREADY", "S_AXI_ARVALID/S_AXI_ARREADY"
TX, RX = "tx_busy/txd", "rx_valid/rx_ready"
#: (module, name, kind, pair, pairs that must have been ready before it)
PROTOCOL_RULES = [
    ("axi_lite_slave", "bvalid_never_released", "stuck", B, ()),
    ("axi_lite_slave", "bready_never_raised", "unanswered", B, ()),
    ("axi_lite_slave", "bvalid_before_write_handshakes", "early", B, (AW, W)),
    ("axi_lite_slave", "rvalid_never_released", "stuck", R, ()),
    ("axi_lite_slave", "rvalid_before_address_handshake", "early", R, (AR,)),
    ("uart_tx", "busy_without_start_bit", "level", TX, ()),
    ("uart_rx", "rx_valid_never_released", "stuck", RX, ()),
]


def protocol_violations(features: DataFrame, modules: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(trace_id, violations): the names of the rules of its module that a trace breaks, in order.

    features: those of ``handshake_features`` by (trace_id, pair); modules: (trace_id, module). A pair that a trace
    lacks breaks nothing. Kinds: ``stuck``, valid rose and never fell; ``unanswered``, it rose and nothing was ever
    ready; ``early``, it rose before all the other pairs were ready; ``level``, ready was 1 as it rose.
    """
    fields = F.struct("first_valid_rise", "first_ready", "deassert_seen", "ready_at_valid_rise")
    by_pair = features.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("pair", fields))).alias("m"))

    def broken(kind: str, pair: str, others: tuple) -> Column:
        f = F.try_element_at("m", F.lit(pair))
        rose = f["first_valid_rise"]
        if kind == "stuck":
            return rose.isNotNull() & ~f["deassert_seen"]
        if kind == "unanswered":
            return rose.isNotNull() & f["first_ready"].isNull()
        if kind == "level":
            return rose.isNotNull() & (f["ready_at_valid_rise"] == 1)
        ready = [F.try_element_at("m", F.lit(p))["first_ready"] for p in others]
        known = rose.isNotNull()
        for x in ready:
            known = known & x.isNotNull()
        return known & (rose < (F.greatest(*ready) if len(ready) > 1 else ready[0]))

    found = [F.when((F.col("module") == m) & broken(kind, pair, others), F.lit(name)) for m, name, kind, pair, others in rules or PROTOCOL_RULES]
    rows = modules.select("trace_id", "module").join(by_pair, "trace_id")
    return rows.select("trace_id", F.array_compact(F.array(*found)).alias("violations"))


def counterexample_delta(old: DataFrame, new: DataFrame, old_step: DataFrame, new_step: DataFrame) -> DataFrame:
    """(trace_id, step_move, moved_signals): by how much the failing step moved between two
    counterexamples, and which signals have another value at their failing rows."""
    at = lambda df, step: df.join(step, "trace_id").where("cycle = fail_step").select("trace_id", "sig", "val")
    o, n = at(old, old_step).withColumnRenamed("val", "o"), at(new, new_step).withColumnRenamed("val", "n")
    moved = n.join(o, ["trace_id", "sig"], "left").where(F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("o")))
    moved = moved.groupBy("trace_id").agg(F.sort_array(F.collect_set("sig")).alias("moved_signals"))
    steps = old_step.withColumnRenamed("fail_step", "a").join(new_step.withColumnRenamed("fail_step", "b"), "trace_id")
    steps = steps.select("trace_id", (F.col("b") - F.col("a")).alias("step_move")).join(moved, "trace_id", "left")
    return steps.withColumn("moved_signals", F.coalesce("moved_signals", F.array().cast("array<string>")))


#: What names of the tool's own signals contain.
INTERNAL = r"anyseq|setundef|_witness_|auto\$|\\_"
TOOL_MARKS = ["anyinit_", "anyseq_", "smt_", "_auto_", "$", "\\", "procdff", "execute_", "setundef"]


def is_real_signal(name: Column) -> Column:
    """Whether a name is none of the tool's own."""
    return ~F.exists(F.array(*[F.lit(x) for x in TOOL_MARKS]), lambda x: F.contains(name, x))


def unknown_states(changes: DataFrame, *, internal: str = INTERNAL, first: int = 20) -> DataFrame:
    """(trace_id, x_count, x_signals) of values with x or z, without internal names."""
    hit = changes.where(F.lower("val").rlike("[xz]") & ~F.col("sig").rlike(internal))
    out = hit.groupBy("trace_id").agg(F.count(F.lit(1)).alias("x_count"), F.sort_array(F.collect_set("sig")).alias("s"))
    return out.select("trace_id", "x_count", F.slice("s", 1, first).alias("x_signals"))


def widths(signals: DataFrame) -> DataFrame:
    """The largest width of each name."""
    return signals.groupBy("trace_id", "name").agg(F.max("width").alias("width"))


def bit(val: Column) -> Column:
    """0 or 1 of a one-bit value text, else null."""
    return F.when(val.rlike("^0*1$"), 1).when(val.rlike("^0+$"), 0)


def to_decimal(val: Column) -> Column:
    """A binary text of several bits as decimal text; other texts as they are."""
    return F.when(val.rlike("^[01]{2,63}$"), F.conv(val, 2, 10)).otherwise(val)
