"""Trace operators bound to ``events``: a user is a trace, an event type a signal, ``signup`` the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as A
from ..operators import ranges as R
from ..operators import trace as T
from ..session import read_table
from ..sinks.waveforms import waveforms
from ..sources import vcd as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_CY = """
    ch AS (SELECT user_id AS trace_id, event_id AS pos, epoch_us(ts) AS ts, event_type AS sig, value AS val FROM events),
    cy AS (SELECT *, CAST(sum(CASE WHEN sig = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ts
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cycle FROM ch),
    lv AS (SELECT trace_id, cycle, sig, arg_max(val, pos) AS val FROM cy GROUP BY ALL),
    an AS (SELECT trace_id, min(cycle) AS anchor FROM cy WHERE sig = 'error' GROUP BY 1),
    span AS (SELECT trace_id, sig, unnest(range(0, top + 1)) AS cycle FROM (SELECT DISTINCT trace_id, sig FROM lv)
             JOIN (SELECT trace_id, max(cycle) AS top FROM lv GROUP BY 1) USING (trace_id)),
    grid AS (SELECT span.trace_id, span.sig, span.cycle, lv.val FROM span LEFT JOIN lv USING (trace_id, sig, cycle))
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {_CY}{sql}"
        return f

    return add


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("pos"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))").alias("ts"), F.col("event_type").alias("sig"), F.col("value").alias("val")
    )



#: Traces are sorted in pieces of thirty days.
SPAN = 30 * 86_400_000_000


def cycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_cycles(changes(spark, sf_dir), F.col("sig") == "signup", span=SPAN)


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_in_cycle(cycled(spark, sf_dir))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycled(spark, sf_dir).where("sig = 'error'").groupBy("trace_id").agg(F.min("cycle").alias("anchor"))


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users 2k and 2k + 1 are the golden and the other trace of pair k; a value is whether it is over 50."""
    rows = last(spark, sf_dir).withColumn("pair_id", F.floor(F.col("trace_id") / 2)).withColumn("val", (F.col("val") > 50).cast("int"))
    return tuple(rows.where(F.col("trace_id") % 2 == k).select("pair_id", "cycle", "sig", "val") for k in (0, 1))


_PAIR = """,
    pr AS (SELECT CAST(floor(trace_id / 2) AS BIGINT) AS pair_id, trace_id % 2 AS side, cycle, sig, CASE WHEN val > 50 THEN 1 ELSE 0 END AS val FROM lv),
    g AS (SELECT * FROM pr WHERE side = 0), b AS (SELECT * FROM pr WHERE side = 1),
    tops AS (SELECT pair_id, least(x, y) AS top FROM (SELECT pair_id, max(cycle) AS x FROM g GROUP BY 1) JOIN (SELECT pair_id, max(cycle) AS y FROM b GROUP BY 1) USING (pair_id)),
    com AS (SELECT DISTINCT pair_id, sig FROM g INTERSECT SELECT DISTINCT pair_id, sig FROM b),
    dif AS (SELECT pair_id, sig, min(cycle) AS first_diff FROM
            (SELECT pair_id, sig, cycle, g.val AS gv, b.val AS bv FROM g FULL JOIN b USING (pair_id, sig, cycle)) JOIN com USING (pair_id, sig) JOIN tops USING (pair_id)
            WHERE cycle <= top AND gv IS DISTINCT FROM bv GROUP BY 1, 2)
"""


@query("SELECT trace_id, cycle, sig, val FROM lv")
def w1_w2_cycle_last_value(spark, sf_dir):
    return last(spark, sf_dir)


@query("SELECT trace_id, CAST(0 AS BIGINT) AS cycle, CAST(0 AS BIGINT) AS t0 FROM ch GROUP BY 1 UNION ALL SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, pos), ts FROM ch WHERE sig = 'signup'")
def w1_cycle_starts(spark, sf_dir):
    return T.cycle_starts(changes(spark, sf_dir), F.col("sig") == "signup", span=SPAN)


@query("SELECT trace_id, CAST(0 AS BIGINT) AS cycle, sig, arg_max(val, pos) AS val FROM ch GROUP BY 1, 3")
def w3_no_clock(spark, sf_dir):
    return T.last_in_cycle(T.with_cycles(changes(spark, sf_dir), F.lit(False)))


@query("SELECT trace_id, cycle, max(val) FILTER (sig = 'click') AS click, max(val) FILTER (sig = 'error') AS error FROM lv WHERE sig IN ('click', 'error') GROUP BY 1, 2")
def w4_state_trace(spark, sf_dir):
    return T.state_trace(last(spark, sf_dir), ["click", "error"])


@query("SELECT trace_id, sig, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY f, sig) AS INT) AS ord FROM (SELECT trace_id, sig, min(pos) AS f FROM ch GROUP BY 1, 2)")
def w5_signal_list(spark, sf_dir):
    return T.signal_list(changes(spark, sf_dir))


@query("SELECT a.trace_id, a.cycle, a.sig, a.val FROM lv a LEFT JOIN lv b ON a.trace_id = b.trace_id AND a.sig = b.sig AND b.cycle = a.cycle - 1 WHERE b.sig IS NULL OR b.val IS DISTINCT FROM a.val")
def w6_changed(spark, sf_dir):
    return T.changed(last(spark, sf_dir))


@query(""", c AS (SELECT trace_id, cycle, n, row_number() OVER (PARTITION BY trace_id ORDER BY cycle) - 1 AS idx FROM (SELECT trace_id, cycle, count(*) AS n FROM lv GROUP BY 1, 2)),
    k AS (SELECT c.*, cycle BETWEEN anchor - 3 AND anchor + 3 AS ins FROM c JOIN an USING (trace_id) WHERE cycle BETWEEN anchor - 3 AND anchor + 3 OR (cycle < anchor - 3 AND idx % 4 = 0))
    SELECT trace_id, cycle, n, coalesce(ins AND NOT coalesce(lag(ins) OVER w, true) AND lag(cycle) OVER w <> cycle - 1, false) AS is_gap FROM k WINDOW w AS (PARTITION BY trace_id ORDER BY cycle)""")
def w7_anchor_window(spark, sf_dir):
    cycles = last(spark, sf_dir).groupBy("trace_id", "cycle").agg(F.count(F.lit(1)).alias("n"))
    return T.anchor_window(cycles, anchors(spark, sf_dir), 3)


@query("SELECT trace_id, CAST(CASE WHEN anchor IS NULL THEN 8 ELSE greatest(8, least(24, anchor // 2)) END AS INT) AS w FROM an")
def w8_adaptive_window(spark, sf_dir):
    return anchors(spark, sf_dir).select("trace_id", T.adaptive_window(F.col("anchor")).alias("w"))


@query(""", c AS (SELECT trace_id, cycle, row_number() OVER (PARTITION BY trace_id ORDER BY cycle) - 1 AS idx FROM (SELECT DISTINCT trace_id, cycle FROM lv))
    SELECT trace_id, cycle FROM c JOIN an USING (trace_id) WHERE cycle >= anchor - 4 OR idx % 8 = 0""")
def w9_slim(spark, sf_dir):
    return T.slim(last(spark, sf_dir).select("trace_id", "cycle").distinct(), anchors(spark, sf_dir))


@query("SELECT trace_id, sig, cycle, val, last_value(val IGNORE NULLS) OVER (PARTITION BY trace_id, sig ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM grid")
def w10_hold(spark, sf_dir):
    return T.hold(last(spark, sf_dir))


@query("SELECT trace_id, sig, cycle, lead(cycle) OVER (PARTITION BY trace_id, sig ORDER BY cycle) AS stop, val FROM lv WHERE val IS NOT NULL")
def w10_runs(spark, sf_dir):
    return T.runs(last(spark, sf_dir))


@query(""", h AS (SELECT trace_id, sig, cycle, last_value(val IGNORE NULLS) OVER (PARTITION BY trace_id, sig ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM grid)
    SELECT h.* FROM h JOIN an USING (trace_id) WHERE cycle = anchor""")
def w10_held_at_anchor(spark, sf_dir):
    """What every signal of a trace holds in the cycle of its first error."""
    rows = last(spark, sf_dir)
    asked = rows.select("trace_id", "sig").distinct().join(anchors(spark, sf_dir).withColumnRenamed("anchor", "cycle"), "trace_id")
    return T.held_at(rows, asked)


@query("SELECT trace_id, pos, cycle FROM cy")
def j11_event_cycles(spark, sf_dir):
    """The cycle of each event by an interval join of events with the spans of the cycles, two tables."""
    starts = T.cycle_starts(changes(spark, sf_dir), F.col("sig") == "signup", span=SPAN)
    spans = R.spans(starts.withColumnRenamed("t0", "from"), keys=["trace_id"], at="cycle").join(starts.select("trace_id", F.col("cycle").alias("stop"), F.col("t0").alias("until")), ["trace_id", "stop"], "left")
    points = changes(spark, sf_dir).select("trace_id", "pos", "ts")
    held = R.interval_join(points, spans.select("trace_id", "cycle", "from", "until"), keys=["trace_id"], at="ts", start="from", stop="until", base=3_600_000_000.0)
    return held.select("trace_id", "pos", "cycle")


@query(""", e AS (SELECT * FROM ch WHERE sig = 'error'), s AS (SELECT trace_id, ts AS near FROM ch WHERE sig = 'signup'),
    b AS (SELECT e.trace_id, e.pos, e.ts, s.near AS before FROM e ASOF LEFT JOIN s ON e.trace_id = s.trace_id AND e.ts >= s.near), a AS (SELECT e.pos, s.near AS after FROM e ASOF LEFT JOIN s ON e.trace_id = s.trace_id AND e.ts <= s.near)
    SELECT trace_id, b.pos, CASE WHEN before IS NULL OR after - ts < ts - before THEN after ELSE before END AS near, least(ts - before, after - ts) AS distance FROM b JOIN a USING (pos)""")
def j13_nearest_signup(spark, sf_dir):
    """Of each error the nearest signup of its user, before or after it."""
    e = changes(spark, sf_dir)
    out = R.nearest_join(e.where("sig = 'error'").select("trace_id", "pos", "ts"), e.where("sig = 'signup'").select("trace_id", "ts"), keys=["trace_id"], at="ts")
    return out.select("trace_id", "pos", F.col("near.ts").alias("near"), "distance")


@query(_PAIR + "SELECT * FROM dif")
def w11_aligned_diff(spark, sf_dir):
    return T.aligned_diff(*pair(spark, sf_dir))


@query(_PAIR + """, fa AS (SELECT pair_id, min(first_diff) AS fa FROM dif GROUP BY 1),
    w AS (SELECT d.pair_id, d.sig, d.first_diff, unnest(range(greatest(0, fa - 4), fa + 5)) AS cycle FROM dif d JOIN fa USING (pair_id)),
    h AS (SELECT w.*, last_value(g.val IGNORE NULLS) OVER o AS gv, last_value(b.val IGNORE NULLS) OVER o AS bv FROM w LEFT JOIN g USING (pair_id, sig, cycle) LEFT JOIN b USING (pair_id, sig, cycle)
          WINDOW o AS (PARTITION BY w.pair_id, w.sig ORDER BY w.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT pair_id, sig, first_diff, string_agg(cycle || ':' || coalesce(CAST(gv AS VARCHAR), '-') || ':' || coalesce(CAST(bv AS VARCHAR), '-'), ' ' ORDER BY cycle) AS detail FROM h GROUP BY 1, 2, 3""")
def w12_diff_detail(spark, sf_dir):
    d = T.diff_detail(*pair(spark, sf_dir))
    text = F.zip_with(F.zip_with("cycles", "golden", lambda c, g: F.concat_ws(":", c, F.coalesce(g.cast("string"), F.lit("-")))), "buggy", lambda s, b: F.concat_ws(":", s, F.coalesce(b.cast("string"), F.lit("-"))))
    return d.select("pair_id", "sig", "first_diff", F.array_join(text, " ").alias("detail"))


@query("SELECT trace_id, count(*) AS x_count, array_to_string(list_sort(list_distinct(list(sig)))[1:20], ',') AS x_signals FROM ch WHERE sig LIKE '%r%' AND val < 20 GROUP BY 1")
def w13_unknown_states(spark, sf_dir):
    rows = changes(spark, sf_dir).where("sig like '%r%'").withColumn("val", F.when(F.col("val") < 20, "x").otherwise("1"))
    return T.unknown_states(rows).withColumn("x_signals", F.array_join("x_signals", ","))


@query(_PAIR + """, fa AS (SELECT pair_id, min(first_diff) AS fa FROM dif GROUP BY 1),
    gm AS (SELECT pair_id, sig, count(DISTINCT val) AS n FROM g JOIN fa USING (pair_id) WHERE cycle >= fa GROUP BY 1, 2),
    bm AS (SELECT pair_id, sig, count(DISTINCT val) AS m FROM b JOIN fa USING (pair_id) WHERE cycle >= fa GROUP BY 1, 2)
    SELECT pair_id, sig FROM gm LEFT JOIN bm USING (pair_id, sig) WHERE n > 1 AND coalesce(m, 0) <= 1""")
def w14_stuck_pairwise(spark, sf_dir):
    return T.stuck_against(*pair(spark, sf_dir))


@query(""", r AS (SELECT trace_id, sig, CAST(val > 50 AS INT) AS v, row_number() OVER (PARTITION BY trace_id, sig ORDER BY cycle DESC) AS rn FROM lv)
    SELECT trace_id, sig, min(v) AS val FROM r WHERE rn <= 6 GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT v) = 1""")
def w15_stuck_tail(spark, sf_dir):
    return T.stuck_tail(last(spark, sf_dir).withColumn("val", (F.col("val") > 50).cast("int")))


@query(_PAIR + """, n AS (SELECT pair_id, count(*) AS n FROM com GROUP BY 1), d AS (SELECT pair_id, count(*) AS d FROM dif GROUP BY 1)
    SELECT pair_id, CASE WHEN n > 0 THEN coalesce(d, 0) = 0 END AS match FROM (SELECT DISTINCT pair_id FROM pr) LEFT JOIN n USING (pair_id) LEFT JOIN d USING (pair_id)""")
def w17_signature_match(spark, sf_dir):
    return T.signature_match(*pair(spark, sf_dir))


@query(""", n AS (SELECT lv.*, lag(val) OVER (PARTITION BY trace_id, sig ORDER BY cycle) AS p FROM lv JOIN an USING (trace_id) WHERE abs(cycle - anchor) <= 3)
    SELECT DISTINCT trace_id, sig FROM n WHERE p IS NOT NULL AND p <> val""")
def w18_flipped(spark, sf_dir):
    return T.flipped(last(spark, sf_dir), anchors(spark, sf_dir), 3)


@query("SELECT trace_id, cycle, string_agg(sig || '=' || CAST(CAST(floor(val) AS BIGINT) AS VARCHAR), ' ' ORDER BY sig || '=' || CAST(CAST(floor(val) AS BIGINT) AS VARCHAR)) AS vals FROM lv WHERE val IS NOT NULL GROUP BY 1, 2")
def w19_value_trace(spark, sf_dir):
    rows = last(spark, sf_dir).withColumn("val", F.floor("val").cast("long"))
    return T.value_trace(rows).withColumn("vals", F.array_join("vals", " "))


#: Both traces of a pair held on every cycle of the longer one, for the signals that both have.
_HELD = _PAIR + """, en AS (SELECT pair_id, max(cycle) AS e FROM pr GROUP BY 1),
    gr AS (SELECT pair_id, sig, unnest(range(0, e + 1)) AS cycle FROM com JOIN en USING (pair_id)),
    hd AS (SELECT gr.pair_id, gr.sig, gr.cycle, last_value(g.val IGNORE NULLS) OVER o AS gv, last_value(b.val IGNORE NULLS) OVER o AS bv FROM gr LEFT JOIN g USING (pair_id, sig, cycle) LEFT JOIN b USING (pair_id, sig, cycle)
           WINDOW o AS (PARTITION BY gr.pair_id, gr.sig ORDER BY gr.cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query(_HELD + """, j AS (SELECT pair_id, sig, cycle, gv AS g1, bv AS b1, lag(gv) OVER o AS g0, lag(bv) OVER o AS b0 FROM hd WINDOW o AS (PARTITION BY pair_id, sig ORDER BY cycle))
    SELECT pair_id, sig, cycle, g0, g1, b0, b1 FROM j WHERE g0 IS NOT NULL AND g1 IS NOT NULL AND g0 <> g1 AND (b0 IS NOT DISTINCT FROM b1 OR (b1 IS NOT NULL AND b1 <> g1))""")
def w20_transition_divergence(spark, sf_dir):
    return T.transition_divergence(T.merged_runs(*pair(spark, sf_dir)))


@query(_HELD + """, n AS (SELECT pair_id, sig, count(*) FILTER (gv IS NOT DISTINCT FROM bv) AS alike, count(*) FILTER (gv IS DISTINCT FROM bv) AS apart FROM hd WHERE gv IS NOT NULL OR bv IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM n""")
def w11_held_agreement(spark, sf_dir):
    """For how many cycles the held values of both traces agree, and for how many they don't, by the length of merged runs."""
    golden, buggy = pair(spark, sf_dir)
    ends = golden.union(buggy).groupBy("pair_id").agg(F.max("cycle").alias("end"))
    both = T.merged_runs(golden, buggy).join(ends, "pair_id")
    length = F.coalesce("stop", F.col("end") + 1) - F.col("cycle")
    same = F.col("golden").eqNullSafe(F.col("buggy"))
    count = lambda where: F.coalesce(F.sum(F.when(where, length)), F.lit(0))
    return both.groupBy("pair_id", "sig").agg(count(same).alias("alike"), count(~same).alias("apart"))


_HAND = """, d AS (SELECT trace_id, cycle, max(CASE WHEN sig = 'click' THEN CAST(val > 40 AS INT) END) AS valid, max(CASE WHEN sig = 'purchase' THEN CAST(val > 60 AS INT) END) AS ready FROM grid GROUP BY 1, 2),
    h AS (SELECT trace_id, cycle, last_value(valid IGNORE NULLS) OVER o AS v, last_value(ready IGNORE NULLS) OVER o AS r FROM d WINDOW o AS (PARTITION BY trace_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    p AS (SELECT h.*, anchor, coalesce(lag(v) OVER (PARTITION BY trace_id ORDER BY cycle), 0) AS pv FROM h LEFT JOIN an USING (trace_id)),
    q AS (SELECT *, min(CASE WHEN r = 1 THEN cycle END) OVER (PARTITION BY trace_id) AS fr, min(CASE WHEN v = 1 AND pv = 0 THEN cycle END) OVER (PARTITION BY trace_id) AS fv FROM p),
    f AS (SELECT trace_id, min(fv) AS first_valid_rise, min(fr) AS first_ready, count(*) FILTER (v = 1 AND r = 0 AND (fr IS NULL OR cycle < fr)) AS wait_cycles,
        count(*) FILTER (v = 1 AND cycle >= fr) AS hold_cycles, coalesce(bool_or(pv = 1 AND v = 0), false) AS deassert_seen, max(CASE WHEN cycle = anchor THEN v END) AS valid_at_fail,
        max(CASE WHEN cycle = anchor THEN r END) AS ready_at_fail, max(CASE WHEN cycle = fv THEN r END) AS ready_at_valid_rise
        FROM q GROUP BY 1 HAVING count(*) FILTER (v IS NOT NULL OR r IS NOT NULL) > 0)
"""


def ends(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trace_id").agg(F.max("cycle").alias("end"))


def _handshake(spark, sf_dir):
    rows = last(spark, sf_dir)
    one = lambda sig, over: F.max(F.when(F.col("sig") == sig, (F.col("val") > over).cast("int")))
    pairs = rows.groupBy("trace_id", "cycle").agg(one("click", 40).alias("valid"), one("purchase", 60).alias("ready"))
    return T.handshake_features(pairs, anchors(spark, sf_dir), ends=ends(rows))


@query(_HAND + "SELECT * FROM f")
def w21_handshake_features(spark, sf_dir):
    return _handshake(spark, sf_dir)


#: The signals that stand for each pair's valid and ready: event type and the value above which it is 1.
PAIRS = {
    T.B: ("click", 40, "purchase", 60), T.R: ("view", 30, "click", 50), T.AW: ("view", 50, "error", 20), T.W: ("error", 40, "purchase", 50),
    T.AR: ("click", 20, "view", 70), T.TX: ("purchase", 50, "view", 40), T.RX: ("error", 60, "click", 30),
}


def _valid_ready() -> str:
    return " UNION ALL ".join(
        f"SELECT trace_id, cycle, '{p}' AS pair, max(CASE WHEN sig = '{v}' THEN CAST(val > {a} AS INT) END) AS valid, max(CASE WHEN sig = '{r}' THEN CAST(val > {b} AS INT) END) AS ready FROM grid GROUP BY 1, 2"
        for p, (v, a, r, b) in PAIRS.items()
    )


_PAIRED = f""", d AS ({_valid_ready()}),
    h AS (SELECT trace_id, pair, cycle, last_value(valid IGNORE NULLS) OVER o AS v, last_value(ready IGNORE NULLS) OVER o AS r FROM d
          WINDOW o AS (PARTITION BY trace_id, pair ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY trace_id, pair ORDER BY cycle), 0) AS pv FROM h),
    rise AS (SELECT trace_id, pair, min(cycle) FILTER (v = 1 AND pv = 0) AS rise, min(cycle) FILTER (r = 1) AS ready, coalesce(bool_or(pv = 1 AND v = 0), false) AS fell FROM e GROUP BY 1, 2),
    lvl AS (SELECT e.trace_id, e.pair, e.r FROM e JOIN rise ON e.trace_id = rise.trace_id AND e.pair = rise.pair AND e.cycle = rise.rise),
    x AS (SELECT rise.*, lvl.r AS level FROM rise LEFT JOIN lvl USING (trace_id, pair)),
    one AS (SELECT trace_id, """ + ", ".join(
    f"min(rise) FILTER (pair = '{p}') AS rise{i}, min(ready) FILTER (pair = '{p}') AS ready{i}, bool_or(fell) FILTER (pair = '{p}') AS fell{i}, max(level) FILTER (pair = '{p}') AS level{i}"
    for i, p in enumerate(PAIRS)
) + """ FROM x GROUP BY 1)
"""  # pairs by number: 0 B, 1 R, 2 AW, 3 W, 4 AR, 5 TX, 6 RX


@query(_PAIRED + """SELECT trace_id, array_to_string(list_filter(CASE trace_id % 3
    WHEN 0 THEN [CASE WHEN rise0 IS NOT NULL AND NOT fell0 THEN 'bvalid_never_released' END, CASE WHEN rise0 IS NOT NULL AND ready0 IS NULL THEN 'bready_never_raised' END,
                 CASE WHEN ready2 IS NOT NULL AND ready3 IS NOT NULL AND rise0 < greatest(ready2, ready3) THEN 'bvalid_before_write_handshakes' END,
                 CASE WHEN rise1 IS NOT NULL AND NOT fell1 THEN 'rvalid_never_released' END, CASE WHEN rise1 < ready4 THEN 'rvalid_before_address_handshake' END]
    WHEN 1 THEN [CASE WHEN rise5 IS NOT NULL AND level5 = 1 THEN 'busy_without_start_bit' END]
    ELSE [CASE WHEN rise6 IS NOT NULL AND NOT fell6 THEN 'rx_valid_never_released' END] END, lambda v: v IS NOT NULL), ',') AS violations FROM one""")
def w22_protocol_violations(spark, sf_dir):
    rows = last(spark, sf_dir)
    bit = lambda sig, over: F.when(F.col("sig") == sig, (F.col("val") > over).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), bit(v, a).alias("valid"), bit(r, b).alias("ready")) for p, (v, a, r, b) in PAIRS.items()]))
    pairs = rows.select("trace_id", "cycle", each.alias("p")).groupBy("trace_id", "cycle", "p.pair").agg(F.max("p.valid").alias("valid"), F.max("p.ready").alias("ready"))
    features = T.handshake_features(pairs, anchors(spark, sf_dir), keys=("trace_id", "pair"), ends=ends(rows))
    module = F.element_at(F.array(*[F.lit(m) for m in ("axi_lite_slave", "uart_tx", "uart_rx")]), (F.col("trace_id") % 3 + 1).cast("int"))
    modules = rows.select("trace_id").distinct().withColumn("module", module)
    return T.protocol_violations(features, modules).withColumn("violations", F.array_join("violations", ","))


@query(_HELD + """SELECT pair_id AS trace_id, sig, min(cycle) AS first_diff FROM hd JOIN tops USING (pair_id) WHERE cycle BETWEEN 1 AND top AND sig <> 'view' AND gv IS DISTINCT FROM bv GROUP BY 1, 2""")
def w16_replay_diff(spark, sf_dir):
    g, b = (df.withColumnRenamed("pair_id", "trace_id") for df in pair(spark, sf_dir))
    shorter = ends(g).join(ends(b).withColumnRenamed("end", "other"), "trace_id").select("trace_id", F.least("end", "other").alias("end"))
    return T.replay_diff(g, b, inputs=["view"], ends=shorter)


_SHOW = {"click": "clk", "view": "state", "purchase": "valid", "error": "any_error", "signup": "burst"}


@query(""", s AS (SELECT trace_id, CASE sig WHEN 'click' THEN 'clk' WHEN 'view' THEN 'state' WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'any_error' WHEN 'signup' THEN 'burst' ELSE sig END AS sig, min(pos) AS f FROM ch GROUP BY 1, 2),
    p AS (SELECT *, CASE sig WHEN 'clk' THEN 1 WHEN 'state' THEN 3 WHEN 'valid' THEN 21 ELSE 24 END AS p FROM s WHERE sig NOT LIKE 'any%'),
    r AS (SELECT trace_id, sig, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY p, f, sig) AS INT) AS rank FROM p) SELECT * FROM r WHERE rank <= 3""")
def t6_signals_to_show(spark, sf_dir):
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in _SHOW.items() for x in kv])[F.col("sig")], F.col("sig"))
    return A.signals_to_show(T.signal_list(changes(spark, sf_dir).withColumn("sig", named)), most=3)


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as the lines of a value-change dump: of each event a time mark and a change; one declaration a type."""
    e = changes(spark, sf_dir).withColumn("vid", F.substring("sig", 1, 2))
    bits = F.bin(F.floor("val").cast("long"))
    body = F.array(F.concat(F.lit("#"), F.col("ts").cast("string")), F.concat(F.lit("b"), bits, F.lit(" "), F.col("vid")), F.lit("r1.5 zz"))
    lines = e.select("trace_id", F.col("pos").alias("p"), F.posexplode(body).alias("i", "line")).select("trace_id", (F.col("p") * 4 + F.col("i") + 1000).alias("pos"), "line")
    declared = e.select("trace_id", "sig", "vid").distinct()
    heads = F.concat(F.lit("$var wire 7 "), F.col("vid"), F.lit(" "), F.col("sig"), F.lit(" $end"))
    return lines.unionByName(declared.select("trace_id", F.ascii("sig").cast("long").alias("pos"), heads.alias("line")))


@query("SELECT trace_id, ts, substr(sig, 1, 2) AS vid, bin(CAST(floor(val) AS BIGINT)) AS val, count(*) AS n FROM ch GROUP BY ALL")
def sc1_sc2_dump_changes(spark, sf_dir):
    return V.changes(dump_lines(spark, sf_dir)).groupBy("trace_id", "ts", "vid", "val").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT trace_id, substr(sig, 1, 2) AS vid, sig AS name, 7 AS width FROM ch")
def sc1_dump_signals(spark, sf_dir):
    return V.signals(dump_lines(spark, sf_dir)).select("trace_id", "vid", "name", "width")


@query("SELECT trace_id, len(string_split(x, ',')) AS shown FROM (SELECT trace_id, string_agg(DISTINCT sig, ',') AS x FROM ch WHERE sig IN ('click', 'error', 'view') GROUP BY 1)")
def sk5_waveforms(spark, sf_dir):
    sampled = T.last_in_cycle(cycled(spark, sf_dir)).withColumn("val", F.floor("val").cast("string"))
    shown = changes(spark, sf_dir).where("sig in ('click', 'error', 'view')").groupBy("trace_id", "sig").agg(F.min("pos").alias("rank"))
    svg = waveforms(sampled, shown, anchors(spark, sf_dir))
    return svg.select("trace_id", F.size(F.regexp_extract_all("svg", F.lit('<text x="4" '), F.lit(0))).cast("long").alias("shown"))


@query(""", e2 AS (SELECT trace_id, max(cycle) AS b FROM cy WHERE sig = 'error' GROUP BY 1),
    mv AS (SELECT n.trace_id, string_agg(n.sig, ',' ORDER BY n.sig) AS moved FROM (SELECT lv.* FROM lv JOIN e2 ON lv.trace_id = e2.trace_id AND cycle = b) n
        LEFT JOIN (SELECT lv.* FROM lv JOIN an ON lv.trace_id = an.trace_id AND cycle = anchor) o ON n.trace_id = o.trace_id AND n.sig = o.sig WHERE n.val IS NOT NULL AND n.val IS DISTINCT FROM o.val GROUP BY 1)
    SELECT trace_id, b - anchor AS step_move, coalesce(moved, '') AS moved_signals FROM an JOIN e2 USING (trace_id) LEFT JOIN mv USING (trace_id)""")
def w23_counterexample_delta(spark, sf_dir):
    rows, c = last(spark, sf_dir), cycled(spark, sf_dir).where("sig = 'error'")
    steps = [c.groupBy("trace_id").agg(f("cycle").alias("fail_step")) for f in (F.min, F.max)]
    return T.counterexample_delta(rows, rows, *steps).withColumn("moved_signals", F.array_join("moved_signals", ","))


@query(""", z AS (SELECT *, max(cycle) OVER (PARTITION BY trace_id) AS lc, min(ts) OVER (PARTITION BY trace_id, cycle) AS t0 FROM cy)
    SELECT trace_id, cycle, sig, arg_max(val, pos) AS val FROM z WHERE cycle < lc OR ts < t0 + 1 GROUP BY 1, 2, 3""")
def w24_render_sampling(spark, sf_dir):
    return T.last_before_next_edge(cycled(spark, sf_dir))


@query("SELECT trace_id, sig AS name, max(CAST(floor(val) AS INT)) AS width FROM ch GROUP BY 1, 2")
def w25_widths(spark, sf_dir):
    return T.widths(changes(spark, sf_dir).select("trace_id", F.col("sig").alias("name"), F.floor("val").cast("int").alias("width")))


@query("SELECT pos, CASE WHEN length(b) >= 2 THEN CAST(pos % 97 AS VARCHAR) ELSE b END AS dec, CASE WHEN pos % 97 = 0 THEN 0 WHEN pos % 97 = 1 THEN 1 END AS bit FROM (SELECT pos, bin(pos % 97) AS b FROM ch)")
def w26_bit_normalise(spark, sf_dir):
    b = F.bin(F.col("pos") % 97)
    return changes(spark, sf_dir).select("pos", T.to_decimal(b).alias("dec"), T.bit(b).alias("bit"))
