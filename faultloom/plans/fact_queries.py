"""Fact, rollup and statistics operators bound to the star-schema tables.

An order stands for a result row: its customer is the sample, its priority the setting, its key the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import evidence as E
from ..operators import facts as A
from ..operators import rollups as R
from ..operators.scan import numbered, order_statistic
from ..session import read_table
from ..streaming.ledger import ledger_summary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_ROWS = """
    rows_ AS (SELECT o_custkey AS sample, substr(o_orderpriority, 1, 1) AS setting, o_orderkey AS seed, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS repair_pass_bmc,
        o_totalprice > 150000 AS repair_pass, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict, o_orderkey % 3 = 0 AS loc_top1,
        o_orderkey % 50 AS loc_line, 1 + o_orderkey % 3 AS attempts, o_custkey % 1000 AS input_tokens, o_orderkey % 700 AS output_tokens, (o_orderkey % 100) / 4.0 AS cost FROM orders)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {_ROWS}{sql}"
        return f

    return add


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("sample"), F.substring("o_orderpriority", 1, 1).alias("setting"), key.alias("seed"),
        F.when(status == "F", True).when(status == "O", False).alias("repair_pass_bmc"), (F.col("o_totalprice") > 150000).alias("repair_pass"),
        F.when(status == "F", "PASS").when(status == "O", "FAIL").otherwise("INCONCLUSIVE").alias("verdict"), (key % 3 == 0).alias("loc_top1"),
        (key % 50).alias("loc_line"), (1 + key % 3).alias("attempts"), (F.col("o_custkey") % 1000).alias("input_tokens"),
        (key % 700).alias("output_tokens"), ((key % 100) / 4.0).alias("cost"),
    )


@query("SELECT sample, setting, min(seed) AS seed, arg_min(verdict, seed) AS verdict FROM rows_ GROUP BY 1, 2")
def sd1_first_wins(spark, sf_dir):
    return A.first_wins(rows(spark, sf_dir).select("sample", "setting", "seed", "verdict"), ["sample", "setting"], ["seed"])


@query("SELECT sample, setting, max(seed) AS seed, arg_max(verdict, seed) AS verdict FROM rows_ GROUP BY 1, 2")
def sd2_last_wins(spark, sf_dir):
    return A.last_wins(rows(spark, sf_dir).select("sample", "setting", "seed", "verdict"), ["sample", "setting"], ["seed"])


@query(""", x AS (SELECT sample, setting, arg_max(verdict, seed) AS v, max(seed) AS s FROM rows_ GROUP BY 1, 2)
    SELECT a.sample, a.v AS a_verdict, a.s AS a_seed, b.v AS b_verdict, b.s AS b_seed FROM x a JOIN x b USING (sample) WHERE a.setting = '1' AND b.setting = '2'""")
def j1_strict_pairs(spark, sf_dir):
    r = rows(spark, sf_dir).select("sample", "setting", "seed", "verdict")
    a, b = (r.where(F.col("setting") == s).drop("setting") for s in "12")
    return A.strict_pairs(a, b, ["sample"], ["seed"])


@query(""", x AS (SELECT sample, setting, arg_min(loc_top1, seed) AS v FROM rows_ GROUP BY 1, 2)
    SELECT a.sample, a.setting AS setting_a, b.setting AS setting_b, a.v AS a, b.v AS b FROM x a JOIN x b USING (sample) WHERE a.setting < b.setting""")
def j2_setting_pairs(spark, sf_dir):
    return A.setting_pairs(rows(spark, sf_dir), ["sample"], ["seed"], "loc_top1")


@query(""", x AS (SELECT sample, setting, arg_max(loc_top1, seed) AS v FROM rows_ GROUP BY 1, 2)
    SELECT a.sample, a.setting AS setting_a, b.setting AS setting_b, a.v AS a, b.v AS b FROM x a JOIN x b USING (sample) WHERE a.setting < b.setting""")
def j3_setting_pairs_last(spark, sf_dir):
    return A.setting_pairs(rows(spark, sf_dir), ["sample"], ["seed"], "loc_top1", last=True)


@query(", a AS (SELECT sample, count(*) AS na FROM rows_ WHERE setting = '1' GROUP BY 1), b AS (SELECT sample, count(*) AS nb FROM rows_ WHERE setting = '2' GROUP BY 1) SELECT sample, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (sample)")
def j4_full_outer(spark, sf_dir):
    n = lambda s, c: rows(spark, sf_dir).where(F.col("setting") == s).groupBy("sample").agg(F.count(F.lit(1)).alias(c))
    return R.either_side(n("1", "na"), n("2", "nb"), ["sample"], 0)


@query(", o AS (SELECT sample, arg_min(loc_top1, seed) AS l FROM rows_ GROUP BY 1) SELECT r.sample, r.seed FROM rows_ r JOIN o USING (sample) WHERE o.l IS DISTINCT FROM r.loc_top1")
def j5_flips(spark, sf_dir):
    r = rows(spark, sf_dir).select("sample", "seed", "loc_top1")
    old = A.first_wins(r, ["sample"], ["seed"]).select("sample", "loc_top1")
    return A.flips(old, r, ["sample"], "loc_top1").select("sample", "seed")


@query(" SELECT sample, seed, coalesce(c_mktsegment, '?') AS module FROM rows_ LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON sample = c_custkey")
def j6_dimension_lookup(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("module"))
    return R.looked_up(rows(spark, sf_dir), c, "sample", "module").select("sample", "seed", "module")


@query(" SELECT seed, coalesce(CASE WHEN seed % 5 = 0 THEN 'RECHECKED' END, verdict) AS verdict FROM rows_")
def j7_upsert(spark, sf_dir):
    r = rows(spark, sf_dir).select("seed", "verdict")
    new = r.where("seed % 5 = 0").withColumn("verdict", F.lit("RECHECKED"))
    return A.upsert(r, new, ["seed"], ["verdict"])


@query(" SELECT sample, setting, seed FROM rows_ WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = seed AND l_quantity > 45)")
def j8_p14_task_filter(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("seed"))
    return R.only_tasks(rows(spark, sf_dir), wanted, ["seed"]).select("sample", "setting", "seed")


@query(", s AS (SELECT DISTINCT setting FROM rows_), g AS (SELECT c_custkey AS sample, setting FROM customer, s) SELECT sample, setting FROM g WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.sample = g.sample AND r.setting = g.setting)")
def j9_j14_resume_grid(spark, sf_dir):
    grid = R.task_grid(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")), setting=[str(i) for i in range(1, 6)])
    return A.resume(grid, rows(spark, sf_dir), ["sample", "setting"])


@query(" SELECT c_custkey AS sample FROM customer WHERE c_custkey NOT IN (SELECT sample FROM rows_ WHERE verdict = 'INCONCLUSIVE')")
def j10_completeness(spark, sf_dir):
    known = rows(spark, sf_dir).where("verdict = 'INCONCLUSIVE'")
    return A.unresolved(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")), known, ["sample"])


@query(", t AS (SELECT l_orderkey AS seed, list(DISTINCT l_suppkey % 50) AS ls FROM lineitem GROUP BY 1) SELECT seed, list_contains(ls, loc_line) AS hit, list_min(list_transform(ls, lambda x: abs(x - loc_line))) AS dev FROM rows_ JOIN t USING (seed)")
def j13_j15_location(spark, sf_dir):
    truth = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(F.collect_set(F.col("l_suppkey") % 50).alias("ls"))
    none = F.lit(None).cast("long")
    out = rows(spark, sf_dir).join(truth, "seed")
    return out.select("seed", A.location_hit(F.col("loc_line"), F.col("ls"), none, none).alias("hit"), A.nearest(F.col("loc_line"), F.col("ls")).alias("dev"))


@query(""" SELECT seed, coalesce(repair_pass_bmc, repair_pass, false) AS bmc_else_pass, coalesce(repair_pass_bmc, false) OR coalesce(repair_pass, false) AS bmc_or_pass,
    coalesce(repair_pass_bmc, false) OR coalesce(repair_pass, false) OR verdict = 'PASS' AS "any", repair_pass_bmc IS DISTINCT FROM false AS not_refuted,
    coalesce(repair_pass, false) OR verdict LIKE 'PASS%' AS pass_or_verdict FROM rows_""")
def m13_repair_measures(spark, sf_dir):
    return rows(spark, sf_dir).select("seed", *[f().alias(n) for n, f in A.REPAIR.items()])


@query(" SELECT seed, CASE WHEN seed % 11 = 0 THEN 'BROKEN' WHEN verdict = 'FAIL' THEN 'FAIL' WHEN verdict = 'PASS' THEN CASE WHEN loc_top1 THEN 'PASS' ELSE 'INCONCLUSIVE' END ELSE 'INCONCLUSIVE' END AS v FROM rows_")
def p2_verdict(spark, sf_dir):
    return rows(spark, sf_dir).select("seed", A.verdict(F.col("seed") % 11 != 0, F.lower("verdict"), F.col("loc_top1")).alias("v"))


_ROLL = """count(*) AS n, count(*) FILTER (loc_top1) AS loc, count(*) FILTER (coalesce(repair_pass_bmc, repair_pass, false)) AS repair, count(*) FILTER (verdict = 'PASS') AS pass,
    count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (verdict = 'BROKEN') AS broken, count(*) FILTER (verdict = 'INCONCLUSIVE') AS inconclusive,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(round(sum(cost), 6) AS DOUBLE) AS cost, CAST(round(avg(attempts), 6) AS DOUBLE) AS avg_attempts"""


@query(f" SELECT setting, {_ROLL} FROM rows_ GROUP BY 1")
def a1_setting_rollup(spark, sf_dir):
    return A.setting_rollup(rows(spark, sf_dir), ["setting"])


@query(f" SELECT sample, setting, {_ROLL} FROM rows_ GROUP BY 1, 2")
def a2_sample_setting_rollup(spark, sf_dir):
    return A.setting_rollup(rows(spark, sf_dir), ["sample", "setting"])


@query(" SELECT setting, verdict, count(*) AS n, count(DISTINCT sample) AS samples FROM rows_ GROUP BY GROUPING SETS ((setting), (verdict), ())")
def a3_totals_and_marginals(spark, sf_dir):
    measures = [F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("samples")]
    return A.totals_and_marginals(rows(spark, sf_dir), "setting", "verdict", measures)


@query(" SELECT c_mktsegment AS module, verdict, count(*) FILTER (setting = '1' AND loc_top1) AS s1, count(*) FILTER (setting = '2' AND loc_top1) AS s2, count(*) FILTER (setting = '3' AND loc_top1) AS s3 FROM rows_ JOIN customer ON sample = c_custkey GROUP BY 1, 2")
def a4_a5_interaction_pivot(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("module"))
    p = A.pivoted(rows(spark, sf_dir).join(c, "sample"), ["module", "verdict"], "setting", ["1", "2", "3"], F.count_if("loc_top1"))
    return p.select("module", "verdict", *[F.coalesce(s, F.lit(0)).alias(f"s{s}") for s in "123"])


@query(", d AS (SELECT setting, seed % 3 AS s, CAST(round(avg(CAST(loc_line AS DOUBLE)), 6) AS DOUBLE) AS r FROM rows_ GROUP BY 1, 2) SELECT setting, round(max(r) - min(r), 6) AS spread FROM d GROUP BY 1")
def a6_seed_spread(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("s", F.col("seed") % 3)
    return A.spread(r, ["setting"], "s", F.round(F.avg("loc_line"), 6)).select("setting", F.round("spread", 6).alias("spread"))


@query(" SELECT sample, count(*) AS total, count(*) FILTER (verdict = 'PASS') AS killed, array_to_string(list_sort(list_distinct(list(loc_line)))[1:5], ',') AS lines FROM rows_ GROUP BY 1")
def a7_sufficiency(spark, sf_dir):
    out = R.sufficiency(rows(spark, sf_dir), ["sample"], killed=F.col("verdict") == "PASS", line="loc_line")
    return out.select("sample", "total", "killed", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(" SELECT sample, list_sort(list(loc_line))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, max(loc_line) AS largest, CAST(sum(loc_line) AS BIGINT) AS total FROM rows_ GROUP BY 1")
def a8_upper_median(spark, sf_dir):
    return R.timing(rows(spark, sf_dir), ["sample"], "loc_line")


@query(" SELECT substr(url, 1, 5) AS scheme, CAST(sum(length(html)) AS BIGINT) AS raw, CAST(sum(length(regexp_replace(html, '<[^>]*>', '', 'g'))) AS BIGINT) AS slim FROM pages GROUP BY 1")
def a9_compression(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").withColumn("scheme", F.substring("url", 1, 5))
    return R.compression(p, ["scheme"], raw=F.col("html"), slim=F.regexp_replace("html", "<[^>]*>", "")).drop("saved")


@query(" SELECT count(*) AS calls, count(*) FILTER (event_type = 'view') AS mock, count(*) FILTER (event_type <> 'view') AS live, CAST(sum(user_id) AS BIGINT) AS tokens FROM events")
def a10_ledger_summary(spark, sf_dir):
    e, none = read_table(spark, sf_dir, "events"), F.lit(0)
    ledger = e.select(F.col("user_id").alias("input_tokens"), none.alias("output_tokens"), none.cast("double").alias("cost"), (F.col("event_type") == "view").alias("mock"))
    return ledger_summary(ledger).select("calls", F.col("mock_calls").alias("mock"), F.col("real_calls").alias("live"), F.col("input_tokens").alias("tokens"))


@query(" SELECT sample, bool_or(verdict = 'PASS') AS any_pass, arg_min(setting, attempts * 1000000000 + seed) AS best, array_to_string(list_sort(list_distinct(list(setting))), '') AS settings FROM rows_ GROUP BY 1")
def a12_any_pass_best(spark, sf_dir):
    out = R.best_of(rows(spark, sf_dir), ["sample"], passed=F.col("verdict") == "PASS", choose="setting", order=["attempts", "seed"])
    return out.select("sample", "any_pass", "best", F.array_join("seen", "").alias("settings"))


@query(" SELECT setting, count(*) FILTER (repair_pass AND repair_pass_bmc = false) AS false_pass, count(*) FILTER (NOT repair_pass AND repair_pass_bmc) AS false_fail, count(*) FILTER (repair_pass_bmc IS NULL) AS errors FROM rows_ GROUP BY 1")
def a13_a14_confusion(spark, sf_dir):
    return R.confusion(rows(spark, sf_dir), ["setting"], claimed=F.col("repair_pass"), checked=F.col("repair_pass_bmc")).drop("n")


@query(" SELECT setting, count(*) FILTER (repair_pass_bmc) AS matched, count(*) FILTER (NOT repair_pass_bmc) AS differing, count(*) FILTER (repair_pass_bmc IS NULL) AS failed, round(count(*) FILTER (repair_pass_bmc) / CAST(count(repair_pass_bmc) AS DOUBLE), 9) AS rate FROM rows_ GROUP BY 1")
def a14_match_rate(spark, sf_dir):
    return R.match_rate(rows(spark, sf_dir), ["setting"], F.col("repair_pass_bmc")).withColumn("rate", F.round("rate", 9))


@query(", m AS (SELECT event_type, user_id % 7 AS g, unnest([struct_pack(dim := 'a', score := event_id % 5), struct_pack(dim := 'b', score := event_id % 4)]) AS x FROM events) SELECT event_type, x.dim AS dim, count(*) AS n, min(x.score) AS lo, max(x.score) AS hi, CAST(sum(x.score) AS BIGINT) AS total FROM m GROUP BY 1, 2")
def a15_likert(spark, sf_dir):
    scores = F.create_map(F.lit("a"), F.col("event_id") % 5, F.lit("b"), F.col("event_id") % 4)
    return R.ratings(read_table(spark, sf_dir, "events"), ["event_type"], scores).drop("mean")


@query(" SELECT setting, verdict, count(*) FILTER (loc_top1) AS hits, count(*) AS n FROM rows_ GROUP BY ROLLUP (setting, verdict)")
def a16_rollup(spark, sf_dir):
    return R.accuracy(rows(spark, sf_dir), "setting", "verdict", F.col("loc_top1"))


@query(" SELECT sample, CASE WHEN max(attempts) FILTER (verdict = 'PASS') >= 1 + 2 THEN 'sufficient' ELSE 'insufficient' END AS state, count(*) FILTER (verdict = 'PASS') AS converged, count(*) AS n FROM rows_ GROUP BY 1")
def a17_a18_depth(spark, sf_dir):
    return R.depths(rows(spark, sf_dir), ["sample"], passed=F.col("verdict") == "PASS", depth="attempts", base=1).drop("rate")


@query(" SELECT sample, setting, array_to_string(list_sort(list(loc_line)), ',') AS locs FROM rows_ GROUP BY 1, 2")
def a19_locations(spark, sf_dir):
    out = R.locations(rows(spark, sf_dir), ["sample", "setting"], "loc_line")
    return out.select("sample", "setting", F.array_join(F.col("locs").cast("array<string>"), ",").alias("locs"))


@query(" SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a20_duplicates(spark, sf_dir):
    return A.duplicates(read_table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest")), ["digest"])


@query(" SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3")
def a21_crosstab(spark, sf_dir):
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.crosstab(d, ["lang", "quality", "toxic"])


@query(" SELECT coalesce(CAST(sample % 10 AS VARCHAR), 'ALL') AS category, count(*) FILTER (setting = '1' AND loc_top1) AS strict_1, count(*) FILTER (setting = '2' AND loc_top1) AS strict_2, count(*) FILTER (setting = '2' AND loc_top1) - count(*) FILTER (setting = '1' AND loc_top1) AS delta FROM rows_ GROUP BY ROLLUP (sample % 10)")
def a22_ablation(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("c", F.col("sample") % 10)
    out = R.ablation(r, "c", setting="setting", base="1", other="2", hit=F.col("loc_top1"))
    return out.select(F.coalesce(F.col("c").cast("string"), F.lit("ALL")).alias("category"), F.col("n_base").alias("strict_1"), F.col("n_other").alias("strict_2"), "delta")


_WILSON = "count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1"


@query(f""", c AS (SELECT lang, {_WILSON}), d AS (SELECT lang, k, n, CAST(k AS DOUBLE) / n AS p, 1.959964 * 1.959964 AS z FROM c)
    SELECT lang, k, n, round(p, 9) AS p, round(greatest(0, (p + z / (2 * n) - 1.959964 * sqrt(p * (1 - p) / n + z / (4.0 * n * n))) / (1 + z / n)), 9) AS low,
    round(least(1, (p + z / (2 * n) + 1.959964 * sqrt(p * (1 - p) / n + z / (4.0 * n * n))) / (1 + z / n)), 9) AS high FROM d""")
def st1_wilson(spark, sf_dir):
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    d = d.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    w = S.wilson(F.col("k"), F.col("n"))
    return d.select("lang", "k", "n", *[F.round(w[c], 9).alias(c) for c in ("p", "low", "high")])


_BC = ", bc AS (SELECT (sample % 40) AS g, count(*) FILTER (loc_top1 AND verdict <> 'PASS') % 40 AS b, count(*) FILTER (NOT loc_top1 AND verdict = 'PASS') % 30 AS c FROM rows_ GROUP BY 1)"
_PMF = _BC + """, n AS (SELECT g, b, c, b + c AS n, unnest(range(0, b + c + 1)) AS k FROM bc),
    p AS (SELECT *, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) AS p, exp(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) - n * ln(2)) AS pb FROM n)"""


def _bc(spark, sf_dir):
    loc, ok = F.col("loc_top1"), F.col("verdict") == "PASS"
    return rows(spark, sf_dir).groupBy((F.col("sample") % 40).alias("g")).agg((F.count_if(loc & ~ok) % 40).alias("b"), (F.count_if(~loc & ok) % 30).alias("c"))


@query(_PMF + " SELECT g, b, c, round(least(1, sum(CASE WHEN p <= pb * (1 + 1e-9) THEN p ELSE 0 END)), 6) AS p FROM p GROUP BY 1, 2, 3")
def st2_mcnemar(spark, sf_dir):
    return _bc(spark, sf_dir).select("g", "b", "c", F.round(S.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query(_PMF + " SELECT g, b, c, round(least(1, 2 * sum(CASE WHEN k <= least(b, c) THEN p ELSE 0 END)), 4) AS p FROM p GROUP BY 1, 2, 3")
def st3_mcnemar_doubled(spark, sf_dir):
    return _bc(spark, sf_dir).select("g", "b", "c", S.mcnemar_doubled(F.col("b"), F.col("c")).alias("p"))


@query(_BC + """, t AS (SELECT g, (b + 1) / 1000.0 AS p FROM bc), r AS (SELECT g, p, row_number() OVER (ORDER BY p, g) AS r, count(*) OVER () AS m FROM t)
    SELECT g, CAST(p AS DOUBLE) AS p, round(CAST(least(1, max(p * (m - r + 1)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS DOUBLE), 9) AS p_holm FROM r""")
def st4_holm(spark, sf_dir):
    t = _bc(spark, sf_dir).select("g", ((F.col("b") + 1) / 1000.0).alias("p"))  # one row a test
    return S.holm(t, order=["g"]).withColumn("p_holm", F.round("p_holm", 9))


@query(""", s AS (SELECT setting, count(*) FILTER (loc_top1) AS k, count(*) AS n FROM rows_ GROUP BY 1), j AS (SELECT a.setting AS sa, b.setting AS sb, CAST(a.k AS DOUBLE) / a.n AS p1, a.n AS n1, CAST(b.k AS DOUBLE) / b.n AS p2, b.n AS n2 FROM s a JOIN s b ON a.setting < b.setting)
    SELECT sa, sb, round(p1 - p2, 9) AS diff, round(p1 - p2 - 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 9) AS low, round(p1 - p2 + 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 9) AS high FROM j""")
def st6_risk_difference(spark, sf_dir):
    s = rows(spark, sf_dir).groupBy("setting").agg(F.count_if("loc_top1").alias("k"), F.count(F.lit(1)).alias("n"))
    a, b = s.toDF("sa", "k1", "n1"), s.toDF("sb", "k2", "n2")
    r = S.risk_difference(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return a.join(b, F.col("sa") < F.col("sb")).select("sa", "sb", *[F.round(r[c], 9).alias(c) for c in ("diff", "low", "high")])


@query(""", m AS (SELECT user_id % 3 AS grp, user_id AS subject, event_type AS rater, avg(event_id % 100) AS v FROM events GROUP BY 1, 2, 3),
    k AS (SELECT grp, count(DISTINCT rater) AS k FROM m GROUP BY 1), f AS (SELECT m.*, k, count(*) OVER (PARTITION BY grp, subject) AS c FROM m JOIN k USING (grp)), u AS (SELECT * FROM f WHERE c = k),
    b AS (SELECT grp, var_pop(v) AS var, count(DISTINCT subject) AS n, max(k) AS k FROM u GROUP BY 1),
    r AS (SELECT grp, var_pop(a) AS vr FROM (SELECT grp, subject, avg(v) AS a FROM u GROUP BY 1, 2) GROUP BY 1), c AS (SELECT grp, var_pop(a) AS vc FROM (SELECT grp, rater, avg(v) AS a FROM u GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT grp, n, k, k * vr * n / (n - 1) AS msr, n * vc * k / (k - 1) AS msc, (k * n * var - k * n * vr - n * k * vc) / ((n - 1) * (k - 1)) AS mse FROM b JOIN r USING (grp) JOIN c USING (grp))
    SELECT grp, n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM q""")
def st7_icc(spark, sf_dir):
    m = read_table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("grp"), F.col("user_id").alias("subject"), F.col("event_type").alias("rater")).agg(F.avg(F.col("event_id") % 100).alias("v"))
    return S.icc21(m, ["grp"], "subject", "rater", "v").withColumn("icc", F.round("icc", 6))


@query(" SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic <> 1) AS n10, count(*) FILTER (quality <> 1 AND toxic = 1) AS n01, count(*) FILTER (quality <> 1 AND toxic <> 1) AS n00 FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def st8_paired_table(spark, sf_dir):
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return d.groupBy("lang").agg(*S.paired_table(F.col("quality") == 1, F.col("toxic") == 1))


@query(" SELECT lang, round(avg(1.0 / len(string_split(text, chr(10)))), 9) AS expected FROM documents GROUP BY 1")
def st9_random_hit(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(F.avg(1.0 / F.size(F.split("text", "\n"))), 9).alias("expected"))


@query(", pr AS (SELECT * FROM (VALUES ('1', 3.0, 15.0), ('2', 0.5, 2.0), ('3', 1.0, 4.0)) t(setting, pi, po)) SELECT setting, seed, CAST(round((input_tokens * pi + output_tokens * po) / 1e6, 8) AS DOUBLE) AS cost FROM rows_ JOIN pr USING (setting)")
def st11_cost(spark, sf_dir):
    price = spark.createDataFrame([("1", 3.0, 15.0), ("2", 0.5, 2.0), ("3", 1.0, 4.0)], "setting string, pi double, po double")
    r = rows(spark, sf_dir).join(F.broadcast(price), "setting")  # three rows
    return r.select("setting", "seed", S.cost(F.col("input_tokens"), F.col("output_tokens"), F.col("pi"), F.col("po")).alias("cost"))


@query(" SELECT sample, count(*) AS n FROM rows_ GROUP BY 1 ORDER BY n DESC, sample LIMIT 12")
def t2_top_samples(spark, sf_dir):
    return R.largest(rows(spark, sf_dir), ["sample"], 12)


@query(""", s AS (SELECT sample, setting, seed, round(0.5 * p + 0.3 * (1 - CAST(loc_line AS DOUBLE) / greatest(1, max(loc_line) OVER (PARTITION BY sample, setting))) + 0.2 * p, 6) AS score
        FROM (SELECT *, CAST(verdict = 'PASS' AS INT) AS p FROM rows_))
    SELECT sample, setting, seed, score, CAST(row_number() OVER (PARTITION BY sample, setting ORDER BY score DESC, seed) AS INT) AS rank FROM s""")
def t3_arbitration(spark, sf_dir):
    c = rows(spark, sf_dir).select("sample", "setting", "seed", "loc_line", (F.col("verdict") == "PASS").alias("ok"))
    return A.arbitrate(c, ["sample", "setting"], passed="ok", lines="loc_line", order=["seed"], digits=6).select("sample", "setting", "seed", "score", "rank")


@query(" SELECT sample, arg_min(seed, CASE setting WHEN '2' THEN 0 WHEN '1' THEN 1 ELSE 2 END * 1000000000 + seed) AS seed FROM rows_ WHERE setting IN ('1', '2', '3') GROUP BY 1")
def t5_preference(spark, sf_dir):
    r = rows(spark, sf_dir).select("sample", "setting", "seed")
    return A.preferred(r, ["sample"], "setting", ["2", "1", "3"], ["seed"]).select("sample", "seed")


@query(" SELECT c_custkey AS id, 'c' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 's', NULL FROM supplier")
def so1_union(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind"))
    return R.stacked(c, s)


@query(" (SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'first' FROM customer EXCEPT SELECT s_nationkey, 'first' FROM supplier)")
def so2_set_operations(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return R.both_and_first(c, s)


@query(" SELECT seed, verdict FROM rows_ WHERE setting <> '3' UNION ALL SELECT seed, 'OTHER' FROM rows_ WHERE setting = '3'")
def so3_replace_partition(spark, sf_dir):
    r = rows(spark, sf_dir).select("seed", "setting", "verdict")
    return A.replace_partition(r, r.withColumn("verdict", F.lit("OTHER")), F.col("setting") == "3").select("seed", "verdict")


@query(", r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) SELECT c_mktsegment, c_custkey FROM r ORDER BY rn, c_mktsegment LIMIT 23")
def sch3_round_robin(spark, sf_dir):
    return A.round_robin_sample(read_table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"], 23).select("c_mktsegment", "c_custkey")


@query()
def sch1_balance(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("group")).agg(F.sum("c_custkey").cast("double").alias("weight"))
    return A.balance(c, 8)


@query(", t AS (SELECT s_nationkey AS n, count(*) * 1.5 AS v, CASE WHEN s_nationkey % 2 = 0 THEN 2.0 END AS g FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) SELECT n_nationkey AS sample, CAST(CASE WHEN t.n IS NULL THEN 5.0 ELSE v + coalesce(g, 0) END AS DOUBLE) AS weight FROM nation LEFT JOIN t ON n_nationkey = t.n")
def sch2_weights(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("sample"))
    timing = s.agg((F.count(F.lit(1)) * 1.5).cast("double").alias("verify_s")).withColumn("golden_s", F.when(F.col("sample") % 2 == 0, 2.0))
    return A.weights(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample")), timing)


@query(" SELECT user_id % 100 AS session, count(*) AS calls, CAST(round(sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END), 4) AS DOUBLE) AS cost FROM events GROUP BY 1")
def a11_session_cost(spark, sf_dir):
    cost = F.when(F.col("event_type") != "view", F.col("value"))
    out = A.session_cost(read_table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("session"), cost.alias("cost")))
    return out.withColumn("cost", F.round("cost", 4))


@query(" SELECT sample, setting, seed, row_number() OVER (ORDER BY sample, setting, seed) AS place FROM rows_")
def t1_sorted_rows(spark, sf_dir):
    """All rows with their place in the order."""
    return numbered(rows(spark, sf_dir).select("sample", "setting", "seed"), ["sample", "setting", "seed"])


@query(" SELECT l_returnflag AS flag, l_linestatus AS status, count(l_extendedprice) AS n, quantile_disc(l_extendedprice, 0.5) AS lower_median, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY 1, 2")
def a8_price_medians(spark, sf_dir):
    """Medians of large groups, the upper and the lower one, by selection."""
    r = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("median"))
    upper = order_statistic(r, ["flag", "status"], "median", lambda n: F.floor(n / 2))
    lower = order_statistic(r, ["flag", "status"], "median", lambda n: F.floor((n - 1) / 2)).select("flag", "status", F.col("median").alias("lower_median"))
    return upper.join(lower, ["flag", "status"])


_LOGS = """, k AS (SELECT seed, seed % 7 AS a, seed % 5 AS b FROM rows_),
    l AS (SELECT seed, a, b, a = 0 AS timeout, CASE a WHEN 1 THEN 'x ERROR y' WHEN 2 THEN 'Assert failed' WHEN 3 THEN 'successful proof by k-induction DONE (PASS' WHEN 4 THEN 'DONE (PASS' WHEN 5 THEN 'basecase: Pass' || chr(10) || 'induction: Fail' ELSE 'nothing' END AS text FROM k)"""


def _logs(spark, sf_dir) -> DataFrame:
    a = F.col("seed") % 7
    text = F.when(a == 1, "x ERROR y").when(a == 2, "Assert failed").when(a == 3, "successful proof by k-induction DONE (PASS").when(a == 4, "DONE (PASS")
    text = text.when(a == 5, "basecase: Pass\ninduction: Fail").otherwise("nothing")
    return rows(spark, sf_dir).select("seed", (F.col("seed") % 5).alias("b"), (a == 0).alias("timeout"), text.alias("text"))


@query(_LOGS + """ SELECT seed, CASE WHEN timeout THEN 'timeout' WHEN b = 3 OR contains(text, 'ERROR') THEN 'error' WHEN b = 2 OR contains(text, 'Assert failed') THEN 'fail' WHEN contains(text, 'k-induction') THEN 'prove'
    WHEN b = 0 AND contains(text, 'DONE (PASS') THEN 'pass' ELSE 'error' END AS formal FROM l""")
def p3_formal_classifier(spark, sf_dir):
    return _logs(spark, sf_dir).select("seed", A.classify_formal(F.col("text"), F.col("b"), F.col("timeout"), F.col("b") == 3).alias("formal"))


@query(_LOGS + """ SELECT seed, CASE WHEN contains(text, 'k-induction') THEN 'PROVE' WHEN contains(text, 'basecase') THEN 'PASS' WHEN contains(text, 'DONE (PASS') THEN 'PASS' WHEN timeout THEN 'TIMEOUT' ELSE 'ERROR' END AS state FROM l""")
def p4_induction_classifier(spark, sf_dir):
    return _logs(spark, sf_dir).select("seed", A.classify_induction(F.col("text"), F.col("timeout")).alias("state"))


@query(" SELECT seed, seed % 5 = 0 AND seed % 7 <> 0 AND seed % 3 = 0 AND seed % 2 = 0 AS ok FROM rows_")
def p5_simulation_ok(spark, sf_dir):
    s = F.col("seed")
    text = F.concat(F.when(s % 3 == 0, "run ").when(s % 3 == 1, "$fatal ").otherwise("FAIL "), F.when(s % 2 == 0, "$finish").otherwise("cut"))
    return rows(spark, sf_dir).select("seed", A.simulation_ok(text, s % 5, s % 7 == 0).alias("ok"))


@query(" SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'house' WHEN c_mktsegment LIKE '%MACHINE%' THEN 'machine' WHEN c_mktsegment = 'HOUSEHOLD' THEN '?' ELSE c_mktsegment END AS kind FROM customer")
def p13_category(spark, sf_dir):
    seg = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.col("c_mktsegment"))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), A.category(seg, {"BUILDING": "house", "MACHINE": "machine"}).alias("kind"))


@query(""", t AS (SELECT sample, seed AS attempt, verdict = 'PASS' AS ok, 'd' || seed AS diff, setting AS failure FROM rows_), g AS (SELECT sample FROM t GROUP BY 1 HAVING NOT bool_or(ok)),
    r AS (SELECT t.*, row_number() OVER (PARTITION BY sample ORDER BY attempt DESC) AS rn FROM t JOIN g USING (sample))
    SELECT sample, string_agg(attempt || ':' || diff || ':' || failure, ' ' ORDER BY attempt) AS history FROM r WHERE rn <= 3 GROUP BY 1""")
def s4_retry_history(spark, sf_dir):
    t = rows(spark, sf_dir).select("sample", F.col("seed").alias("attempt"), (F.col("verdict") == "PASS").alias("ok"), F.concat(F.lit("d"), F.col("seed").cast("string")).alias("diff"), F.col("setting").alias("failure"))
    told = F.transform("history", lambda h: F.concat_ws(":", h["attempt"].cast("string"), h["diff"], h["failure"]))
    return E.retry_history(t, ["sample"]).select("sample", F.array_join(told, " ").alias("history"))


@query(" SELECT event_type AS caller, count(*) AS calls, count(*) FILTER (user_id % 3 <> 0) AS real_calls, count(*) FILTER (user_id % 3 = 0) AS mock_calls, CAST(sum(event_id % 50) AS BIGINT) AS input_tokens FROM events GROUP BY 1")
def s1_ledger(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    ledger = e.select(
        F.col("event_type").alias("caller"), "ts", (F.col("event_id") % 50).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("cost"), (F.col("user_id") % 3 == 0).alias("mock")
    )
    return ledger_summary(ledger, ["caller"]).select("caller", "calls", "real_calls", "mock_calls", "input_tokens")
