"""Regime scores on breadth, sectors, ratios and input tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourselake.functions import r2, r4, r6, yes
from bourselake.operators import breadth as br, indicators as ind, regimes as rg, relations as rel, sectors as sec
from bourselake.operators.scorecard import scorecard
from bourselake.operators.universe import BREADTH_200_CLASSES, BREADTH_8_CLASSES
from bourselake.plans.aggregates import bench_monthly
from bourselake.plans.registry import query
from bourselake.plans.views import add_view, avg, ewm_view, tr
from bourselake.session import cut_lineage
from bourselake.sources.market import Market

O = "ORDER BY date"
RUN = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def detail(m: Market):
    return rg.breadth_detail(br.breadth_series(m.bars), m.bench_index)


add_view("bdetail", "breadth bench_index", f"""
WITH a AS (SELECT date, pct_above_200 AS breadth_raw, close AS index_price, R6({avg('pct_above_200', 8, by=O)}) AS ma8, R6({avg('pct_above_200', 200, by=O)}) AS ma200 FROM breadth JOIN bench_index USING (date)),
b AS (SELECT *, LAG(ma8) OVER ({O}) AS o1, LAG(ma8, 2) OVER ({O}) AS o2, CASE WHEN ma200 > LAG(ma200) OVER ({O}) THEN 1 ELSE -1 END AS trend, ROW_NUMBER() OVER ({O}) AS k FROM a WHERE ma200 IS NOT NULL)
SELECT *, trend = -1 AND ma8 < ma200 AND ma8 < 0.5 AS bearish, COALESCE(o1 > o2 AND o1 >= ma8 AND o1 >= 0.6, FALSE) AS is_peak, COALESCE(o1 < o2 AND o1 <= ma8 AND o1 <= 0.5, FALSE) AS is_trough,
  COALESCE(o1 < o2 AND o1 <= ma8 AND o1 < 0.4, FALSE) AS is_low FROM b""")
add_view("marked", "bdetail", f"""
WITH a AS (SELECT *, MAX(CASE WHEN is_peak OR is_trough OR is_low THEN k END) OVER {RUN} AS mk FROM bdetail)
SELECT a.*, CASE WHEN a.k - mk < 120 THEN CASE WHEN b.is_peak THEN 'PEAK' ELSE 'TROUGH' END END AS marker, CASE WHEN a.k - mk < 120 THEN CAST(a.k - mk AS DOUBLE) END AS days_since,
  CASE WHEN a.k - mk < 120 THEN b.is_low END AS marker_low FROM a LEFT JOIN (SELECT k AS kk, is_peak, is_low FROM bdetail) b ON b.kk = a.mk""")


@query("latest_marker", "marked", "SELECT date, marker, days_since FROM marked")
def q_marker(m):
    return rg.latest_marker(detail(m)).select("date", "marker", "days_since")


add_view("pinked", "marked", f"""SELECT *, trend = -1 AND ma8 < ma200 AS pink, k - COALESCE(MAX(CASE WHEN NOT (trend = -1 AND ma8 < ma200) THEN k END) OVER {RUN}, 0) AS pink_days FROM marked""")


@query("consecutive_run", "pinked", "SELECT date, pink, CAST(pink_days AS BIGINT) AS pink_days FROM pinked")
def q_run(m):
    return rg.pink_run(detail(m)).select("date", "pink", F.col("pink_days").cast("bigint"))


def div_sql(p, b):
    return (f"CASE WHEN {p} > 3 AND {b} < -0.05 THEN 10 WHEN {p} > 1 AND {b} < -0.03 THEN 25 WHEN {p} < -3 AND {b} > 0.05 THEN 80 WHEN {p} < -1 AND {b} > 0.03 THEN 65 "
            f"WHEN ABS({p}) < 0.5 AND ABS({b}) < 0.01 THEN 50 WHEN {p} > 0 AND {b} > 0 THEN 70 WHEN {p} <= 0 AND {b} <= 0 THEN 30 ELSE 50 END")


add_view("diverged", "pinked", f"""
WITH a AS (SELECT *, """ + ", ".join(f"R6((index_price / COALESCE(LAG(index_price, {n - 1}) OVER ({O}), FIRST_VALUE(index_price) OVER ({O})) - 1) * 100) AS p{n}, "
                                   f"R6(ma8 - COALESCE(LAG(ma8, {n - 1}) OVER ({O}), FIRST_VALUE(ma8) OVER ({O}))) AS b{n}" for n in (60, 20)) + f""" FROM pinked)
SELECT *, CAST({div_sql('p60', 'b60')} AS DOUBLE) AS score_60, CAST({div_sql('p20', 'b20')} AS DOUBLE) AS score_20 FROM a""")


@query("divergence", "diverged", "SELECT date, p60, b60, p20, b20, score_60, score_20, R4(score_60 * 0.6 + score_20 * 0.4) AS divergence, score_20 <= 25 AND score_60 >= 50 AS early_warning FROM diverged")
def q_divergence(m):
    return rg.divergence(detail(m)).select("date", "p60", "b60", "p20", "b20", "score_60", "score_20", r4("divergence").alias("divergence"), "early_warning")


def steps_sql(x, steps, otherwise, strict=False):
    op = ">" if strict else ">="
    return "CASE " + " ".join(f"WHEN {x} {op} {t} THEN {v!r}" for t, v in steps) + f" ELSE {otherwise!r} END"


def clip(x):
    return f"LEAST(GREATEST({x}, 0), 100)"


def cycle_sql():
    parts = []
    for kind, steps in rg.CYCLE.items():
        for days, up, dn in steps:
            cond = f"AND days_since <= {days}" if days else ""
            parts.append(f"WHEN marker = '{kind}' {cond} THEN CASE WHEN up THEN {up} ELSE {dn} END")
    return "CASE " + " ".join(parts) + " ELSE 50 END"


add_view("components", "diverged", f"""
WITH a AS (SELECT *, COALESCE(ma8 > LAG(ma8, 5) OVER ({O}), FALSE) AS up, COALESCE(ma8 < LAG(ma8, 5) OVER ({O}), FALSE) AS dn, score_60 * 0.6 + score_20 * 0.4 AS divergence FROM diverged)
SELECT *, {clip(f"ROUND_EVEN({steps_sql('ma8', rg.LEVEL, 5.0)} * 0.7 + CASE WHEN trend = 1 THEN 80 ELSE 20 END * 0.3, 0) + CASE WHEN dn AND ma8 > 0.6 THEN -10 WHEN dn AND ma8 < 0.4 THEN 5 WHEN up AND ma8 < 0.6 THEN 5 ELSE 0 END")} AS level,
  {clip(f"{steps_sql('(ma8 - ma200)', rg.GAP, 5.0)} + CASE WHEN ma8 - ma200 < 0 AND up THEN 10 WHEN ma8 - ma200 > 0 AND NOT up THEN -10 ELSE 0 END")} AS crossover,
  {clip(f"{cycle_sql()} + CASE WHEN marker = 'TROUGH' AND marker_low THEN 10 ELSE 0 END")} AS cycle,
  {clip("CASE WHEN NOT bearish AND trend = 1 THEN 85 WHEN NOT bearish THEN 50 WHEN trend = 1 THEN 30 ELSE 10 END + CASE WHEN bearish AND ma8 > 0.5 THEN 15 WHEN bearish AND ma8 < 0.25 THEN -5 ELSE 0 END + CASE WHEN pink AND NOT bearish THEN -10 ELSE 0 END")} AS bearish_score FROM a""")
CO = ("level", "crossover", "cycle", "bearish_score")


@query("breadth_components", "components", "SELECT date, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CO) + " FROM components")
def q_components(m):
    return rg.breadth_components(detail(m)).select("date", *CO)


@query("breadth_health", "components bdetail", f"""
WITH h AS (SELECT COUNT(*) FILTER (ma8 < n) * 100.0 / COUNT(*) AS pct, AVG(ma8) FILTER (is_peak) AS peak, AVG(ma8) FILTER (is_low) AS trough FROM bdetail, (SELECT ARG_MAX(ma8, date) AS n FROM bdetail)),
l AS (SELECT *, {clip(f"{steps_sql('pct', rg.PERCENTILE, 10.0)} + CASE WHEN ma8 >= peak * 0.95 THEN -10 WHEN ma8 <= trough * 1.05 THEN 10 ELSE 0 END")} AS percentile FROM components, h WHERE date = (SELECT MAX(date) FROM components)),
c AS (SELECT *, (level * 0.25 + crossover * 0.2 + CASE WHEN marker IS NOT NULL THEN cycle * 0.2 ELSE 0 END + bearish_score * 0.15 + percentile * 0.1 + divergence * 0.1) / (0.8 + CASE WHEN marker IS NOT NULL THEN 0.2 ELSE 0 END) AS composite FROM l)
SELECT date, CAST(level AS DOUBLE) AS level, CAST(crossover AS DOUBLE) AS crossover, CAST(cycle AS DOUBLE) AS cycle, CAST(bearish_score AS DOUBLE) AS bearish_score, CAST(percentile AS DOUBLE) AS percentile, R4(composite) AS composite,
  {steps_sql('composite', rg.HEALTH_ZONES, 'Critical')} AS zone FROM c""")
def q_health(m):
    df = rg.breadth_health(cut_lineage(detail(m)))
    return df.select("date", *CO, "percentile", r4("composite").alias("composite"), "zone")


@query("breadth_key_levels", "bdetail", """WITH a AS (SELECT ARG_MAX(ma200, date) AS ma200_level, CAST(0.4 AS DOUBLE) AS extreme_weakness, CAST(0.6 AS DOUBLE) AS healthy_threshold, AVG(ma8) FILTER (is_peak) AS average_peak,
  AVG(ma8) FILTER (is_low) AS average_trough FROM bdetail) SELECT level, R4(value) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME level VALUE value) WHERE value IS NOT NULL""")
def q_levels(m):
    return rg.key_levels(detail(m)).withColumn("value", r4("value"))


@query("value_bands", "bdetail", f"""SELECT date, ma8, ma200, {steps_sql('ma8 * 100', BREADTH_8_CLASSES, 'oversold')} AS class_8, {steps_sql('ma200 * 100', BREADTH_200_CLASSES, 'fragile')} AS class_200, ma8 < ma200 AS dead_cross FROM bdetail""")
def q_bands(m):
    return rg.value_bands(detail(m), BREADTH_8_CLASSES, BREADTH_200_CLASSES).select("date", "ma8", "ma200", "class_8", "class_200", "dead_cross")


@query("last_n_trend", "bench_index", """WITH k AS (SELECT date, close, ROW_NUMBER() OVER (ORDER BY date DESC) AS k FROM bench_index), d AS (SELECT ARG_MAX(close, date) - ARG_MIN(close, date) AS delta FROM k WHERE k <= 5)
SELECT R4(delta) AS delta, CASE WHEN delta > 2 THEN 'improving' WHEN delta < -2 THEN 'deteriorating' ELSE 'stable' END AS direction FROM d""")
def q_trend(m):
    df = rg.score_trend(m.bench_index.select(F.col("date").alias("data_date"), F.col("close").alias("score")))
    return df.withColumn("delta", r4("delta"))


# -- uptrend ------------------------------------------------------------------------------------------
GROUP = {"AFRICA": "commodity", "AMERICA": "cyclical", "ASIA": "cyclical", "EUROPE": "defensive", "MIDDLE EAST": "defensive"}
GROUP_CASE = "CASE sector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUP.items()) + " END"


def groups(m: Market):
    label = F.lit(None).cast("string")
    for k, v in GROUP.items():
        label = F.when(F.col("sector") == k, v).otherwise(label)
    return m.constituents.select("sector").distinct().withColumn("group", label)


def series(m: Market):
    up = yes((F.col("close") > ind.sma("close", 50)) & (ind.sma("close", 50) > ind.sma("close", 200)))
    return rg.uptrend_series(m.bars.select("symbol", "date", up.alias("up")), m.constituents)


WS = "PARTITION BY worksheet ORDER BY date"
add_view("uptrend", "bars constituents", f"""
WITH f AS (SELECT symbol, date, COALESCE(close > {avg('close', 50)} AND {avg('close', 50)} > {avg('close', 200)}, FALSE) AS up FROM bars),
c AS (SELECT sector AS worksheet, date, COUNT(*) FILTER (up) AS count, COUNT(*) AS total FROM f JOIN constituents USING (symbol) GROUP BY 1, 2 UNION ALL SELECT 'all', date, COUNT(*) FILTER (up), COUNT(*) FROM f GROUP BY date),
r AS (SELECT *, R6(count / CAST(total AS DOUBLE)) AS ratio FROM c), m AS (SELECT *, R6(AVG(ratio) OVER {tr(10, WS)}) AS ma_10 FROM r), s AS (SELECT *, R6(ma_10 - LAG(ma_10) OVER ({WS})) AS slope FROM m)
SELECT *, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS trend FROM s""")


@query("uptrend_series", "uptrend", "SELECT * FROM uptrend")
def q_series(m):
    return series(m)


add_view("summary", "uptrend", f"""SELECT worksheet AS sector, date, count, total, ratio, ma_10, slope, trend, CASE WHEN ratio > 0.37 THEN 'Overbought' WHEN ratio < 0.097 THEN 'Oversold' ELSE 'Normal' END AS status,
  {GROUP_CASE.replace('CASE sector', 'CASE worksheet')} AS grp FROM uptrend WHERE worksheet <> 'all' QUALIFY ROW_NUMBER() OVER (PARTITION BY worksheet ORDER BY date DESC) = 1""")


@query("sector_summary_build", "summary", "SELECT * EXCLUDE (grp) FROM summary")
def q_summary(m):
    return rg.sector_summary(series(m))


add_view("gtable", "summary", """SELECT *, CASE WHEN n_up >= n - n_up THEN n - n_up ELSE n_up END AS dissenters, n >= 2 AND (std_dev > 0.08 OR spread > 0.2 OR CASE WHEN n_up >= n - n_up THEN n - n_up ELSE n_up END > 0) AS flagged FROM (
  SELECT grp, AVG(ratio) AS mean_ratio, STDDEV_POP(ratio) AS std_dev, MAX(ratio) - MIN(ratio) AS spread, COUNT(*) AS n, COUNT(*) FILTER (trend = 'up') AS n_up FROM summary GROUP BY grp)""")


@query("group_divergence", "gtable", 'SELECT grp AS "group", R6(mean_ratio) AS mean_ratio, R6(std_dev) AS std_dev, R6(spread) AS spread, n, dissenters, flagged FROM gtable')
def q_groups(m):
    df = rg.group_table(rg.sector_summary(series(m)), groups(m))
    return df.select("group", *[r6(c).alias(c) for c in ("mean_ratio", "std_dev", "spread")], "n", "dissenters", "flagged")


add_view("rotation", "gtable", """
WITH o AS (SELECT MAX(CASE WHEN grp = 'cyclical' THEN mean_ratio END) AS cyclical, MAX(CASE WHEN grp = 'defensive' THEN mean_ratio END) AS defensive, MAX(CASE WHEN grp = 'commodity' THEN mean_ratio END) AS commodity,
  COALESCE(BOOL_OR(flagged) FILTER (grp <> 'commodity'), FALSE) AS divergence FROM gtable),
d AS (SELECT *, cyclical - defensive AS d, COALESCE(commodity > cyclical AND commodity > defensive, FALSE) AS late_cycle FROM o)
SELECT *, ROUND_EVEN(LEAST(GREATEST(CASE WHEN d > 0.15 THEN LEAST(100, 90 + (d - 0.15) / 0.1 * 10) WHEN d > 0.05 THEN 70 + (d - 0.05) / 0.1 * 19 WHEN d > -0.05 THEN 45 + (d + 0.05) / 0.1 * 24 WHEN d > -0.15 THEN 20 + (d + 0.15) / 0.1 * 24
  ELSE GREATEST(0, 19 + (d + 0.15) / 0.1 * 19) END + CASE WHEN late_cycle THEN CASE WHEN commodity - GREATEST(cyclical, defensive) > 0.1 THEN -10 ELSE -5 END ELSE 0 END + CASE WHEN divergence THEN -5 ELSE 0 END, 0), 100), 0) AS score FROM d""")


@query("group_avgs", "rotation", "SELECT R6(cyclical) AS cyclical, R6(defensive) AS defensive, R6(commodity) AS commodity, R6(d) AS difference, late_cycle, divergence, CAST(score AS DOUBLE) AS score FROM rotation")
def q_rotation(m):
    df = rg.rotation_score(rg.group_table(rg.sector_summary(series(m)), groups(m)))
    return df.select(*[r6(c).alias(c) for c in ("cyclical", "defensive", "commodity", "difference")], "late_cycle", "divergence", "score")


ewm_view("smooth", "uptrend", "slope", 0.5, keys="worksheet")
add_view("moment", "smooth", f"""
WITH a AS (SELECT worksheet, date, rn, y, {avg('y', 10, by=WS)} AS m10, {avg('y', 5, by=WS)} AS m5 FROM smooth)
SELECT worksheet, date, y AS smoothed, CASE WHEN rn >= 20 THEN m10 - LAG(m10, 10) OVER ({WS}) WHEN rn >= 10 THEN m5 - LAG(m5, 5) OVER ({WS}) END AS acceleration FROM a""")


@query("slope_accel", "moment", "SELECT worksheet, date, R6(smoothed) AS smoothed, R6(acceleration) AS acceleration FROM moment")
def q_momentum(m):
    return rg.momentum(series(m)).select("worksheet", "date", r6("smoothed").alias("smoothed"), r6("acceleration").alias("acceleration"))


@query("uptrend_health", "uptrend summary rotation moment", """
WITH a AS (SELECT ARG_MAX(ratio, date) AS r, ARG_MAX(trend, date) AS t, ARG_MAX(slope, date) AS s FROM uptrend WHERE worksheet = 'all'),
p AS (SELECT COUNT(*) FILTER (trend = 'up') AS up, COUNT(*) AS n, MAX(ratio) - MIN(ratio) AS sp, COUNT(*) FILTER (slope > 0) AS pos FROM summary),
x AS (SELECT ARG_MAX(smoothed, date) AS sm, ARG_MAX(acceleration, date) AS ac FROM moment WHERE worksheet = 'all'),
h AS (SELECT (COUNT(*) FILTER (ratio < a.r) + COUNT(*) FILTER (ratio = a.r) * 0.5) * 100.0 / COUNT(*) AS h FROM uptrend, a WHERE worksheet = 'all'),
c AS (SELECT ROUND_EVEN(LEAST(GREATEST(CASE WHEN r >= 0.5 THEN LEAST(100, 90 + (r - 0.5) / 0.1 * 10) WHEN r >= 0.37 THEN 70 + (r - 0.37) / 0.13 * 19 WHEN r >= 0.25 THEN 40 + (r - 0.25) / 0.12 * 29 WHEN r >= 0.097 THEN 10 + (r - 0.097) / 0.153 * 29
    ELSE GREATEST(0, r / 0.097 * 9) END + CASE WHEN t = 'up' AND s > 0 THEN 5 WHEN t = 'down' AND s < 0 THEN -5 ELSE 0 END, 0), 100), 0) AS market,
  ROUND_EVEN(CASE WHEN up >= 10 THEN 100 WHEN up >= 8 THEN 80 WHEN up >= 6 THEN 60 WHEN up >= 4 THEN 40 WHEN up >= 2 THEN 20 ELSE 0 END * 0.6 + CASE WHEN sp < 0.15 THEN 100 WHEN sp < 0.25 THEN 100 - (sp - 0.15) / 0.1 * 20 WHEN sp < 0.35 THEN 80 - (sp - 0.25) / 0.1 * 20
    WHEN sp < 0.45 THEN 60 - (sp - 0.35) / 0.1 * 30 ELSE GREATEST(0, 30 - (sp - 0.45) / 0.1 * 30) END * 0.4, 0) AS participation, score AS rotation,
  ROUND_EVEN(CASE WHEN sm >= 0.02 THEN LEAST(100, 95 + (sm - 0.02) / 0.01 * 5) WHEN sm >= 0.01 THEN 75 + (sm - 0.01) / 0.01 * 19 WHEN sm >= 0 THEN 55 + sm / 0.01 * 19 WHEN sm >= -0.01 THEN 35 + (sm + 0.01) / 0.01 * 19 WHEN sm >= -0.02 THEN 10 + (sm + 0.02) / 0.01 * 24
    ELSE GREATEST(0, 9 + (sm + 0.02) / 0.01 * 9) END * 0.5 + CASE WHEN ac > 0.005 THEN 90 WHEN ac > 0.001 THEN 75 WHEN ac > -0.001 THEN 50 WHEN ac > -0.005 THEN 25 ELSE 10 END * 0.3 + pos * 100.0 / n * 0.2, 0) AS momentum,
  ROUND_EVEN(FLOOR(h * 10 + 0.50001) / 10, 0) AS history, late_cycle, sp > 0.4 AS high_spread, divergence FROM a, p, x, h, rotation),
q AS (SELECT *, CASE WHEN late_cycle THEN -5 ELSE 0 END + CASE WHEN high_spread THEN -3 ELSE 0 END + CASE WHEN divergence THEN -3 ELSE 0 END + CASE WHEN CAST(late_cycle AS INT) + CAST(high_spread AS INT) + CAST(divergence AS INT) >= 2 THEN 1 ELSE 0 END AS penalty,
  market * 0.3 + participation * 0.25 + rotation * 0.15 + momentum * 0.2 + history * 0.1 AS raw FROM c), z AS (SELECT *, LEAST(GREATEST(raw + penalty, 0), 100) AS composite FROM q)
SELECT market, participation, rotation, momentum, history, CAST(penalty AS DOUBLE) AS penalty, R4(raw) AS raw, R4(composite) AS composite, CASE WHEN composite >= 80 THEN 'Strong Bull' WHEN composite >= 70 THEN 'Bull-Upper' WHEN composite >= 60 THEN 'Bull-Lower'
  WHEN composite >= 40 THEN 'Neutral' WHEN composite >= 30 THEN 'Cautious-Upper' WHEN composite >= 20 THEN 'Cautious-Lower' ELSE 'Bear' END AS zone,
  R4(LEAST(ABS(composite - 20), ABS(composite - 40), ABS(composite - 60), ABS(composite - 80))) AS boundary_distance FROM z""")
def q_uptrend(m):
    df = rg.uptrend_health(cut_lineage(series(m)), groups(m))
    return df.select("market", "participation", "rotation", "momentum", "history", "penalty",
                     *[r4(c).alias(c) for c in ("raw", "composite", "boundary_distance")], "zone")


@query("uptrend_india", "sector_agg breadth", f"""
WITH a AS (SELECT AVG(ratio) AS ar, AVG(CASE WHEN ratio > 0.5 THEN 1 ELSE 0 END) AS pt, COALESCE(AVG(ratio) FILTER ({GROUP_CASE} = 'cyclical'), 0) - COALESCE(AVG(ratio) FILTER ({GROUP_CASE} = 'defensive'), 0) AS d,
  AVG(CASE WHEN momentum_20d > 0 THEN 1 ELSE 0 END) FILTER (momentum_20d IS NOT NULL) AS mo FROM sector_agg),
h AS (SELECT CASE WHEN COUNT(*) >= 20 THEN COUNT(*) FILTER (R6(pct_above_50) < ar) * 100.0 / COUNT(*) ELSE 50 END AS historical FROM breadth, a),
t AS (SELECT ar * 100 AS breadth, pt * 100 AS participation, LEAST(GREATEST(50 + d * 100, 0), 100) AS rotation, COALESCE(mo * 100, 50) AS momentum, historical FROM a, h),
c AS (SELECT *, breadth * 0.3 + participation * 0.25 + rotation * 0.15 + momentum * 0.2 + historical * 0.1 AS composite FROM t)
SELECT R4(breadth) AS breadth, R4(participation) AS participation, R4(rotation) AS rotation, R4(momentum) AS momentum, R4(historical) AS historical, R4(composite) AS composite,
  CASE WHEN composite >= 65 THEN 'healthy' WHEN composite < 40 THEN 'weak' ELSE 'mixed' END AS signal FROM c""")
def q_india(m):
    agg = cut_lineage(sec.sector_aggregate(sec.constituent_metrics(m.bars), m.constituents))
    history = br.breadth_series(m.bars).select(r6("pct_above_50").alias("avg_ratio"))
    df = rg.uptrend_simple(agg, groups(m), history)
    return df.select(*[r4(c).alias(c) for c in ("breadth", "participation", "rotation", "momentum", "historical", "composite")], "signal")


PHASES = {"early": (["AMERICA", "ASIA"], ["EUROPE"]), "mid": (["AMERICA", "AFRICA"], ["EUROPE", "MIDDLE EAST"]),
          "late": (["AFRICA", "EUROPE"], ["AMERICA", "ASIA"]), "recession": (["EUROPE", "MIDDLE EAST"], ["AMERICA"])}
PHASE_ROWS = [(p, role, s) for p, (lead, lagg) in PHASES.items() for role, names in (("leader", lead), ("laggard", lagg)) for s in names]


@query("cycle_phase", "summary", f"""
WITH ph(phase, role, sector) AS (VALUES {', '.join(str(r) for r in PHASE_ROWS)}), k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ratio DESC, sector) AS k, COUNT(*) OVER () AS n FROM summary),
j AS (SELECT ph.*, k.trend, k.k <= FLOOR(k.n / 2) + 1 AS top, k.k > FLOOR(k.n / 2) AS bottom FROM ph LEFT JOIN k USING (sector)),
g AS (SELECT phase, AVG(CASE WHEN COALESCE(top, FALSE) THEN 1 ELSE 0 END) FILTER (role = 'leader') AS leaders, AVG(CASE WHEN COALESCE(bottom, FALSE) THEN 1 ELSE 0 END) FILTER (role = 'laggard') AS laggards,
  AVG(CASE WHEN (role = 'leader' AND trend = 'up') OR (role = 'laggard' AND trend = 'down') THEN 1 ELSE 0 END) FILTER (trend IS NOT NULL) AS trends FROM j GROUP BY phase)
SELECT phase, R4(leaders) AS leaders, R4(laggards) AS laggards, R4(COALESCE(trends, 0)) AS trends, R4((leaders * 0.4 + laggards * 0.3 + COALESCE(trends, 0) * 0.3) * 100) AS score FROM g""")
def q_phase(m):
    phases = m.spark.createDataFrame(PHASE_ROWS, "phase string, role string, sector string")
    df = rg.cycle_phase(rg.sector_summary(series(m)), phases)
    return df.select("phase", *[r4(c).alias(c) for c in ("leaders", "laggards", "trends", "score")])


def interp_sql(x, knots):
    parts = [f"WHEN {x} <= {float(knots[0][0])!r} THEN {float(knots[0][1])!r}"]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        parts.append(f"WHEN {x} <= {float(x1)!r} THEN {float(y0)!r} + ({x} - {float(x0)!r}) * {(y1 - y0) / (x1 - x0)!r}")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {float(knots[-1][1])!r} END"


ALIGN_CASE = "CASE " + " ".join(f"WHEN u = {a} AND b = {b} THEN {v}" for (a, b), v in rg.ALIGN.items()) + " ELSE 8.0 END"


@query("breadth_health_india", "breadth bench_index uptrend", f"""
WITH s AS (SELECT date, AVG(CASE WHEN trend = 'up' THEN 1 ELSE 0 END) AS ss FROM uptrend WHERE worksheet <> 'all' GROUP BY date),
a AS (SELECT b.*, i.close AS px, s.ss, COALESCE(advancers / NULLIF(CAST(decliners AS DOUBLE), 0), 3) AS ad, COALESCE(new_highs / NULLIF(CAST(new_lows AS DOUBLE), 0), CASE WHEN new_highs > 0 THEN 5 ELSE 1 END) AS hl FROM breadth b JOIN bench_index i USING (date) JOIN s USING (date)),
t AS (SELECT *, SIGN(R6(AVG(ad) OVER {tr(5, O)} - AVG(ad) OVER {tr(20, O)})) * 2 AS bonus, R6(px / LAG(px, 20) OVER ({O}) - 1) AS p, R6(pct_above_200 - LAG(pct_above_200, 20) OVER ({O})) AS q FROM a),
u AS (SELECT *, CASE WHEN p > 0.01 THEN 1 WHEN p < -0.01 THEN -1 ELSE 0 END AS u, CASE WHEN q > 0.02 THEN 1 WHEN q < -0.02 THEN -1 ELSE 0 END AS b FROM t),
z AS (SELECT date, LEAST(GREATEST({interp_sql('ad', rg.AD_KNOTS)} + bonus, 0), 25) AS ad_score, {interp_sql('(pct_above_200 * 100)', rg.ABOVE_KNOTS)} AS above_score, {interp_sql('hl', rg.HIGHS_KNOTS)} AS highs_score,
  {interp_sql('ss', rg.SECTOR_KNOTS)} AS sector_score, {ALIGN_CASE} AS align_score FROM u), y AS (SELECT *, ad_score + above_score + highs_score + sector_score + align_score AS score FROM z)
SELECT date, R4(ad_score) AS ad_score, R4(above_score) AS above_score, R4(highs_score) AS highs_score, R4(sector_score) AS sector_score, R4(align_score) AS align_score, R4(score) AS score FROM y""")
def q_five(m):
    share = series(m).filter("worksheet <> 'all'").groupBy("date").agg(F.avg((F.col("trend") == "up").cast("int")).alias("sector_share"))
    df = rg.five_part_health(br.breadth_series(m.bars), m.bench_index, share)
    return df.select("date", *[r4(c).alias(c) for c in ("ad_score", "above_score", "highs_score", "sector_score", "align_score", "score")])


# -- exposure, bubble, scorecard ------------------------------------------------------------------------
EXP = {"regime": (7, 5), "top_risk": (11, 4), "breadth": (13, 6), "uptrend": (17, 3), "institutional": (19, 2), "sector": (23, 7), "theme": (29, 8), "ftd": (31, 9)}


@query("exposure_ceiling", "", f"""
WITH i AS (SELECT c_custkey, {', '.join(f'CASE WHEN (c_custkey + c_nationkey) % {g} = 0 THEN NULL ELSE CAST((c_custkey * {k}) % 101 AS DOUBLE) END AS {n}' for n, (k, g) in EXP.items())} FROM customer),
w AS (SELECT *, {' + '.join(f'CASE WHEN {n} IS NULL THEN 0 ELSE {rg.EXPOSURE_WEIGHTS[n]} END' for n in EXP)} AS w, {' + '.join(f'COALESCE({n}, 0) * {rg.EXPOSURE_WEIGHTS[n]}' for n in EXP)} AS s,
  CAST(regime IS NULL AS INT) + CAST(top_risk IS NULL AS INT) + CAST(breadth IS NULL AS INT) AS missing_critical, {' + '.join(f'CAST({n} IS NOT NULL AS INT)' for n in EXP)} AS np FROM i),
c AS (SELECT *, R6(CASE WHEN w = 0 THEN 50 ELSE GREATEST(0, CAST(s AS DOUBLE) / CAST(w AS DOUBLE) - missing_critical * 10) END) AS c FROM w)
SELECT c_custkey, R4(c) AS composite, CAST(missing_critical AS BIGINT) AS missing_critical, CAST(FLOOR(CASE WHEN c >= 80 THEN LEAST(100, c + 10) WHEN c >= 65 THEN 70 + (c - 65) * 1.3 WHEN c >= 50 THEN 50 + (c - 50) * 1.3 WHEN c >= 35 THEN 30 + (c - 35) * 1.3
  WHEN c >= 20 THEN 10 + (c - 20) * 1.3 ELSE GREATEST(0, c / 2) END + 1e-9) AS BIGINT) AS ceiling_pct,
  CASE WHEN c < 30 OR COALESCE(top_risk < 25, FALSE) THEN 'CASH_PRIORITY' WHEN c < 50 OR COALESCE(top_risk < 40, FALSE) OR missing_critical >= 2 THEN 'REDUCE_ONLY' ELSE 'NEW_ENTRY_ALLOWED' END AS recommendation,
  CASE CAST(COALESCE(uptrend >= 50, FALSE) AS INT) + CAST(COALESCE(breadth >= 50, FALSE) AS INT) WHEN 2 THEN 'BROAD' WHEN 1 THEN 'MODERATE' ELSE 'NARROW' END AS participation,
  CASE WHEN np >= 6 AND missing_critical = 0 THEN 'HIGH' WHEN np >= 4 OR missing_critical <= 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM c""")
def q_exposure(m):
    key = F.col("c_custkey")
    inputs = m.table("customer").select("c_custkey", *[
        F.when((key + F.col("c_nationkey")) % g != 0, ((key * k) % 101).cast("double")).alias(n) for n, (k, g) in EXP.items()])
    return rg.exposure_ceiling(inputs).select("c_custkey", r4("composite").alias("composite"), "missing_critical", "ceiling_pct", "recommendation", "participation", "confidence")


@query("bubble_score", "", f"""
WITH i AS (SELECT c_custkey, {', '.join(f'(c_custkey // {i + 1}) % 3 AS {c}' for i, c in enumerate(rg.BUBBLE))} FROM customer), t AS (SELECT *, {' + '.join(rg.BUBBLE)} AS total FROM i)
SELECT c_custkey, total, R4(total * 100.0 / 16) AS percentage, CASE WHEN total <= 4 THEN 'normal' WHEN total <= 8 THEN 'caution' WHEN total <= 12 THEN 'euphoria' ELSE 'critical' END AS phase,
  CASE WHEN total <= 4 THEN 'displacement' WHEN total <= 8 THEN CASE WHEN media_saturation >= 1 AND price_acceleration >= 1 THEN 'boom' ELSE 'displacement' END
  WHEN total <= 12 THEN CASE WHEN mass_penetration >= 2 AND media_saturation >= 2 THEN 'euphoria' ELSE 'late boom' END ELSE CASE WHEN mass_penetration >= 2 THEN 'profit taking' ELSE 'euphoria' END END AS stage FROM t""")
def q_bubble(m):
    inputs = m.table("customer").select("c_custkey", *[(F.floor(F.col("c_custkey") / (i + 1)) % 3).alias(c) for i, c in enumerate(rg.BUBBLE)])
    return rg.bubble_score(inputs).select("c_custkey", "total", r4("percentage").alias("percentage"), "phase", "stage")


SC = ("sample_score", "expectancy_score", "risk_score", "robustness_score", "realism_score", "total")


@query("backtest_scorecard", "", """
WITH i AS (SELECT p_partkey, p_size * 6 AS n, 30 + p_partkey % 65 AS wr, (p_retailprice / 100) % 6 AS w, (p_partkey % 40) / 10.0 AS l, p_partkey % 70 AS dd, p_size % 14 AS y, p_partkey % 10 AS k, p_partkey % 2 = 0 AS sl FROM part),
a AS (SELECT *, CAST(wr / 100.0 * w AS DOUBLE) AS win, CAST((1 - wr / 100.0) * l AS DOUBLE) AS loss FROM i), e AS (SELECT *, R6(win - loss) AS e, win / NULLIF(loss, 0) AS pf FROM a),
s AS (SELECT *, CAST(CASE WHEN n < 30 THEN 0 WHEN n < 100 THEN 8 + FLOOR((n - 30) / 70.0 * 7 + 1e-9) WHEN n < 200 THEN 15 + FLOOR((n - 100) / 100.0 * 5 + 1e-9) ELSE 20 END AS BIGINT) AS sample_score,
  CAST(CASE WHEN e <= 0 THEN 0 WHEN e < 0.5 THEN 5 + FLOOR(e / 0.5 * 5 + 1e-9) WHEN e < 1.5 THEN 10 + FLOOR((e - 0.5) * 8 + 1e-9) ELSE 20 END AS BIGINT) AS expectancy_score,
  CAST(CASE WHEN dd >= 50 THEN 0 ELSE LEAST(20, CASE WHEN dd < 20 THEN 12 ELSE FLOOR(12.0 * (50 - dd) / 30 + 1e-9) END + CASE WHEN pf IS NULL OR pf >= 3 THEN 8 WHEN pf < 1 THEN 0 ELSE FLOOR((pf - 1) / 2 * 8 + 1e-9) END) END AS BIGINT) AS risk_score,
  CAST(LEAST(20, CASE WHEN y < 5 THEN 0 WHEN y >= 10 THEN 15 ELSE 5 + FLOOR((y - 5) / 5.0 * 10 + 1e-9) END + CASE WHEN k <= 4 THEN 5 WHEN k <= 6 THEN 3 WHEN k = 7 THEN 1 ELSE 0 END) AS BIGINT) AS robustness_score,
  CASE WHEN sl THEN 20 ELSE 0 END AS realism_score FROM e), t AS (SELECT *, sample_score + expectancy_score + risk_score + robustness_score + realism_score AS total FROM s)
SELECT p_partkey, sample_score, expectancy_score, risk_score, robustness_score, CAST(realism_score AS BIGINT) AS realism_score, CAST(total AS BIGINT) AS total, CASE WHEN total >= 70 THEN 'Deploy' WHEN total >= 40 THEN 'Refine' ELSE 'Abandon' END AS verdict,
  CONCAT_WS(',', CASE WHEN n < 30 THEN 'small_sample' END, CASE WHEN NOT sl THEN 'no_slippage_test' END, CASE WHEN dd > 50 THEN 'excessive_drawdown' END, CASE WHEN k >= 7 THEN 'over_optimized' END, CASE WHEN y < 5 THEN 'short_test_period' END,
  CASE WHEN e < 0 THEN 'negative_expectancy' END, CASE WHEN wr > 90 AND dd < 5 THEN 'too_good' END) AS red_flags FROM t""")
def q_scorecard(m):
    key, size = F.col("p_partkey"), F.col("p_size")
    results = m.table("part").select("p_partkey", (size * 6).alias("total_trades"), (F.lit(30) + key % 65).alias("win_rate"), ((F.col("p_retailprice") / 100) % 6).alias("avg_win_pct"),
                                     ((key % 40) / 10).alias("avg_loss_pct"), (key % 70).alias("max_drawdown_pct"), (size % 14).alias("years_tested"), (key % 10).alias("num_parameters"), (key % 2 == 0).alias("slippage_tested"))
    return scorecard(results).select("p_partkey", *SC, "verdict", F.array_join("red_flags", ",").alias("red_flags"))


# -- macro ---------------------------------------------------------------------------------------------
LEGS = {"concentration": ("AFRICA", "MARKET"), "credit_conditions": ("AMERICA", "ASIA"), "size_factor": ("EUROPE", "MARKET"), "equity_bond": ("MARKET", "MIDDLE EAST"), "sector_rotation": ("AMERICA", "EUROPE")}
add_view("macro_m", "sector_idx bench_monthly", "SELECT sector AS name, CAST(DATE_TRUNC('month', date) AS DATE) AS month, ARG_MAX(close, date) AS close FROM sector_idx GROUP BY 1, 2 UNION ALL SELECT 'MARKET', month, close FROM bench_monthly")
add_view("macro_r", "macro_m rates", " UNION ALL ".join(
    f"SELECT '{k}' AS symbol, a.month, R6(a.close / b.close) AS ratio FROM macro_m a JOIN macro_m b USING (month) WHERE a.name = '{x}' AND b.name = '{y}'" for k, (x, y) in LEGS.items())
    + " UNION ALL SELECT 'yield_curve', CAST(DATE_TRUNC('month', date) AS DATE), R6(ARG_MAX(year10 - year2, date)) FROM rates GROUP BY 2")


def macro_ratios(m: Market):
    """Six monthly series: five index ratios and the yield spread."""
    index = sec.sector_index(m.bars, m.constituents).groupBy(F.col("sector").alias("name"), F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("close"))
    level = index.unionByName(bench_monthly(m).withColumn("name", F.lit("MARKET")))
    wide = level.groupBy("month").pivot("name", ["MARKET", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.first("close"))
    legs = F.array(*[F.struct(F.lit(k).alias("symbol"), r6(F.col(f"`{a}`") / F.col(f"`{b}`")).alias("ratio")) for k, (a, b) in LEGS.items()])
    curve = m.rates.groupBy(F.trunc("date", "MM").alias("month")).agg(r6(F.max_by(F.col("year10") - F.col("year2"), "date")).alias("ratio"))
    return wide.select("month", F.inline(legs)).filter("ratio IS NOT NULL").unionByName(curve.withColumn("symbol", F.lit("yield_curve")))


def equity_bond_corr(m: Market):
    """Correlation of market and bond-leg monthly returns over the last 6 and 12 months."""
    bond = sec.sector_index(m.bars, m.constituents).filter("sector = 'MIDDLE EAST'").groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("bond"))
    w = Window.orderBy("month")  # one row per month
    df = bench_monthly(m).join(bond, "month").withColumn("k", F.lit("x"))
    df = df.withColumn("a", F.col("close") / F.lag("close").over(w) - 1).withColumn("b", F.col("bond") / F.lag("bond").over(w) - 1)
    df = df.withColumn("c6", rel.rolling_corr("a", "b", 6, "k")).withColumn("c12", rel.rolling_corr("a", "b", 12, "k"))
    return df.agg(F.max_by(F.struct(r6("c6").alias("c6"), r6("c12").alias("c12")), "month").alias("c"))


MB = "PARTITION BY symbol ORDER BY month"
add_view("macro_corr", "macro_m", """
WITH j AS (SELECT a.month, a.close / LAG(a.close) OVER (ORDER BY a.month) - 1 AS a, b.close / LAG(b.close) OVER (ORDER BY a.month) - 1 AS b FROM macro_m a JOIN macro_m b USING (month) WHERE a.name = 'MARKET' AND b.name = 'MIDDLE EAST'),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY month DESC) AS k FROM j) SELECT R6(CORR(a, b) FILTER (k <= 6)) AS c6, R6(CORR(a, b) FILTER (k <= 12)) AS c12 FROM k""")
DIR_CASE = "CASE symbol " + " ".join(f"WHEN '{k}' THEN CASE way WHEN 1 THEN '{v[0]}' WHEN -1 THEN '{v[1]}' ELSE '{v[2]}' END" for k, v in rg.DIRECTIONS.items()) + " END"
add_view("macro_c", "macro_r macro_corr", f"""
WITH a AS (SELECT symbol, month, ratio, {avg('ratio', 6, by=MB)} AS s, {avg('ratio', 12, by=MB)} AS l, (ratio - LAG(ratio, 3) OVER ({MB})) / NULLIF(LAG(ratio, 3) OVER ({MB}), 0) * 100 AS r3, (ratio - LAG(ratio, 12) OVER ({MB})) / NULLIF(LAG(ratio, 12) OVER ({MB}), 0) * 100 AS r12 FROM macro_r),
b AS (SELECT *, LAG(s) OVER ({MB}) AS ps, LAG(l) OVER ({MB}) AS pl, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY month DESC) - 1 AS ago FROM a),
c AS (SELECT *, CASE WHEN ps <= pl AND s > l THEN 'golden_cross' WHEN ps >= pl AND s < l THEN 'death_cross' END AS kind FROM b),
d AS (SELECT symbol, COUNT(*) AS n, ARG_MIN(s, ago) AS s6, ARG_MIN(l, ago) AS s12, MAX(r3) FILTER (ago = 0) AS r3, MAX(r12) FILTER (ago = 0) AS r12, ARG_MIN(ratio, ago) AS cur, ARG_MIN(kind, ago) FILTER (kind IS NOT NULL AND ago < 12) AS kind, MIN(ago) FILTER (kind IS NOT NULL AND ago < 12) AS ba FROM c GROUP BY symbol),
e AS (SELECT *, (s6 - s12) / NULLIF(s12, 0) * 100 AS gap FROM d), f AS (SELECT *, CASE WHEN n < 15 THEN 'none' WHEN kind IS NOT NULL THEN kind WHEN ABS(gap) < 1 THEN 'converging' ELSE 'none' END AS type FROM e),
p AS (SELECT symbol, COUNT(*) FILTER (ratio < cur) * 100.0 / COUNT(*) AS percentile FROM macro_r JOIN (SELECT symbol, cur FROM d) USING (symbol) GROUP BY symbol),
s AS (SELECT f.*, percentile, CASE WHEN type IN ('golden_cross', 'death_cross') THEN CASE WHEN ba <= 2 THEN 40 WHEN ba <= 5 THEN 30 ELSE 20 END WHEN type = 'converging' THEN FLOOR(GREATEST(0, 1 - ABS(gap)) * 25) ELSE 0 END
  + CASE WHEN r3 IS NULL OR r12 IS NULL THEN 0 WHEN (r12 < 0 AND r3 > 0) OR (r12 > 0 AND r3 < 0) THEN FLOOR(LEAST(ABS(r3), 5) / 5 * 30) WHEN ABS(r3) > 3 THEN 10 ELSE 0 END
  + 10 * (CAST(type IN ('golden_cross', 'death_cross') AS INT) + CAST(COALESCE((type = 'golden_cross' AND r3 > 0) OR (type = 'death_cross' AND r3 < 0), FALSE) AS INT) + CAST(COALESCE(ABS(s6 - s12) / s12 * 100 > 0.5, FALSE) AS INT)) AS base,
  CASE type WHEN 'golden_cross' THEN 1 WHEN 'death_cross' THEN -1 END AS cr, CASE WHEN r3 > 0 THEN 1 WHEN r3 < 0 THEN -1 END AS mv FROM f JOIN p USING (symbol)),
w AS (SELECT *, LEAST(LEAST(GREATEST(base, 0), 100) + CASE WHEN symbol = 'equity_bond' THEN (SELECT CASE WHEN c6 IS NULL OR c12 IS NULL THEN 0 WHEN (c6 > 0) <> (c12 > 0) THEN 20 WHEN ABS(c6 - c12) > 0.3 THEN 10 ELSE 0 END FROM macro_corr) ELSE 0 END, 100) AS score,
  CASE WHEN cr IS NOT NULL THEN CASE WHEN COALESCE(ba >= 3, FALSE) AND COALESCE(mv <> cr, FALSE) THEN mv ELSE cr END WHEN symbol = 'concentration' THEN CASE WHEN s6 > s12 THEN 1 ELSE -1 END ELSE mv END AS way FROM s)
SELECT *, {DIR_CASE} AS direction, CASE WHEN cr IS NULL OR mv IS NULL THEN 'N/A' WHEN mv = cr THEN 'confirmed' WHEN COALESCE(ba >= 3, FALSE) THEN 'reversing' ELSE 'fading' END AS qualifier FROM w""")


def macro(m: Market):
    ratios = cut_lineage(macro_ratios(m))
    corr = cut_lineage(equity_bond_corr(m))
    six, twelve = corr.select("c.c6").scalar(), corr.select("c.c12").scalar()
    return rg.macro_components(ratios, rel.crossover(ratios, "ratio"), rg.correlation_bonus(six, twelve)), six


@query("macro_components", "macro_c", "SELECT symbol AS component, type, direction, qualifier, CAST(score AS DOUBLE) AS score, R4(r3) AS roc_3m, R4(r12) AS roc_12m, R4(percentile) AS percentile FROM macro_c")
def q_macro(m):
    df, _ = macro(m)
    return df.select(F.col("symbol").alias("component"), "type", "direction", "qualifier", "score", *[r4(c).alias(c) for c in ("roc_3m", "roc_12m", "percentile")])


@query("macro_regime", "macro_c macro_corr", """
WITH d AS (SELECT MAX(direction) FILTER (symbol = 'concentration') AS co, MAX(direction) FILTER (symbol = 'yield_curve') AS yc, MAX(direction) FILTER (symbol = 'credit_conditions') AS cc, MAX(direction) FILTER (symbol = 'size_factor') AS sf,
  MAX(direction) FILTER (symbol = 'equity_bond') AS eb, MAX(direction) FILTER (symbol = 'sector_rotation') AS sr, COUNT(*) FILTER (score >= 40) AS signaling, SUM(score) / 6 AS avg_score,
  SUM(score * CASE symbol WHEN 'concentration' THEN 0.25 WHEN 'yield_curve' THEN 0.2 WHEN 'sector_rotation' THEN 0.1 ELSE 0.15 END) AS composite FROM macro_c),
c AS (SELECT d.*, CASE WHEN c6 IS NULL THEN 'unknown' WHEN c6 < -0.3 THEN 'negative_strong' WHEN c6 < 0 THEN 'negative_mild' WHEN c6 < 0.3 THEN 'near_zero' ELSE 'positive' END AS corr_regime FROM d, macro_corr),
s AS (SELECT *, CAST((co = 'concentrating') AS INT) * 2 + CAST((sf = 'large_cap_leading') AS INT) * 2 + CAST((cc IN ('stable', 'easing')) AS INT) AS s0,
  CAST((co = 'broadening') AS INT) * 2 + CAST((sf = 'small_cap_leading') AS INT) * 2 + CAST((cc IN ('stable', 'easing')) AS INT) + CAST((sr = 'risk_on') AS INT) + CAST((yc = 'steepening') AS INT) AS s1,
  GREATEST(0, CAST((cc = 'tightening') AS INT) * 2 + CAST((sr = 'risk_off') AS INT) * 2 + CAST((eb = 'risk_off') AS INT) + CAST((yc = 'flattening') AS INT) - CAST((sf = 'small_cap_leading') AS INT)) AS s2,
  CASE corr_regime WHEN 'positive' THEN 3 WHEN 'near_zero' THEN 1 ELSE 0 END + CAST((eb = 'risk_off') AS INT) AS s3 FROM c),
r AS (SELECT *, GREATEST(s0, s1, s2, s3) AS best, LIST_REVERSE_SORT([s0, s1, s2, s3])[2] AS second FROM s),
t AS (SELECT *, best > 0 AND best - second <= 1 AS tied FROM r), u AS (SELECT *, NOT (tied AND composite < 50) AND signaling >= 3 AND best < 3 AS moved FROM t),
v AS (SELECT *, CASE WHEN (tied AND composite < 50) OR moved THEN 'transitional' WHEN s0 = best THEN 'concentration' WHEN s1 = best THEN 'broadening' WHEN s2 = best THEN 'contraction' ELSE 'inflationary' END AS regime, CASE WHEN moved THEN signaling ELSE best END AS st FROM u)
SELECT regime, corr_regime, CAST(s0 AS BIGINT) AS concentration_score, CAST(s1 AS BIGINT) AS broadening_score, CAST(s2 AS BIGINT) AS contraction_score, CAST(s3 AS BIGINT) AS inflationary_score, signaling, R4(composite) AS composite,
  CASE WHEN st >= 4 THEN CASE WHEN tied THEN 'moderate' ELSE 'high' END WHEN st >= 3 THEN 'moderate' WHEN st >= 2 THEN 'low' ELSE 'very_low' END AS confidence,
  CASE WHEN signaling >= 4 AND avg_score >= 50 THEN 'high' WHEN signaling >= 3 AND avg_score >= 40 THEN 'moderate' WHEN signaling >= 2 AND avg_score >= 30 THEN 'low' ELSE 'minimal' END AS transition_probability, best > 0 AND second >= best - 1 AS ambiguous FROM v""")
def q_macro_regime(m):
    df, corr = macro(m)
    return rg.macro_regime(df, corr).select("regime", "corr_regime", *[f"{k}_score" for k in ("concentration", "broadening", "contraction", "inflationary")], "signaling",
                                            r4("composite").alias("composite"), "confidence", "transition_probability", "ambiguous")


# -- screens ---------------------------------------------------------------------------------------------
VW = (120, 60, 30, 15)
add_view("vcp_in", "bars template rs_excess", f"""
SELECT b.symbol, b.date, b.close, R4(t.trend_score) AS trend_score, t.stage, R4(x.rs_value) AS rs_value, R6(b.dry) AS dry, {', '.join(f'b.h{n}, R6((b.h{n} - b.l{n}) / b.h{n} * 100) AS d{n}' for n in VW)} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, COUNT(*) OVER (PARTITION BY symbol) AS n, {avg('volume', 10)} / {avg('volume', 50)} AS dry, {', '.join(f'MAX(high) OVER {tr(n)} AS h{n}, MIN(low) OVER {tr(n)} AS l{n}' for n in VW)} FROM bars) b
  JOIN template t ON t.symbol = b.symbol AND t.date = b.date JOIN rs_excess x ON x.symbol = b.symbol AND x.date = b.date WHERE k = 1 AND n >= 200""")


@query("vcp_screen", "vcp_in", """
WITH g AS (SELECT *, (d60 / d120 + d30 / d60 + d15 / d30) / 3 AS mr, (h15 - close) / h15 * 100 AS pd FROM vcp_in WHERE trend_score >= 0 AND d120 BETWEEN 1 AND 90 AND d60 / d120 <= 1 AND d30 / d60 <= 1 AND d15 / d30 <= 1),
s AS (SELECT *, LEAST(GREATEST(85 + CASE WHEN mr < 0.6 THEN 10 WHEN mr < 0.7 THEN 5 ELSE 0 END + CASE WHEN d15 < 5 THEN 10 WHEN d15 < 8 THEN 5 ELSE 0 END + CASE WHEN d120 BETWEEN 15 AND 30 THEN 5 ELSE 0 END, 0), 100) AS cs,
  CASE WHEN dry < 0.4 THEN 90 WHEN dry < 0.5 THEN 80 WHEN dry < 0.6 THEN 70 WHEN dry < 0.7 THEN 60 WHEN dry < 0.8 THEN 45 WHEN dry < 0.9 THEN 30 ELSE 15 END AS vs,
  CASE WHEN pd < 0 THEN 50 WHEN pd <= 3 THEN 90 WHEN pd <= 5 THEN 75 WHEN pd <= 8 THEN 60 WHEN pd <= 12 THEN 45 WHEN pd <= 20 THEN 30 ELSE 15 END AS ps,
  CASE WHEN rs_value > 50 THEN 95 WHEN rs_value > 30 THEN 80 WHEN rs_value > 15 THEN 65 WHEN rs_value > 5 THEN 50 WHEN rs_value > 0 THEN 35 ELSE 15 END AS rs FROM g),
c AS (SELECT *, trend_score * 0.25 + cs * 0.25 + vs * 0.2 + ps * 0.15 + rs * 0.15 AS composite FROM s)
SELECT symbol, close, CAST(stage AS BIGINT) AS stage, trend_score, CAST(cs AS DOUBLE) AS contraction_score, CAST(ps AS DOUBLE) AS pivot_score, h15 AS pivot, R4(composite) AS composite,
  CASE WHEN composite >= 80 THEN 'Excellent' WHEN composite >= 65 THEN 'Good' WHEN composite >= 50 THEN 'Fair' ELSE 'Poor' END AS quality FROM c""")
def q_vcp(m):
    """The gates are widened so that the small-range price walk of the tables passes them."""
    df = ind.with_trend_template(m.bars.select("*", *ind.nested_range(VW)).withColumn("dry_up_ratio", ind.volume_dryup()).withColumn("n", ind.bar_number()))
    df = ind.weighted_excess(df, m.bench_index)
    for n in VW:
        df = df.withColumn(f"depth_{n}", r6(f"depth_{n}"))
    df = df.withColumn("trend_score", r4("trend_score")).withColumn("rs_value", r4("rs_value")).withColumn("dry_up_ratio", r6("dry_up_ratio"))
    cols = ["close", "stage", "trend_score", "rs_value", "dry_up_ratio", "n", *[f"high_{n}" for n in VW], *[f"depth_{n}" for n in VW]]
    last = df.groupBy("symbol").agg(F.max_by(F.struct(*cols), "date").alias("r")).select("symbol", "r.*").filter("n >= 200")
    last = last.withColumn("volume_score", ind.dry_up_score("dry_up_ratio")).withColumn("rs_score", ind.rs_score("rs_value"))
    out = rg.vcp_screen(last, VW, 0.0, (1.0, 90.0), 1.0)
    return out.select("symbol", "close", F.col("stage").cast("bigint"), "trend_score", "contraction_score", "pivot_score", "pivot", r4("composite").alias("composite"), "quality")


@query("sector_deep_dive", "cmetrics constituents sector_window bench_index edges", """
WITH r AS (SELECT sector, symbol, cagr / NULLIF(ABS(max_drawdown), 0) AS calmar, ret_window FROM cmetrics JOIN constituents USING (symbol)),
b AS (SELECT ARG_MAX(close, date) / ARG_MIN(close, date) - 1 AS bench_return FROM bench_index)
SELECT r.sector, r.symbol, R4(calmar) AS calmar, R6(ret_window) AS ret_window, R6(ret_window - w.sector_return) AS excess, R6(w.sector_return - b.bench_return) AS sector_over_bench, R6(e.corr0) AS corr0, e.verdict,
  ROW_NUMBER() OVER (PARTITION BY r.sector ORDER BY R6(calmar) DESC NULLS LAST, r.symbol) AS rank FROM r JOIN sector_window w USING (sector) JOIN edges e ON e.src = r.symbol AND e.dst = r.sector, b""")
def q_deep_dive(m):
    """Ranking, excess return, relative strength and validated causes, per sector."""
    from bourselake.plans.graph import edges
    index = sec.sector_index(m.bars, m.constituents)
    bench = m.bench_index.agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("b")).scalar()
    df = sec.constituent_metrics(m.bars).join(m.constituents, "symbol").withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown")))
    df = sec.ranked(df, F.desc_nulls_last(r6("calmar")), "symbol", part=["sector"])
    df = df.join(sec.window_return(index, "sector", "sector_return"), "sector").withColumn("bench_return", bench)
    cause = edges(m).filter("kind = 'stock'").select(F.col("src").alias("symbol"), F.col("dst").alias("sector"), "corr0", "verdict")
    return df.join(cause, ["symbol", "sector"]).select(
        "sector", "symbol", r4("calmar").alias("calmar"), r6("ret_window").alias("ret_window"), r6(F.col("ret_window") - F.col("sector_return")).alias("excess"),
        r6(F.col("sector_return") - F.col("bench_return")).alias("sector_over_bench"), r6("corr0").alias("corr0"), "verdict", "rank")
