"""Joins, aggregations, co-movement and ranked summaries on the market tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourselake.functions import bool_int, lagged, r2, r4, r6, safe_div, yes
from bourselake.operators import breadth, flows, indicators as ind, pairs, relations as rel, risk
from bourselake.operators import sectors as sec
from bourselake.plans.registry import query
from bourselake.plans.views import BY, add_view, agg, avg, lag, run, std, tr
from bourselake.sources.normalize import resample_monthly

TARGET = "2000-12-29"

add_view("flags", "bars", f"""SELECT symbol, date, close, COALESCE(close > {avg('close', 50)}, FALSE) AS a50,
  COALESCE(close > {avg('close', 200)}, FALSE) AS a200, COALESCE(close > {lag('close')}, FALSE) AS adv,
  COALESCE(close < {lag('close')}, FALSE) AS dec,
  COUNT(close) OVER {tr(252)} >= 20 AND close >= MAX(close) OVER {tr(252)} AS hi,
  COUNT(close) OVER {tr(252)} >= 20 AND close <= MIN(close) OVER {tr(252)} AS lo FROM bars""")
BREADTH = """COUNT(*) AS n, COUNT(*) FILTER (a50) / CAST(COUNT(*) AS DOUBLE) AS pct_above_50,
  COUNT(*) FILTER (a200) / CAST(COUNT(*) AS DOUBLE) AS pct_above_200, COUNT(*) FILTER (adv) AS advancers,
  COUNT(*) FILTER (dec) AS decliners, COUNT(*) FILTER (hi) AS new_highs, COUNT(*) FILTER (lo) AS new_lows"""
add_view("breadth", "flags", f"""SELECT *, CAST(SUM(advancers - decliners) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ad_line
  FROM (SELECT date, {BREADTH} FROM flags GROUP BY date)""")
BREADTH_OUT = """date, n, R6(pct_above_50) AS pct_above_50, R6(pct_above_200) AS pct_above_200, advancers, decliners,
  new_highs, new_lows, ad_line"""


def breadth_out(df, *keys):
    return df.select(*keys, "date", "n", r6("pct_above_50").alias("pct_above_50"),
                     r6("pct_above_200").alias("pct_above_200"), "advancers", "decliners",
                     "new_highs", "new_lows", "ad_line")


@query("breadth_series", "breadth", f"SELECT {BREADTH_OUT} FROM breadth")
def q_breadth(m):
    return breadth_out(breadth.breadth_series(m.bars))


add_view("sector_daily", "flags constituents", f"""SELECT *, CAST(SUM(advancers - decliners) OVER (PARTITION BY sector ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ad_line FROM (
  SELECT sector, date, {BREADTH} FROM flags JOIN constituents USING (symbol) GROUP BY ALL UNION ALL
  SELECT 'MARKET', date, {BREADTH} FROM flags WHERE symbol IN (SELECT symbol FROM constituents) GROUP BY ALL)""")


@query("sector_breadth", "sector_daily", f"SELECT sector, {BREADTH_OUT} FROM sector_daily")
def q_sector_breadth(m):
    return breadth_out(breadth.sector_breadth(m.bars, m.constituents), "sector")


@query("regime_breadth_daily", "features", """SELECT date, R6(AVG(CAST(close > ma50 AS INT))) AS pct_above_ma50,
  R6(AVG(CAST(close > ma200 AS INT))) AS pct_above_ma200, R6(AVG(ret_1d)) AS avg_ret FROM features
  WHERE ma50 IS NOT NULL AND ma200 IS NOT NULL GROUP BY date""")
def q_regime_breadth(m):
    from bourselake.operators.scanners import regime_breadth
    df = regime_breadth(ind.feature_panel(m.bars))
    return df.select("date", *[r6(c).alias(c) for c in ("pct_above_ma50", "pct_above_ma200", "avg_ret")])


@query("bars_x_sector", "bars constituents", """SELECT sector, date, COUNT(*) AS n, R4(AVG(close)) AS mean_close, SUM(volume) AS volume
  FROM bars JOIN constituents USING (symbol) GROUP BY sector, date""")
def q_bars_sector(m):
    return m.bars.join(m.constituents, "symbol").groupBy("sector", "date").agg(
        F.count("*").alias("n"), r4(F.avg("close")).alias("mean_close"), F.sum("volume").alias("volume"))


add_view("sector_idx", "bars constituents", f"""SELECT sector, date, 100 * EXP(SUM(lr) OVER (PARTITION BY sector ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM (SELECT sector, date, AVG(lr) AS lr FROM (
  SELECT symbol, date, LN(close / {lag('close')}) AS lr FROM bars) JOIN constituents USING (symbol) WHERE lr IS NOT NULL GROUP BY 1, 2)""")


@query("rel_strength", "sector_idx bench_index", """
WITH j AS (SELECT s.sector, s.date, s.close, b.close AS bench FROM sector_idx s JOIN bench_index b USING (date)),
n AS (SELECT sector, date, close / FIRST_VALUE(close) OVER (PARTITION BY sector ORDER BY date) * 100 AS sn,
  bench / FIRST_VALUE(bench) OVER (PARTITION BY sector ORDER BY date) * 100 AS bn FROM j)
SELECT sector, date, R4(sn) AS sector_norm, R4(bn) AS bench_norm, R4(sn / bn * 100) AS rel, R4(sn / bn * 100 - 100) AS change_pct FROM n""")
def q_rel_strength(m):
    df = sec.relative_strength(sec.sector_index(m.bars, m.constituents), m.bench_index)
    return df.select("sector", "date", r4("sector_norm").alias("sector_norm"), r4("bench_norm").alias("bench_norm"),
                     r4("rel").alias("rel"), r4(F.col("rel") - 100).alias("change_pct"))


add_view("stock_window", "bars", "SELECT symbol, ARG_MAX(close, date) / ARG_MIN(close, date) - 1 AS ret_window FROM bars GROUP BY symbol")
add_view("sector_window", "sector_idx", "SELECT sector, ARG_MAX(close, date) / ARG_MIN(close, date) - 1 AS sector_return FROM sector_idx GROUP BY sector")


@query("excess_return", "stock_window sector_window constituents", """SELECT symbol, sector, R6(ret_window) AS ret_window,
  R6(sector_return) AS sector_return, R6(ret_window - sector_return) AS excess FROM stock_window JOIN constituents USING (symbol) JOIN sector_window USING (sector)""")
def q_excess(m):
    index = sec.sector_index(m.bars, m.constituents)
    df = (sec.window_return(m.bars, "symbol", "ret_window").join(m.constituents, "symbol")
          .join(sec.window_return(index, "sector", "sector_return"), "sector"))
    return df.select("symbol", "sector", r6("ret_window").alias("ret_window"),
                     r6("sector_return").alias("sector_return"),
                     r6(F.col("ret_window") - F.col("sector_return")).alias("excess"))


add_view("bench_monthly", "bench_index", """SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month, ARG_MAX(close, date) AS close FROM bench_index GROUP BY 1""")


def bench_monthly(m):
    return m.bench_index.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.max_by("close", "date").alias("close"))


@query("ratio_monthly", "monthly bench_monthly", """SELECT m.symbol, m.month, R6(m.close / b.close) AS ratio FROM monthly m
  JOIN bench_monthly b USING (month) WHERE b.close <> 0""")
def q_ratio(m):
    df = sec.monthly_ratio(resample_monthly(m.bars), bench_monthly(m))
    return df.select("symbol", "month", r6("ratio").alias("ratio"))


add_view("pair_ret", "ret", """SELECT a.symbol AS a, b.symbol AS b, COUNT(*) AS n, CORR(a.ret_1d, b.ret_1d) AS corr,
  COVAR_SAMP(a.ret_1d, b.ret_1d) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol
  WHERE a.ret_1d IS NOT NULL AND b.ret_1d IS NOT NULL GROUP BY 1, 2""")


def returns(m):
    return m.bars.select("symbol", "date", ind.change("close").alias("ret_1d"))


@query("pair_self_join", "pair_ret", "SELECT a, b, n, R6(corr) AS corr FROM pair_ret WHERE a < b")
def q_pairs(m):
    df = pairs.with_correlation(pairs.pair_moments(returns(m), "ret_1d"))
    return df.select("a", "b", "n", r6("corr").alias("corr"))


@query("undelivered_anti", "bars constituents", """SELECT c.sector, c.symbol FROM constituents c LEFT JOIN (
  SELECT DISTINCT symbol FROM bars WHERE close > 130) b USING (symbol) WHERE b.symbol IS NULL""")
def q_undelivered(m):
    delivered = m.bars.filter("close > 130").select("symbol").distinct()
    return m.constituents.join(delivered, "symbol", "left_anti").select("sector", "symbol")


@query("policy_events_join", "bars", """
WITH e AS (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n_events FROM orders WHERE o_orderpriority = '1-URGENT'
  AND o_orderdate >= '1998-01-01' AND o_orderdate < '2000-01-01' GROUP BY 1)
SELECT b.symbol, b.date, b.close, e.n_events FROM bars b JOIN e USING (date)""")
def q_events(m):
    day = F.to_date("o_orderdate")
    events = (m.table("orders").filter((F.col("o_orderpriority") == "1-URGENT")
                                       & day.between("1998-01-01", "1999-12-31"))
              .groupBy(day.alias("date")).agg(F.count("*").alias("n_events")))
    return m.bars.select("symbol", "date", "close").join(events, "date")


add_view("cmetrics", "bars absorbed", f"""
SELECT symbol, n_bars, z.close AS last, z.m50 AS ma50, z.m200 AS ma200, COALESCE(z.close > z.m50 AND z.m50 > z.m200, FALSE) AS uptrend,
  z.r20 AS ret_20d, z.close / a - 1 AS ret_window, POW(z.close / a, 252.0 / n_bars) - 1 AS cagr, mdd AS max_drawdown, dl AS avg_delivery_pct,
  z.dev AS dist_25dma, (z.dev - dm) / NULLIF(ds, 0) AS dist_25dma_z, z.vr AS vol_ratio, z.delivery_pct AS delivery_recent, z.absorption AS absorption
FROM (SELECT symbol, COUNT(*) AS n_bars, ARG_MAX(STRUCT_PACK(close := close, m50 := m50, m200 := m200, r20 := r20, dev := dev, vr := vr,
    delivery_pct := delivery_pct, absorption := absorption), date) AS z,
  ARG_MIN(close, date) AS a, MIN(dd) AS mdd, AVG(delivery_pct) AS dl, AVG(dev) AS dm, STDDEV_SAMP(dev) AS ds FROM (
    SELECT symbol, date, close, delivery_pct, absorption, {avg('close', 50)} AS m50, {avg('close', 200)} AS m200, close / {lag('close', 20)} - 1 AS r20,
      close / MAX(close) OVER {run()} - 1 AS dd, volume / MEDIAN(volume) OVER {tr(20)} AS vr,
      (close - {avg('close', 25)}) / {avg('close', 25)} AS dev FROM absorbed) GROUP BY symbol) WHERE n_bars >= 200""")
CM = ("last", "ma50", "ma200", "ret_20d", "ret_window", "cagr", "max_drawdown", "avg_delivery_pct", "dist_25dma",
      "dist_25dma_z", "vol_ratio", "delivery_recent", "absorption")


@query("constituent_metrics", "cmetrics", "SELECT symbol, n_bars, uptrend, "
       + ", ".join(f"R6({c}) AS {c}" for c in CM) + " FROM cmetrics")
def q_cmetrics(m):
    df = sec.constituent_metrics(m.bars)
    return df.select("symbol", "n_bars", "uptrend", *[r6(c).alias(c) for c in CM])


add_view("sector_agg", "cmetrics constituents", """SELECT sector, COALESCE(AVG(CAST(uptrend AS INT)), 0) AS ratio, AVG(ret_20d) AS momentum_20d,
  COUNT(uptrend) AS n FROM constituents LEFT JOIN cmetrics USING (symbol) GROUP BY sector""")


@query("sector_aggregate", "sector_agg", """SELECT sector, R6(ratio) AS ratio, R6(momentum_20d) AS momentum_20d, n,
  CASE WHEN ratio >= 0.5 THEN 'up' ELSE 'down' END AS trend,
  CASE WHEN ratio > 0.8 THEN 'overbought' WHEN ratio < 0.2 THEN 'oversold' ELSE 'neutral' END AS status FROM sector_agg""")
def q_sector_agg(m):
    df = sec.sector_aggregate(sec.constituent_metrics(m.bars), m.constituents)
    return df.select("sector", r6("ratio").alias("ratio"), r6("momentum_20d").alias("momentum_20d"), "n", "trend", "status")


@query("calmar_rank", "cmetrics", """SELECT symbol, R4(cagr / NULLIF(ABS(max_drawdown), 0)) AS calmar,
  ROW_NUMBER() OVER (ORDER BY R6(cagr / NULLIF(ABS(max_drawdown), 0)) DESC NULLS LAST, symbol) AS rank FROM cmetrics""")
def q_calmar(m):
    df = sec.constituent_metrics(m.bars).withColumn("calmar", safe_div("cagr", F.abs("max_drawdown")))
    return sec.ranked(df, F.desc_nulls_last(r6("calmar")), "symbol").select("symbol", r4("calmar").alias("calmar"), "rank")


@query("sector_rank", "sector_agg", """SELECT sector, R6(ratio) AS ratio, ROW_NUMBER() OVER (ORDER BY R6(ratio) DESC, sector) AS rank FROM sector_agg""")
def q_sector_rank(m):
    df = sec.sector_aggregate(sec.constituent_metrics(m.bars), m.constituents).withColumn("ratio", r6("ratio"))
    return sec.ranked(df, F.desc("ratio"), "sector").select("sector", "ratio", "rank")


add_view("season", "monthly", """SELECT symbol, MONTH(month) AS month_num, AVG(r) AS mean_ret, COUNT(r) AS sample_count,
  AVG(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS win_rate FROM (SELECT symbol, month, close / LAG(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM monthly)
  GROUP BY 1, 2""")


@query("seasonality", "season", """SELECT symbol, CAST(month_num AS BIGINT) AS month_num, R6(mean_ret) AS mean_ret, sample_count, R6(win_rate) AS win_rate,
  COALESCE(sample_count >= 6 AND mean_ret >= 0.025 AND win_rate >= 0.6, FALSE) AS selected FROM season""")
def q_season(m):
    df = sec.seasonality(resample_monthly(m.bars))
    return df.select("symbol", F.col("month_num").cast("bigint"), r6("mean_ret").alias("mean_ret"),
                     "sample_count", r6("win_rate").alias("win_rate"), "selected")


@query("dislocation_breadth", "devz25", """SELECT date, R6(COALESCE(COUNT(*) FILTER (dev_z < -1.5) / NULLIF(CAST(COUNT(dev_z) AS DOUBLE), 0), 0)) AS dislocation
  FROM devz25 GROUP BY date""")
def q_dislocation(m):
    df = sec.dislocation_breadth(ind.deviation_z()(m.bars), -1.5)
    return df.select("date", r6("dislocation").alias("dislocation"))


add_view("cal", "bars", "SELECT date, ROW_NUMBER() OVER (ORDER BY date DESC) AS ago FROM (SELECT DISTINCT date FROM bars)")


@query("avg_pair_corr", "ret cal", """
WITH r AS (SELECT ret.symbol, ret.date, ret_1d FROM ret JOIN cal ON ret.date = cal.date AND ago <= 20 WHERE ret_1d IS NOT NULL),
p AS (SELECT CASE WHEN COUNT(*) >= 5 THEN CORR(a.ret_1d, b.ret_1d) END AS c FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol)
SELECT R6(AVG(c)) AS avg_pair_corr, COUNT(c) AS n_pairs FROM p WHERE c IS NOT NULL AND NOT ISNAN(c)""")
def q_avg_corr(m):
    latest = m.bars.agg(F.max("date")).scalar()
    recent = returns(m).join(pairs.last_dates(m.bars, 20, latest), "date")
    df = pairs.average_pair_correlation(recent)
    return df.select(r6("avg_pair_corr").alias("avg_pair_corr"), "n_pairs")


add_view("market_vol", "ret cal", """
WITH d AS (SELECT ret.date, ago, AVG(ret_1d) AS mkt, MAX(CASE WHEN symbol = 'Brand#1' THEN ret_1d END) AS bench FROM ret JOIN cal USING (date)
  WHERE ret_1d IS NOT NULL AND ago <= 60 GROUP BY ALL),
o AS (SELECT COUNT(*) AS n, CASE WHEN COUNT(bench) FILTER (ago <= 20) >= 10 THEN STDDEV_POP(bench) FILTER (ago <= 20) END * SQRT(252) AS b20,
  CASE WHEN COUNT(bench) >= 20 THEN STDDEV_POP(bench) END * SQRT(252) AS b60,
  STDDEV_POP(mkt) FILTER (k <= 20) * SQRT(252) AS m20, STDDEV_POP(mkt) * SQRT(252) AS m60 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC) AS k FROM d))
SELECT CASE WHEN u THEN m20 ELSE b20 END AS rv20, CASE WHEN u THEN m60 ELSE b60 END AS rv60 FROM (SELECT *, (b20 IS NULL OR b60 IS NULL OR b60 = 0) AND n >= 20 AS u FROM o)""")


@query("realized_vol", "market_vol", "SELECT R6(rv20) AS rv20, R6(rv60) AS rv60, R6(rv20 / NULLIF(rv60, 0)) AS vol_trend FROM market_vol")
def q_vol(m):
    latest = m.bars.agg(F.max("date")).scalar()
    df = sec.realized_vol(returns(m), pairs.last_dates(m.bars, 60, latest), "Brand#1")
    return df.select(*[r6(c).alias(c) for c in ("rv20", "rv60", "vol_trend")])


D = "ORDER BY date"
add_view("netflow", "flows", """SELECT date, SUM(CASE WHEN category = 'FII' THEN (buy_value - sell_value) / 100 ELSE 0 END) AS fii,
  SUM(CASE WHEN category = 'DII' THEN (buy_value - sell_value) / 100 ELSE 0 END) AS dii FROM flows GROUP BY date""")
add_view("flow_tot", "netflow", "SELECT date, fii, dii, " + ", ".join(
    f"SUM({s}) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS {s}_10d, "
    f"SUM({s}) OVER (PARTITION BY DATE_TRUNC('month', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}_mtd, "
    f"SUM({s}) OVER (PARTITION BY DATE_TRUNC('year', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}_ytd"
    for s in ("fii", "dii")) + ", fii / NULLIF(dii, 0) AS ratio, CASE WHEN fii < 0 THEN dii / ABS(fii) END AS absorption_rate FROM netflow")
FT = ("fii", "dii", "fii_10d", "fii_mtd", "fii_ytd", "dii_10d", "dii_mtd", "dii_ytd", "ratio", "absorption_rate")


@query("flow_totals", "flow_tot", "SELECT date, " + ", ".join(f"R2({c}) AS {c}" for c in FT) + " FROM flow_tot")
def q_flows(m):
    df = flows.flow_totals(flows.net_by_date(m.flows, 100.0))
    return df.select("date", *[r2(c).alias(c) for c in FT])


@query("flow_regime", "flow_tot", """
WITH k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS k, AVG(fii) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l5,
  COALESCE(SIGN(fii) <> SIGN(LAG(fii) OVER (ORDER BY date)), FALSE) AS flip FROM flow_tot),
r AS (SELECT *, k - COALESCE(MAX(CASE WHEN NOT fii > 0 THEN k END) OVER w, 0) AS buy_run, k - COALESCE(MAX(CASE WHEN NOT fii < 0 THEN k END) OVER w, 0) AS sell_run,
  k - COALESCE(MAX(CASE WHEN NOT (fii > 0 AND dii > 0) THEN k END) OVER w, 0) AS dual_run,
  CASE WHEN k >= 10 THEN l5 - LAG(l5, 5) OVER (ORDER BY date) END AS accel,
  BOOL_OR(flip) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS flipped FROM k
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT date, buy_run, sell_run, dual_run, R2(accel) AS accel, CASE WHEN fii < 0 AND dii < 0 THEN 'Dual Selling' WHEN dual_run >= 3 THEN 'Dual Buying'
  WHEN fii < 0 AND absorption_rate > 0.7 THEN 'DII Absorption' WHEN buy_run >= 5 OR fii_mtd > 5000 THEN 'FII Net Buyer'
  WHEN sell_run >= 5 OR fii_mtd < -5000 THEN 'FII Net Seller' WHEN flipped THEN 'Transition Phase' ELSE 'Neutral' END AS regime,
  CASE WHEN ABS(fii) < 1000 THEN 'Minor' WHEN ABS(fii) < 2000 THEN 'Moderate' WHEN ABS(fii) <= 5000 THEN 'Significant' ELSE 'Major' END AS significance FROM r""")
def q_flow_regime(m):
    df = flows.flow_regime(flows.flow_totals(flows.net_by_date(m.flows, 100.0)))
    return df.select("date", *[F.col(c).cast("bigint") for c in ("buy_run", "sell_run", "dual_run")],
                     r2("accel").alias("accel"), "regime", "significance")


@query("drawdown_periods", "bars", f"""
WITH d AS (SELECT *, close / MAX(close) OVER {run()} - 1 AS dd FROM (SELECT *, ROW_NUMBER() OVER ({BY}) AS rn FROM bars) WHERE rn > 1),
e AS (SELECT *, SUM(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER {run()} AS episode FROM d),
g AS (SELECT symbol, episode, MIN(dd) AS depth, MIN(date) AS start, COUNT(*) AS length FROM e GROUP BY ALL)
SELECT symbol, CAST(episode AS BIGINT) AS episode, R6(depth) AS depth, start, length, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY depth, episode) AS rank
  FROM g QUALIFY rank <= 5""")
def q_dd_periods(m):
    return risk.drawdown_periods(m.bars).withColumn("depth", r6("depth"))


RM = ("annual_return", "annual_vol", "sharpe", "sortino", "calmar", "max_drawdown", "var_95", "var_99", "cvar_95")


@query("risk_metrics", "ret", f"""
WITH d AS (SELECT *, close / MAX(close) OVER {run()} - 1 AS dd FROM ret),
r AS (SELECT * FROM d WHERE ret_1d IS NOT NULL),
s AS (SELECT symbol, EXP(SUM(LN(ret_1d + 1)) * 252.0 / COUNT(*)) - 1 AS annual_return, STDDEV_SAMP(ret_1d) AS sd, AVG(ret_1d - 0.06 / 252) AS me,
  SQRT(AVG(POW(LEAST(ret_1d - 0.06 / 252, 0), 2))) AS down, MIN(dd) AS max_drawdown, QUANTILE_CONT(ret_1d, 0.05) AS var_95, QUANTILE_CONT(ret_1d, 0.01) AS var_99 FROM r GROUP BY symbol),
t AS (SELECT r.symbol, AVG(ret_1d) AS cvar_95 FROM r JOIN s USING (symbol) WHERE ret_1d <= var_95 GROUP BY 1)
SELECT symbol, R6(annual_return) AS annual_return, R6(sd * SQRT(252)) AS annual_vol, R6(me / sd * SQRT(252)) AS sharpe, R6(me / down * SQRT(252)) AS sortino,
  R6(annual_return / NULLIF(ABS(max_drawdown), 0)) AS calmar, R6(max_drawdown) AS max_drawdown, R6(var_95) AS var_95, R6(var_99) AS var_99, R6(cvar_95) AS cvar_95
FROM s LEFT JOIN t USING (symbol)""")
def q_risk(m):
    return risk.risk_metrics(m.bars).select("symbol", *[r6(c).alias(c) for c in RM])


@query("portfolio_risk", "pair_ret bars", """
WITH w AS (SELECT symbol, SUM(volume) / (SELECT SUM(volume) FROM bars) AS weight FROM bars GROUP BY symbol),
c AS (SELECT a, b, cov FROM pair_ret UNION ALL SELECT b, a, cov FROM pair_ret WHERE a <> b),
p AS (SELECT a AS symbol, SUM(cov * weight) * 252 AS cw FROM c JOIN w ON c.b = w.symbol GROUP BY a)
SELECT symbol, R6(weight) AS weight, R6(v) AS portfolio_vol, R6(cw / v) AS marginal FROM p JOIN w USING (symbol),
  (SELECT SQRT(SUM(cw * weight)) AS v FROM p JOIN w USING (symbol)) t""")
def q_portfolio(m):
    cov = pairs.with_correlation(pairs.pair_moments(returns(m), "ret_1d", with_self=True))
    volumes = m.bars.groupBy("symbol").agg(F.sum("volume").alias("v"))
    weights = volumes.select("symbol", (F.col("v") / volumes.agg(F.sum("v")).scalar()).alias("weight"))
    df = risk.portfolio_risk(cov, weights)
    return df.select("symbol", *[r6(c).alias(c) for c in ("weight", "portfolio_vol", "marginal")])


@query("distinct_universe", "bars constituents", """SELECT sector, COUNT(DISTINCT symbol) AS n_symbols, COUNT(DISTINCT date) AS n_dates
  FROM bars JOIN constituents USING (symbol) GROUP BY sector""")
def q_distinct(m):
    return m.bars.join(m.constituents, "symbol").groupBy("sector").agg(
        F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"))


add_view("mret", "monthly bench_monthly", """SELECT symbol, month, m.close / LAG(m.close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r,
  b.close / LAG(b.close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS rb FROM monthly m JOIN bench_monthly b USING (month)""")


def roll_corr_sql(n):
    w = tr(n, "PARTITION BY symbol ORDER BY month")
    return f"R6(CASE WHEN COUNT(r) OVER {w} = {n} AND COUNT(rb) OVER {w} = {n} THEN COALESCE(CORR(r, rb) OVER {w}, 0) END) AS corr_{n}"


@query("rolling_corr", "mret", f"SELECT symbol, month, {roll_corr_sql(6)}, {roll_corr_sql(12)} FROM mret")
def q_rolling_corr(m):
    w = Window.partitionBy("symbol").orderBy("month")
    df = resample_monthly(m.bars).join(bench_monthly(m).withColumnRenamed("close", "b"), "month")
    df = df.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn(
        "rb", F.col("b") / F.lag("b").over(w) - 1)
    return df.select("symbol", "month", *[r6(rel.rolling_corr("r", "rb", n)).alias(f"corr_{n}") for n in (6, 12)])


MB = "PARTITION BY symbol ORDER BY month"


def crossover_sql(src, value, name):
    return f"""
WITH a AS (SELECT symbol, month, {avg(value, 6, by=MB)} AS s, {avg(value, 12, by=MB)} AS l FROM {src}),
b AS (SELECT *, LAG(s) OVER ({MB}) AS ps, LAG(l) OVER ({MB}) AS pl, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY month DESC) - 1 AS ago FROM a),
c AS (SELECT *, CASE WHEN ps <= pl AND s > l THEN 'golden_cross' WHEN ps >= pl AND s < l THEN 'death_cross' END AS kind FROM b),
d AS (SELECT symbol, COUNT(*) AS n, ARG_MIN(s, ago) AS s0, ARG_MIN(l, ago) AS l0, ARG_MIN(kind, ago) FILTER (kind IS NOT NULL AND ago < 12) AS kind,
  MIN(ago) FILTER (kind IS NOT NULL AND ago < 12) AS bars_ago FROM c GROUP BY symbol)
SELECT symbol, CASE WHEN n < 15 THEN 'none' WHEN kind IS NOT NULL THEN kind WHEN ABS((s0 - l0) / l0 * 100) < 1 THEN 'converging' ELSE 'none' END AS type,
  CASE WHEN n >= 15 THEN CAST(bars_ago AS DOUBLE) END AS bars_ago, R4(CASE WHEN n >= 15 THEN (s0 - l0) / l0 * 100 END) AS gap_pct FROM d"""


@query("crossover", "monthly", crossover_sql("monthly", "close", "x"))
def q_crossover(m):
    return rel.crossover(resample_monthly(m.bars)).withColumn("gap_pct", r4("gap_pct"))


@query("percentile_rank", "bars", """
WITH l AS (SELECT symbol, ARG_MAX(close, date) AS cur FROM bars GROUP BY symbol)
SELECT symbol, MAX(cur) AS current, R4(COUNT(*) FILTER (close < cur) * 100.0 / COUNT(*)) AS percentile,
  R4((COUNT(*) FILTER (close < cur) + COUNT(*) FILTER (close = cur) / 2.0) * 100.0 / COUNT(*)) AS mid_percentile FROM bars JOIN l USING (symbol) GROUP BY symbol""")
def q_percentile(m):
    df = rel.percentile_of_latest(m.bars, "close")
    return df.select("symbol", "current", r4("percentile").alias("percentile"), r4("mid_percentile").alias("mid_percentile"))


REVERTS = -2.0  # Dickey-Fuller statistic up to which a pair's spread is followed
add_view("chosen_pairs", "screen", f"SELECT a AS y, b AS x FROM screen WHERE df_t <= {REVERTS}")
add_view("hedge", "bars chosen_pairs", """
WITH j AS (SELECT p.y, p.x, a.date, a.close AS vy, b.close AS vx FROM chosen_pairs p JOIN bars a ON a.symbol = p.y JOIN bars b ON b.symbol = p.x AND a.date = b.date),
f AS (SELECT y, x, REGR_SLOPE(vy, vx) AS hedge_ratio, REGR_INTERCEPT(vy, vx) AS intercept FROM j GROUP BY 1, 2)
SELECT j.*, hedge_ratio, vy - hedge_ratio * vx - intercept AS spread FROM j JOIN f USING (y, x)""")
YX = "PARTITION BY y, x ORDER BY date"


def chosen_pairs(m):
    """The pairs of the screen of all symbols whose spread returns to its mean."""
    screened = pairs.pair_spread_stats(m.bars, "close").filter(r4("df_t") <= REVERTS)
    return screened.select(F.col("a").alias("y"), F.col("b").alias("x"))


@query("spread_z", "hedge", f"""SELECT y, x, date, R4(hedge_ratio) AS hedge_ratio, R4(spread) AS spread, R4(z) AS z, COALESCE(ABS(z) > 2, FALSE) AS extreme
  FROM (SELECT *, (spread - {avg('spread', 20, by=YX)}) / NULLIF({std('spread', 20, by=YX)}, 0) AS z FROM hedge)""")
def q_spread(m):
    df = rel.hedge_spread(chosen_pairs(m), m.bars)
    return df.select("y", "x", "date", r4("hedge_ratio").alias("hedge_ratio"), r4("spread").alias("spread"),
                     r4("z").alias("z"), yes(F.abs("z") > 2).alias("extreme"))


@query("half_life", "hedge", f"""SELECT y, x, n, R4(-LN(2) / NULLIF(slope, 0)) AS half_life FROM (SELECT y, x, COUNT(step) AS n, REGR_SLOPE(step, lg) AS slope
  FROM (SELECT *, spread - {lag('spread', by=YX)} AS step, {lag('spread', by=YX)} AS lg FROM hedge) GROUP BY 1, 2)""")
def q_half_life(m):
    df = rel.half_life(rel.hedge_spread(chosen_pairs(m), m.bars))
    return df.select("y", "x", "n", r4("half_life").alias("half_life"))


@query("microstructure", "bars", """
WITH q AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS bid_vol,
  SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS ask_vol, SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS buy_volume,
  SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS sell_volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT symbol, date, R6((bid_vol - ask_vol) / (bid_vol + ask_vol + 1e-10)) AS book_imbalance, R4((high - low) / ((high + low) / 2) * 10000) AS spread_bps,
  buy_volume - sell_volume AS trade_flow, R6(close / ((open + high + low + close) / 4) - 1) AS vwap_deviation FROM q JOIN bars USING (symbol, date)""")
def q_micro(m):
    line = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def side(c, v):
        return F.sum(F.when(F.col(c) == v, F.col("l_quantity")).otherwise(0.0))
    book = line.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        side("l_linestatus", "O").alias("bid_vol"), side("l_linestatus", "F").alias("ask_vol"),
        side("l_returnflag", "N").alias("buy_volume"), side("l_returnflag", "R").alias("sell_volume"))
    quotes = book.join(m.bars, ["symbol", "date"]).withColumns({
        "bid_price": F.col("low"), "ask_price": F.col("high"),
        "vwap": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4})
    df = rel.microstructure(quotes)
    return df.select("symbol", "date", r6("book_imbalance").alias("book_imbalance"), r4("spread_bps").alias("spread_bps"),
                     "trade_flow", r6("vwap_deviation").alias("vwap_deviation"))


@query("symbol_set_ops", "bars", """
WITH s AS (SELECT date, LIST(symbol ORDER BY symbol) FILTER (close > open) AS up, LIST(symbol ORDER BY symbol) FILTER (volume > 100) AS heavy FROM bars GROUP BY date),
c AS (SELECT date, LEN(LIST_INTERSECT(COALESCE(up, []), COALESCE(heavy, []))) AS n_both, LEN(COALESCE(up, [])) AS nu, LEN(COALESCE(heavy, [])) AS nh FROM s)
SELECT date, CAST(n_both AS BIGINT) AS n_both, CAST(nu + nh - n_both AS BIGINT) AS n_any,
  R6(n_both / NULLIF(CAST(nu + nh - n_both AS DOUBLE), 0)) AS jaccard, R6(n_both / NULLIF(CAST(LEAST(nu, nh) AS DOUBLE), 0)) AS containment FROM c""")
def q_sets(m):
    from bourselake.operators.similarity import containment, jaccard
    df = m.bars.groupBy("date").agg(
        F.collect_set(F.when(F.col("close") > F.col("open"), F.col("symbol"))).alias("up"),
        F.collect_set(F.when(F.col("volume") > 100, F.col("symbol"))).alias("heavy"))
    return df.select("date", F.size(F.array_intersect("up", "heavy")).cast("bigint").alias("n_both"),
                     F.size(F.array_union("up", "heavy")).cast("bigint").alias("n_any"),
                     r6(jaccard("up", "heavy")).alias("jaccard"), r6(containment("up", "heavy")).alias("containment"))


@query("missing_keys", "constituents flows", """SELECT d.date FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) d
  EXCEPT SELECT date FROM flows""")
def q_missing(m):
    expected = m.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return expected.exceptAll(m.flows.select("date").distinct())


@query("lead_lag", "sector_idx ret constituents", """
WITH n AS (SELECT symbol AS node, date, ret_1d AS r FROM ret WHERE ret_1d IS NOT NULL UNION ALL
  SELECT sector, date, close / LAG(close) OVER (PARTITION BY sector ORDER BY date) - 1 FROM sector_idx),
j AS (SELECT c.symbol AS src, c.sector AS dst, x.date, x.r AS x, y.r AS y FROM constituents c JOIN n x ON x.node = c.symbol JOIN n y ON y.node = c.sector AND x.date = y.date
  WHERE x.r IS NOT NULL AND y.r IS NOT NULL),
l AS (SELECT *, """ + ", ".join(f"LEAD(y, {k}) OVER (PARTITION BY src, dst ORDER BY date) AS y{k}" for k in range(1, 6)) + """ FROM j)
SELECT src, dst, COUNT(*) AS n, R6(CORR(x, y)) AS corr0, """ + ", ".join(f"R6(CORR(x, y{k})) AS corr_{k}" for k in range(1, 6)) + " FROM l GROUP BY 1, 2")
def q_lead_lag(m):
    """All six causal-direction correlations per edge; the strongest lead is in influence_edges."""
    from bourselake.operators.graph import node_returns
    series = node_returns(m.bars, sec.sector_index(m.bars, m.constituents))
    x = m.constituents.select(F.col("symbol").alias("src"), F.col("sector").alias("dst"))
    both = x.join(series.select(F.col("node").alias("src"), "date", F.col("r").alias("x")), "src").join(
        series.select(F.col("node").alias("dst"), "date", F.col("r").alias("y")), ["dst", "date"])
    w = Window.partitionBy("src", "dst").orderBy("date")
    for k in range(1, 6):
        both = both.withColumn(f"y{k}", F.lead("y", k).over(w))
    return both.groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.corr("x", "y")).alias("corr0"),
                                          *[r6(F.corr("x", f"y{k}")).alias(f"corr_{k}") for k in range(1, 6)])
