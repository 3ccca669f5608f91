"""Indicator and time-series features on the whole bar table."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import avg_full, bool_int, lagged, r2, r4, r6, running, safe_div, trailing
from bourselake.operators import indicators as ind
from bourselake.operators import series as ser
from bourselake.operators.recurrence import ema
from bourselake.plans.registry import query
from bourselake.plans.views import BY, add_view, agg, avg, ewm_view, lag, run, std, tr

KEY = ("symbol", "date")


def show(df: DataFrame, *cols: str, rounding=r6, plain: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*KEY, *[rounding(c).alias(c) for c in cols], *plain)


@query("sma", "bars", f"SELECT symbol, date, R6({avg('close', 20)}) AS sma_20, "
       f"R6({avg('close', 50)}) AS sma_50, R6({avg('close', 200)}) AS sma_200 FROM bars")
def q_sma(m):
    return m.bars.select(*KEY, *[r6(ind.sma("close", n)).alias(f"sma_{n}") for n in (20, 50, 200)])


ewm_view("ema_20", "bars", "close", 2 / 21)
ewm_view("ema_12", "bars", "close", 2 / 13)
ewm_view("ema_26", "bars", "close", 2 / 27)


@query("ema", "ema_20", "SELECT symbol, date, R6(y) AS ema_20 FROM ema_20")
def q_ema(m):
    return show(ema(m.bars, "close", 20, "ema_20"), "ema_20")


add_view("moves", "bars", f"""SELECT symbol, date, CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END AS up,
  CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END AS down
  FROM (SELECT symbol, date, close - {lag('close')} AS d FROM bars)""")
ewm_view("gain14", "moves", "up", 1 / 14)
ewm_view("loss14", "moves", "down", 1 / 14)
add_view("rsi14", "bars gain14 loss14", """SELECT b.symbol, b.date,
  CASE WHEN g.rn >= 14 AND g.y + l.y <> 0 THEN 100 * g.y / (g.y + l.y) END AS rsi
  FROM bars b LEFT JOIN gain14 g ON g.symbol = b.symbol AND g.date = b.date
  LEFT JOIN loss14 l ON l.symbol = b.symbol AND l.date = b.date""")


@query("rsi", "rsi14", "SELECT symbol, date, R6(rsi) AS rsi FROM rsi14")
def q_rsi(m):
    return show(ind.with_rsi(m.bars), "rsi")


@query("rsi_sma", "bars", f"""
WITH r AS (SELECT symbol, date, close / {lag('close')} - 1 AS r FROM bars),
g AS (SELECT symbol, date, CASE WHEN r > 0 THEN r ELSE CAST(0 AS DOUBLE) END AS up,
      CASE WHEN r < 0 THEN -r ELSE CAST(0 AS DOUBLE) END AS dn FROM r)
SELECT symbol, date, R4(100 - 100 / (1 + {avg('up', 14)} / ({avg('dn', 14)} + 1e-10))) AS rsi_sma FROM g""")
def q_rsi_sma(m):
    return show(ind.with_rsi_simple(m.bars), "rsi_sma", rounding=r4)


add_view("macd_line", "ema_12 ema_26", """SELECT f.symbol, f.date, f.y - s.y AS macd
  FROM ema_12 f JOIN ema_26 s ON f.symbol = s.symbol AND f.date = s.date""")
ewm_view("macd_sig", "macd_line", "macd", 2 / 10)


@query("macd", "macd_line macd_sig", """SELECT a.symbol, a.date, R6(a.macd) AS macd, R6(b.y) AS macd_signal,
  R6(a.macd - b.y) AS macd_hist FROM macd_line a JOIN macd_sig b ON a.symbol = b.symbol AND a.date = b.date""")
def q_macd(m):
    return show(ind.with_macd(m.bars), "macd", "macd_signal", "macd_hist")


add_view("tr1", "bars", f"""SELECT symbol, date, close, high, low, GREATEST(high - low,
  COALESCE(ABS(high - {lag('close')}), high - low), COALESCE(ABS(low - {lag('close')}), high - low)) AS tr FROM bars""")
ewm_view("atr14", "tr1", "tr", 1 / 14)


@query("atr", "atr14 tr1", """SELECT t.symbol, t.date, R6(t.tr) AS true_range,
  R6(CASE WHEN a.rn >= 14 THEN a.y END) AS atr FROM tr1 t JOIN atr14 a ON t.symbol = a.symbol AND t.date = a.date""")
def q_atr(m):
    return show(ind.with_atr(m.bars.withColumn("true_range", ind.true_range())), "true_range", "atr")


@query("true_range", "tr1", "SELECT symbol, date, R6(tr) AS true_range FROM tr1")
def q_true_range(m):
    return m.bars.select(*KEY, r6(ind.true_range()).alias("true_range"))


@query("atr_sma", "tr1", f"""SELECT symbol, date, R6({avg('tr', 14)}) AS atr14,
  R6({avg('tr', 14)} / close) AS atr_pct FROM tr1""")
def q_atr_sma(m):
    df = m.bars.withColumn("tr", ind.true_range()).withColumn("atr14", avg_full("tr", 14))
    return show(df.withColumn("atr_pct", safe_div("atr14", "close")), "atr14", "atr_pct")


@query("bollinger", "bars", f"""SELECT symbol, date, R6({avg('close', 20)}) AS bb_mid,
  R6({avg('close', 20)} + 2 * {std('close', 20)}) AS bb_upper,
  R6({avg('close', 20)} - 2 * {std('close', 20)}) AS bb_lower FROM bars""")
def q_bollinger(m):
    return show(ind.with_bollinger(m.bars), "bb_mid", "bb_upper", "bb_lower")


add_view("dm", "bars", f"""SELECT symbol, date, CASE WHEN u IS NULL THEN NULL WHEN u > w AND u > 0 THEN u ELSE 0 END AS pdm,
  CASE WHEN u IS NULL THEN NULL WHEN w > u AND w > 0 THEN w ELSE 0 END AS mdm
  FROM (SELECT symbol, date, high - {lag('high')} AS u, {lag('low')} - low AS w FROM bars)""")
ewm_view("pdm14", "dm", "pdm", 1 / 14)
ewm_view("mdm14", "dm", "mdm", 1 / 14)
add_view("dx", "atr14 pdm14 mdm14", """SELECT a.symbol, a.date,
  100 * ABS(p.y / a.y - q.y / a.y) / NULLIF(p.y / a.y + q.y / a.y, 0) AS dx
  FROM atr14 a JOIN pdm14 p ON a.symbol = p.symbol AND a.date = p.date
  JOIN mdm14 q ON a.symbol = q.symbol AND a.date = q.date WHERE a.rn >= 14""")
ewm_view("adx14", "dx", "dx", 1 / 14)


@query("adx", "bars adx14", """SELECT b.symbol, b.date, R6(CASE WHEN a.rn >= 14 THEN a.y END) AS adx
  FROM bars b LEFT JOIN adx14 a ON a.symbol = b.symbol AND a.date = b.date""")
def q_adx(m):
    return show(ind.with_adx(m.bars), "adx")


@query("indicator_snapshot", "bars ema_20 rsi14 macd_line macd_sig atr14 adx14", f"""
WITH p AS (SELECT symbol, date, close, {avg('close', 20)} AS sma_20, {avg('close', 50)} AS sma_50,
  {avg('close', 200)} AS sma_200, {std('close', 20)} AS sd,
  ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars)
SELECT p.symbol, p.date, R6(p.close) AS close, R6(sma_20) AS sma_20, R6(sma_50) AS sma_50, R6(sma_200) AS sma_200,
  R6(e.y) AS ema_20, R6(r.rsi) AS rsi_14, R6(m.macd) AS macd, R6(s.y) AS macd_signal, R6(m.macd - s.y) AS macd_hist,
  R6(sma_20 + 2 * sd) AS bb_upper, R6(sma_20) AS bb_mid, R6(sma_20 - 2 * sd) AS bb_lower,
  R6(CASE WHEN a.rn >= 14 THEN a.y END) AS atr_14, R6(CASE WHEN x.rn >= 14 THEN x.y END) AS adx_14,
  sma_50 > sma_200 AS golden_cross
FROM p JOIN ema_20 e USING (symbol, date) JOIN rsi14 r USING (symbol, date) JOIN macd_line m USING (symbol, date)
JOIN macd_sig s USING (symbol, date) JOIN atr14 a USING (symbol, date) LEFT JOIN adx14 x USING (symbol, date)
WHERE k = 1""")
def q_snapshot(m):
    return show(ind.indicator_snapshot(m.bars), *ind.SNAPSHOT, plain=("golden_cross",))


add_view("ret", "bars", f"SELECT *, close / {lag('close')} - 1 AS ret_1d FROM bars")


@query("returns", "bars", f"""SELECT symbol, date, R6(close / {lag('close')} - 1) AS ret_1d,
  R6(close / {lag('close', 20)} - 1) AS roc_20, R6(LN(close / {lag('close')})) AS log_ret FROM bars""")
def q_returns(m):
    return m.bars.select(*KEY, r6(ind.change("close")).alias("ret_1d"),
                         r6(ind.change("close", 20)).alias("roc_20"),
                         r6(F.ln(safe_div("close", lagged("close")))).alias("log_ret"))


PREV20 = f"({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
add_view("features_0", "ret tr1", f"""SELECT b.symbol, b.date, b.open, b.high, b.low, b.close, b.volume, b.ret_1d,
  {lag('b.close', 1, 'PARTITION BY b.symbol ORDER BY b.date')} AS prev_close, t.tr
  FROM ret b JOIN tr1 t ON b.symbol = t.symbol AND b.date = t.date""")
add_view("features_1", "features_0", f"""SELECT *, {avg('close', 20)} AS ma20, {avg('close', 50)} AS ma50, {avg('close', 200)} AS ma200,
  {avg('volume', 20)} AS vol_avg20, volume / {avg('volume', 20)} AS rel_volume,
  CASE WHEN COUNT(high) OVER {PREV20} = 20 THEN MAX(high) OVER {PREV20} END AS high20_prev,
  CASE WHEN COUNT(high) OVER {PREV20} = 20 THEN MIN(low) OVER {PREV20} END AS low20_prev,
  C01((close - low) / NULLIF(high - low, 0)) AS close_pos_raw,
  open / prev_close - 1 AS gap, close / {lag('close', 120)} - 1 AS rs_120,
  {avg('tr', 14)} / close AS atr_pct, {avg('tr', 14)} AS atr14 FROM features_0""")


def z60(x: str) -> str:
    return f"({x} - {avg(x, 60, 30)}) / NULLIF({agg('STDDEV_POP', x, 60, 30)}, 0)"


add_view("features", "features_1", f"""SELECT * EXCLUDE (close_pos_raw),
  CASE WHEN high > low THEN close_pos_raw END AS close_pos,
  {z60('ret_1d')} AS ret_1d_z, {z60('rel_volume')} AS rel_volume_z, {z60('gap')} AS gap_z, {z60('atr_pct')} AS atr_pct_z
  FROM features_1""")


@query("rel_volume", "features", "SELECT symbol, date, R6(vol_avg20) AS vol_avg20, R6(rel_volume) AS rel_volume FROM features")
def q_rel_volume(m):
    df = m.bars.withColumn("vol_avg20", avg_full("volume", 20))
    return show(df.withColumn("rel_volume", safe_div("volume", "vol_avg20")), "vol_avg20", "rel_volume")


@query("donchian_prev", "features", "SELECT symbol, date, high20_prev, low20_prev FROM features")
def q_donchian(m):
    return ind.feature_panel(m.bars).select(*KEY, "high20_prev", "low20_prev")


@query("close_pos", "features", "SELECT symbol, date, R6(close_pos) AS close_pos FROM features")
def q_close_pos(m):
    return show(m.bars.withColumn("close_pos", ind.close_position()), "close_pos")


@query("gap", "features", "SELECT symbol, date, R6(gap) AS gap FROM features")
def q_gap(m):
    return m.bars.select(*KEY, r6(safe_div("open", lagged("close")) - 1).alias("gap"))


add_view("rs_ranked", "features", """SELECT *, CASE WHEN rs_120 IS NOT NULL THEN
  (RANK() OVER (PARTITION BY date, rs_120 IS NULL ORDER BY rs_120)
   + (COUNT(*) OVER (PARTITION BY date, rs_120) - 1) / 2.0)
  / COUNT(rs_120) OVER (PARTITION BY date) END AS rs_rank_pct FROM features""")


@query("rs_120", "features", "SELECT symbol, date, R6(rs_120) AS rs_120 FROM features")
def q_rs_120(m):
    return m.bars.select(*KEY, r6(ind.change("close", 120)).alias("rs_120"))


@query("rs_rank_pct", "rs_ranked", """SELECT symbol, date, R6(rs_120) AS rs_120,
  R6(CAST(rs_rank_pct AS DOUBLE)) AS rs_rank_pct FROM rs_ranked""")
def q_rs_rank(m):
    df = m.bars.select(*KEY, ind.change("close", 120).alias("rs_120"))
    return show(df.withColumn("rs_rank_pct", ind.average_rank_pct("rs_120")), "rs_120", "rs_rank_pct")


@query("metric_z", "features", """SELECT symbol, date, R6(ret_1d_z) AS ret_1d_z, R6(rel_volume_z) AS rel_volume_z,
  R6(gap_z) AS gap_z, R6(atr_pct_z) AS atr_pct_z FROM features""")
def q_metric_z(m):
    return show(ind.feature_panel(m.bars), *[f"{c}_z" for c in ind.Z_METRICS])


FEATURES = ("ret_1d", "ma20", "ma50", "ma200", "vol_avg20", "rel_volume", "high20_prev", "low20_prev",
            "close_pos", "gap", "rs_120", "tr", "atr14", "atr_pct", "ret_1d_z", "rel_volume_z",
            "gap_z", "atr_pct_z")


@query("features_panel", "features", "SELECT symbol, date, "
       + ", ".join(f"R6({c}) AS {c}" for c in FEATURES) + " FROM features")
def q_features(m):
    return show(ind.feature_panel(m.bars), *FEATURES)


def dev_z_view(name: str, ma: int) -> None:
    add_view(f"{name}_d", "bars", f"""SELECT *, (close - {avg('close', ma)}) / {avg('close', ma)} AS dev,
      {avg('close', 200)} AS ma200, ROW_NUMBER() OVER ({BY}) AS rn FROM bars""")
    add_view(name, f"{name}_d", f"""SELECT *, CASE WHEN rn >= {max(ma, 200)} THEN
      (dev - {avg('dev', 120)}) / NULLIF({std('dev', 120)}, 0) END AS dev_z FROM {name}_d""")


for _ma in (25, 50, 100, 200):
    dev_z_view(f"devz{_ma}", _ma)


@query("ma_deviation_z", "devz25", "SELECT symbol, date, R6(dev_z) AS dev_z FROM devz25")
def q_dev_z(m):
    return show(ind.deviation_z()(m.bars), "dev_z")


@query("window_z", "bars", f"""SELECT symbol, date, R6((close - {avg('close', 25)}) / NULLIF({std('close', 25)}, 0)) AS z FROM bars""")
def q_window_z(m):
    return m.bars.select(*KEY, r6(ind.window_z()).alias("z"))


@query("drawdown", "bars", f"SELECT symbol, date, R6(close / MAX(close) OVER {run()} - 1) AS drawdown FROM bars")
def q_drawdown(m):
    return m.bars.select(*KEY, r6(ind.drawdown()).alias("drawdown"))


@query("cagr_calmar", "bars", f"""
WITH d AS (SELECT *, close / MAX(close) OVER {run()} - 1 AS dd FROM bars),
s AS (SELECT symbol, COUNT(*) AS n_bars, ARG_MIN(close, date) AS a, ARG_MAX(close, date) AS z, MIN(dd) AS mdd FROM d GROUP BY symbol)
SELECT symbol, n_bars, R6(POW(z / a, 252.0 / n_bars) - 1) AS cagr, R6(mdd) AS max_dd,
  R4((POW(z / a, 252.0 / n_bars) - 1) / NULLIF(ABS(mdd), 0)) AS calmar FROM s""")
def q_cagr(m):
    df = ser.growth_and_drawdown(m.bars)
    return df.select("symbol", "n_bars", r6("cagr").alias("cagr"), r6("max_dd").alias("max_dd"),
                     r4("calmar").alias("calmar"))


@query("high_low_52w", "bars", f"""SELECT symbol, date,
  CASE WHEN COUNT(close) OVER {tr(252)} >= 20 AND close >= MAX(close) OVER {tr(252)} THEN CAST(1 AS BIGINT) ELSE 0 END AS new_high,
  CASE WHEN COUNT(close) OVER {tr(252)} >= 20 AND close <= MIN(close) OVER {tr(252)} THEN CAST(1 AS BIGINT) ELSE 0 END AS new_low FROM bars""")
def q_high_low(m):
    high, low = ind.at_extreme()
    return m.bars.select(*KEY, bool_int(high).alias("new_high"), bool_int(low).alias("new_low"))


def med(x: str, n: int) -> str:
    return f"MEDIAN({x}) OVER {tr(n)}"


add_view("absorbed", "bars", f"""SELECT symbol, date, close, volume, delivery_pct, CASE WHEN rn >= 21 AND volume > 0 THEN (
  (CASE WHEN vm > 0 THEN C01((volume / vm - 1) / 2) ELSE 0 END)
  + (CASE WHEN high > low THEN C01((close - low) / (high - low)) ELSE 0.5 END)
  + (CASE WHEN dm > 0 THEN C01((delivery_pct / dm - 1) / 0.5) ELSE 0 END)) / 3 END AS absorption
  FROM (SELECT *, ROW_NUMBER() OVER ({BY}) AS rn, {med('volume', 20)} AS vm, {med('delivery_pct', 20)} AS dm FROM bars)""")


@query("absorption", "absorbed", "SELECT symbol, date, R6(absorption) AS absorption FROM absorbed")
def q_absorption(m):
    return show(ind.with_absorption(m.bars), "absorption")


@query("trend_band", "bars", f"""
WITH a AS (SELECT symbol, date, close, {avg('close', 200)} AS ma FROM bars),
b AS (SELECT *, close / ma - 1 AS g, COALESCE(ma / {lag('ma', 20)} - 1, 0) AS s FROM a)
SELECT symbol, date, R6(g) AS ma_gap, R6(s) AS ma_slope, CASE WHEN g IS NULL THEN 'n/a'
  WHEN ABS(g) <= 0.03 THEN CASE WHEN s > 0 THEN 'decision zone, rising' ELSE 'decision zone, falling' END
  WHEN g > 0 THEN 'uptrend' ELSE 'downtrend' END AS trend FROM b""")
def q_trend_band(m):
    return show(ind.with_trend_band(m.bars), "ma_gap", "ma_slope", plain=("trend",))


@query("nested_range_depths", "bars", "SELECT symbol, date, " + ", ".join(
    f"MAX(high) OVER {tr(n)} AS high_{n}, MIN(low) OVER {tr(n)} AS low_{n}, "
    f"R6((MAX(high) OVER {tr(n)} - MIN(low) OVER {tr(n)}) / MAX(high) OVER {tr(n)} * 100) AS depth_{n}"
    for n in (120, 60, 30, 15)) + " FROM bars")
def q_nested(m):
    df = m.bars.select(*KEY, *ind.nested_range())
    for n in (120, 60, 30, 15):
        df = df.withColumn(f"depth_{n}", r6(f"depth_{n}"))
    return df


@query("volume_dryup", "bars", f"""SELECT symbol, date, R6({avg('volume', 10)} / {avg('volume', 50)}) AS dry_up_ratio,
  CASE WHEN r < 0.4 THEN CAST(90 AS DOUBLE) WHEN r < 0.5 THEN 80.0 WHEN r < 0.6 THEN 70.0 WHEN r < 0.7 THEN 60.0
  WHEN r < 0.8 THEN 45.0 WHEN r < 0.9 THEN 30.0 WHEN r >= 0.9 THEN 15.0 END AS score
  FROM (SELECT *, R6({avg('volume', 10)} / {avg('volume', 50)}) AS r FROM bars)""")
def q_dryup(m):
    df = m.bars.select(*KEY, r6(ind.volume_dryup()).alias("dry_up_ratio"))
    return df.withColumn("score", ind.dry_up_score("dry_up_ratio"))


add_view("bench_back", "bench_index", "SELECT date, " + ", ".join(
    f"(close / COALESCE(LAG(close, {n}) OVER (ORDER BY date), FIRST_VALUE(close) OVER (ORDER BY date)) - 1) * 100 AS b{n}"
    for n in (63, 126, 189, 252)) + " FROM bench_index")
add_view("rs_excess", "bars bench_back", "SELECT symbol, date, "
         + " + ".join(f"{w} * (s{n} - COALESCE(b{n}, 0))" for n, w in ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2)))
         + " AS rs_value FROM (SELECT symbol, date, " + ", ".join(
             f"(close / COALESCE({lag('close', n)}, FIRST_VALUE(close) OVER ({BY})) - 1) * 100 AS s{n}"
             for n in (63, 126, 189, 252)) + " FROM bars) a LEFT JOIN bench_back USING (date)")


@query("minervini_rs", "rs_excess", """SELECT symbol, date, R4(rs_value) AS rs_value,
  CASE WHEN R4(rs_value) > 50 THEN CAST(95 AS DOUBLE) WHEN R4(rs_value) > 30 THEN 80.0 WHEN R4(rs_value) > 15 THEN 65.0
  WHEN R4(rs_value) > 5 THEN 50.0 WHEN R4(rs_value) > 0 THEN 35.0 ELSE 15.0 END AS score FROM rs_excess""")
def q_minervini(m):
    df = show(ind.weighted_excess(m.bars, m.bench_index), "rs_value", rounding=r4)
    return df.withColumn("score", ind.rs_score("rs_value"))


add_view("template", "bars", f"""
SELECT *, met * (100.0 / 7) AS trend_score, CASE WHEN m200 IS NULL THEN 0 WHEN met >= 6 THEN 2
  WHEN close < m200 AND m50 < m200 THEN 4 WHEN close > m200 AND m50 < m150 THEN 1 ELSE 3 END AS stage
FROM (SELECT *, CASE WHEN m200 IS NULL THEN 0 ELSE
  COALESCE(CAST(close > m150 AS INT), 0) + COALESCE(CAST(close > m200 AS INT), 0) + COALESCE(CAST(m150 > m200 AS INT), 0)
  + COALESCE(CAST(m200 > m200p AS INT), 0) + COALESCE(CAST(m50 > m150 AS INT), 0) + COALESCE(CAST(m50 > m200 AS INT), 0)
  + COALESCE(CAST(close > m50 AS INT), 0) END AS met
FROM (SELECT *, {lag('m200', 21)} AS m200p FROM (SELECT symbol, date, close, {avg('close', 50)} AS m50,
  {avg('close', 150)} AS m150, {avg('close', 200)} AS m200 FROM bars)))""")


@query("trend_template", "template", """SELECT symbol, date, R4(CAST(trend_score AS DOUBLE)) AS trend_score,
  CAST(met AS BIGINT) AS criteria_met, CAST(stage AS BIGINT) AS stage FROM template""")
def q_template(m):
    df = ind.with_trend_template(m.bars)
    return df.select(*KEY, r4("trend_score").alias("trend_score"),
                     F.col("criteria_met").cast("bigint"), F.col("stage").cast("bigint"))


@query("hist_vol", "bars", f"""SELECT symbol, date, R6(CASE WHEN COUNT(lr) OVER {tr(30)} >= 2
  THEN STDDEV_SAMP(lr) OVER {tr(30)} * SQRT(252) ELSE 0.15 END) AS hist_vol
  FROM (SELECT *, LN(close / {lag('close')}) AS lr FROM bars)""")
def q_hist_vol(m):
    return show(ind.with_hist_vol(m.bars), "hist_vol")


TECH = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "price_vs_ma20", "price_vs_ma50", "price_vs_ma200",
        "vol_10d", "vol_30d", "vol_ratio", "bb_position", "drawdown", "vol_ratio_price")


@query("technical_features", "ret", f"""
WITH f AS (SELECT *, {std('ret_1d', 10)} * SQRT(252) AS vol_10d, {std('ret_1d', 30)} * SQRT(252) AS vol_30d,
  close / {lag('close', 5)} - 1 AS ret_5d, close / {lag('close', 20)} - 1 AS ret_20d, close / {lag('close', 60)} - 1 AS ret_60d,
  {avg('close', 20)} AS m20, {avg('close', 50)} AS m50, {avg('close', 200)} AS m200, {std('close', 20)} AS sd20,
  {avg('volume', 20)} AS v20, CASE WHEN ret_1d > 0 THEN ret_1d ELSE CAST(0 AS DOUBLE) END AS up,
  CASE WHEN ret_1d < 0 THEN -ret_1d ELSE CAST(0 AS DOUBLE) END AS dn FROM ret)
SELECT symbol, date, R6(ret_1d) AS ret_1d, R6(ret_5d) AS ret_5d, R6(ret_20d) AS ret_20d, R6(ret_60d) AS ret_60d,
  R6(close / m20 - 1) AS price_vs_ma20, R6(close / m50 - 1) AS price_vs_ma50, R6(close / m200 - 1) AS price_vs_ma200,
  CAST(COALESCE(m50 > m200, FALSE) AS BIGINT) AS golden_cross, R6(vol_10d) AS vol_10d, R6(vol_30d) AS vol_30d,
  R6(vol_10d / (vol_30d + 1e-10)) AS vol_ratio, R6((close - m20) / (2 * sd20 + 1e-10)) AS bb_position,
  R6(close / MAX(close) OVER {run()} - 1) AS drawdown, R6(volume / (v20 + 1)) AS vol_ratio_price,
  CAST(COALESCE(volume > v20 * 2, FALSE) AS BIGINT) AS vol_spike,
  R4(100 - 100 / (1 + {avg('up', 14)} / ({avg('dn', 14)} + 1e-10))) AS rsi_sma FROM f""")
def q_technical(m):
    df = ind.technical_features(m.bars)
    return show(df.withColumn("rsi_sma", r4("rsi_sma")), *TECH, plain=("golden_cross", "vol_spike", "rsi_sma"))


add_view("aligned", "bars bench_index rates", """SELECT b.symbol, b.date, b.close, x.proxy, y.y10 FROM bars b
  ASOF LEFT JOIN (SELECT date, close AS proxy FROM bench_index) x ON b.date >= x.date
  ASOF LEFT JOIN (SELECT date, year10 AS y10 FROM rates) y ON b.date >= y.date""")


@query("cross_asset_features", "aligned", f"""SELECT symbol, date, R6(proxy / {lag('proxy', 5)} - 1) AS index_ret_5d,
  R6(proxy / {lag('proxy', 20)} - 1) AS index_ret_20d, R6(y10 / {lag('y10', 5)} - 1) AS rate_ret_5d,
  R6(close / {lag('close', 20)} - proxy / {lag('proxy', 20)}) AS rs_20d FROM aligned""")
def q_cross_asset(m):
    df = ind.ffill_asof(m.bars, m.bench_index, "close", "proxy")
    df = ind.ffill_asof(df, m.rates, "year10", "y10")
    return df.select(*KEY, r6(ind.change("proxy", 5)).alias("index_ret_5d"),
                     r6(ind.change("proxy", 20)).alias("index_ret_20d"),
                     r6(ind.change("y10", 5)).alias("rate_ret_5d"),
                     r6(ind.change("close", 20) - ind.change("proxy", 20)).alias("rs_20d"))


@query("ffill_asof", "aligned", "SELECT symbol, date, close, R6(y10) AS year10 FROM aligned")
def q_ffill(m):
    df = ind.ffill_asof(m.bars, m.rates, "year10", "year10")
    return df.select(*KEY, "close", r6("year10").alias("year10"))


@query("seasonal_interaction", "aligned", f"""
WITH a AS (SELECT *, close / {lag('close', 20)} - 1 AS mom, close / {lag('close')} - 1 AS r, proxy / {lag('proxy', 5)} - 1 AS p5 FROM aligned),
b AS (SELECT *, {std('r', 30)} * SQRT(252) AS vol FROM a)
SELECT symbol, date, CAST(MONTH(date) AS BIGINT) AS month, CAST(ISODOW(date) - 1 AS BIGINT) AS day_of_week,
  CAST(ISODOW(date) = 1 AS BIGINT) AS is_monday, CAST(ISODOW(date) = 5 AS BIGINT) AS is_friday,
  CAST(MONTH(date) = 3 AS BIGINT) AS is_fiscal_yearend, R6(p5 * mom) AS signal_x_momentum,
  R6(p5 * vol) AS signal_x_vol, R6(p5 * CAST(MONTH(date) BETWEEN 6 AND 9 AS INT)) AS signal_x_monsoon FROM b""")
def q_seasonal(m):
    df = ind.ffill_asof(m.bars, m.bench_index, "close", "proxy")
    return ser.seasonal_interaction(df).select(
        *KEY, "month", "day_of_week", "is_monday", "is_friday", "is_fiscal_yearend",
        r6("signal_x_momentum").alias("signal_x_momentum"), r6("signal_x_vol").alias("signal_x_vol"),
        r6("signal_x_monsoon").alias("signal_x_monsoon"))


@query("forward_label", "bars", f"""SELECT symbol, date, R6(LEAD(close, 5) OVER ({BY}) / close - 1) AS fwd_5d_ret,
  CAST(CASE WHEN LEAD(close, 5) OVER ({BY}) / close - 1 > 0 THEN 1 ELSE 0 END AS BIGINT) AS target FROM bars""")
def q_forward(m):
    df = m.bars.withColumn("f", safe_div(lagged("close", -5), "close") - 1)
    return df.select(*KEY, r6("f").alias("fwd_5d_ret"), bool_int(F.col("f") > 0).alias("target"))


add_view("ret100", "ret", "SELECT symbol, date, ret_1d * 100 AS r, ret_1d * 100 * ret_1d * 100 AS r2 FROM ret")
ewm_view("ewvar", "ret100", "r2", 0.06)


@query("ewma_vol", "ret100 ewvar", f"""
WITH c AS (SELECT r.symbol, r.date, r.r, SQRT(e.y) AS v FROM ret100 r LEFT JOIN ewvar e ON e.symbol = r.symbol AND e.date = r.date),
h AS (SELECT *, CASE WHEN COUNT(v) OVER {tr(252)} = 252 THEN LIST(v) OVER {tr(252)} END AS h FROM c)
SELECT symbol, date, R6(v) AS cond_vol, R6(ABS(r) - v) AS vol_surprise,
  R6((LEN(LIST_FILTER(h, lambda x: x < v)) + LEN(LIST_FILTER(h, lambda x: x <= v)) + 1) / 2.0 / 252) AS vol_percentile FROM h""")
def q_ewma_vol(m):
    return show(ind.with_ewma_vol(m.bars), "cond_vol", "vol_surprise", "vol_percentile")
