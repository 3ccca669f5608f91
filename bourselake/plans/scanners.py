"""Candidate scanners as of one date over the whole feature panel."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourselake.functions import r2, r4, r6
from bourselake.operators import indicators as ind, scanners as sc, sectors as sec, universe as uni
from bourselake.operators.pairs import last_dates
from bourselake.plans.registry import query
from bourselake.session import cut_lineage
from bourselake.plans.views import BY, add_view, avg, lag
from bourselake.sources.market import Market
from bourselake.sources.normalize import resample_monthly

AS_OF = "1999-11-29"
BENCH = "Brand#1"
MIN_PRICE, MIN_VOLUME = 5.0, 10.0
HINT_FAMILIES = ("pivot_breakout", "gap_up_continuation", "panic_reversal")


class Scan:
    """The shared inputs of one scan date."""

    def __init__(self, m: Market):
        bars = m.bars.filter(F.col("date") <= F.lit(AS_OF).cast("date"))
        self.bars = bars
        self.target = uni.resolved_date(m.bars, AS_OF)
        # every scanner reads the same recent slice: write it once, 90 rows per symbol at most
        recent = last_dates(bars, 90, F.lit(AS_OF).cast("date")).select("date")
        # the longest look-back is 200 bars, so 290 bars per symbol settle the last 90 exactly
        newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
        slice_ = bars.withColumn("k", newest).filter("k <= 300").drop("k")
        self.panel = cut_lineage(ind.feature_panel(slice_).join(recent, "date"))
        self.today = sc.tradable_at(self.panel, self.target, MIN_PRICE, MIN_VOLUME)
        self.regime = cut_lineage(sc.market_regime(self.panel, self.today, self.target, BENCH))
        self.label = self.regime.select("regime_label").scalar()
        self.hints = hints(m)


def hints(m: Market, days: int | None = None):
    """Hints from the news up to the scan date, of the last `days` alone if given; English ones name no symbol."""
    family = F.element_at(F.array(*[F.lit(f) for f in HINT_FAMILIES]), (F.col("news_id") % 3 + 1).cast("int"))
    as_of = F.lit(AS_OF).cast("date")
    known = m.news.filter(F.col("published") <= as_of)
    if days is not None:
        known = known.filter(F.col("published") >= F.date_sub(as_of, days))
    return known.select(
        "news_id", "title", family.alias("entry_family"),
        F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("symbol")).alias("symbols"))


ON = f"DATE '{AS_OF}'"
add_view("hints", "news", f"""SELECT news_id, title, CASE news_id % 3 WHEN 0 THEN 'pivot_breakout' WHEN 1 THEN 'gap_up_continuation' ELSE 'panic_reversal' END AS entry_family,
  CASE WHEN lang = 'en' THEN NULL ELSE symbol END AS symbol FROM news WHERE published <= {ON}""")
add_view("boost", "hints", "SELECT entry_family, symbol, SUM(CASE WHEN symbol IS NULL THEN 6 ELSE 12 END) AS points, COUNT(*) AS n FROM hints GROUP BY 1, 2")
add_view("today", "features", f"""
WITH t AS (SELECT * FROM features WHERE date = {ON} AND close >= 5 AND vol_avg20 >= 10 AND ma50 IS NOT NULL AND ma200 IS NOT NULL)
SELECT *, CASE WHEN rs_120 IS NOT NULL THEN (RANK() OVER (PARTITION BY rs_120 IS NULL ORDER BY rs_120) + (COUNT(*) OVER (PARTITION BY rs_120) - 1) / 2.0)
  / COUNT(rs_120) OVER () END AS rs_rank_pct FROM t""")
add_view("cal_t", "bars", f"SELECT date, ROW_NUMBER() OVER (ORDER BY date DESC) AS ago FROM (SELECT DISTINCT date FROM bars WHERE date <= {ON})")
add_view("mkt_vol", "ret cal_t", """
WITH d AS (SELECT ret.date, ago, AVG(ret_1d) AS mkt, MAX(CASE WHEN symbol = 'Brand#1' THEN ret_1d END) AS bench FROM ret JOIN cal_t USING (date)
  WHERE ret_1d IS NOT NULL AND ago <= 60 GROUP BY ALL),
o AS (SELECT COUNT(*) AS n, CASE WHEN COUNT(bench) FILTER (ago <= 20) >= 10 THEN STDDEV_POP(bench) FILTER (ago <= 20) END * SQRT(252) AS b20,
  CASE WHEN COUNT(bench) >= 20 THEN STDDEV_POP(bench) END * SQRT(252) AS b60,
  STDDEV_POP(mkt) FILTER (k <= 20) * SQRT(252) AS m20, STDDEV_POP(mkt) * SQRT(252) AS m60 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC) AS k FROM d))
SELECT CASE WHEN u THEN m20 ELSE b20 END AS rv20, CASE WHEN u THEN m60 ELSE b60 END AS rv60 FROM (SELECT *, (b20 IS NULL OR b60 IS NULL OR b60 = 0) AND n >= 20 AS u FROM o)""")
add_view("mkt_corr", "ret cal_t", """
WITH r AS (SELECT ret.symbol, ret.date, ret_1d FROM ret JOIN cal_t ON ret.date = cal_t.date AND ago <= 20 WHERE ret_1d IS NOT NULL),
p AS (SELECT CASE WHEN COUNT(*) >= 5 THEN CORR(a.ret_1d, b.ret_1d) END AS c FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol)
SELECT AVG(c) AS avg_pair_corr_20 FROM p WHERE c IS NOT NULL AND NOT ISNAN(c)""")
add_view("regime", "today mkt_vol mkt_corr features", f"""
WITH b AS (SELECT COUNT(DISTINCT symbol) AS universe_count, AVG(CAST(close > ma50 AS INT)) AS pct_above_ma50, AVG(CAST(close > ma200 AS INT)) AS pct_above_ma200 FROM today),
f AS (SELECT b.*, c.avg_pair_corr_20, v.rv20, v.rv60, v.rv20 / NULLIF(v.rv60, 0) AS vol_trend,
  COALESCE((SELECT MAX(CAST(close > ma200 AS INT)) = 1 FROM features WHERE symbol = 'Brand#1' AND date = {ON}), pct_above_ma200 >= 0.5) AS bench_above_ma200,
  (SELECT MAX(ret_1d) FROM features WHERE symbol = 'Brand#1' AND date = {ON}) AS bench_ret_1d FROM b, mkt_corr c, mkt_vol v),
s AS (SELECT *, CASE WHEN bench_above_ma200 THEN 25 ELSE 5 END + C01((pct_above_ma50 - 0.35) / 0.45) * 35 + C01((0.8 - COALESCE(avg_pair_corr_20, 0.5)) / 0.6) * 20
    + C01((1.4 - COALESCE(vol_trend, 1)) / 0.8) * 20 AS risk_on_score,
  CASE WHEN bench_above_ma200 THEN 5 ELSE 20 END + C01((COALESCE(avg_pair_corr_20, 0.5) - 0.35) / 0.45) * 30 + C01((COALESCE(vol_trend, 1) - 0.95) / 0.8) * 30
    + C01((0.55 - pct_above_ma50) / 0.45) * 20 AS risk_off_score FROM f)
SELECT *, CASE WHEN risk_off_score >= 65 AND risk_off_score - risk_on_score >= 5 THEN 'RiskOff' WHEN risk_on_score >= 65 AND risk_on_score >= risk_off_score THEN 'RiskOn' ELSE 'Neutral' END AS regime_label FROM s""")
RG = ("pct_above_ma50", "pct_above_ma200", "avg_pair_corr_20", "rv20", "rv60", "vol_trend", "bench_ret_1d", "risk_on_score", "risk_off_score")


@query("market_regime", "regime", "SELECT universe_count, bench_above_ma200, regime_label, "
       + ", ".join(f"R4({c}) AS {c}" for c in RG) + " FROM regime")
def q_regime(m):
    return Scan(m).regime.select("universe_count", "bench_above_ma200", "regime_label", *[r4(c).alias(c) for c in RG])


@query("hint_match", "hints boost today", """
WITH f(entry_family) AS (VALUES ('pivot_breakout'), ('gap_up_continuation'), ('panic_reversal'))
SELECT t.symbol, f.entry_family, COALESCE(a.n, 0) + COALESCE(b.n, 0) AS n_hints, CAST(LEAST(COALESCE(a.points, 0) + COALESCE(b.points, 0), 20) AS DOUBLE) AS hint_boost
FROM today t, f LEFT JOIN boost a ON a.symbol = t.symbol AND a.entry_family = f.entry_family LEFT JOIN boost b ON b.symbol IS NULL AND b.entry_family = f.entry_family""")
def q_hint_match(m):
    """Points per tradable name and entry family; hints are summed before they meet the names."""
    scan = Scan(m)
    names = scan.today.select("symbol", F.explode(F.array(*[F.lit(f) for f in HINT_FAMILIES])).alias("entry_family"))
    return sc.with_hint_boost(names, scan.hints).select("symbol", "entry_family", "n_hints", "hint_boost")


def pts(on, neutral, off):
    return f"CASE (SELECT regime_label FROM regime) WHEN 'RiskOn' THEN {on} WHEN 'Neutral' THEN {neutral} ELSE {off} END"


def scan_sql(family, where, score, horizon):
    return f"""SELECT * REPLACE (R2(LEAST(GREATEST({score}, 0), 100)) AS priority_score) FROM (
  SELECT t.symbol, '{family}' AS entry_family, '{sc.FAMILIES[family][0]}' AS hypothesis_type, '{sc.FAMILIES[family][1]}' AS mechanism_tag,
    CAST(0 AS DOUBLE) AS priority_score, '{horizon}' AS holding_horizon, COALESCE(a.n, 0) + COALESCE(b.n, 0) AS n_hints, close, gap, rel_volume, close_pos,
    CAST(rs_rank_pct AS DOUBLE) AS rs_rank_pct, ret_1d, LEAST(COALESCE(a.points, 0) + COALESCE(b.points, 0), 20) AS hint_boost, high20_prev, ma50, ma200, atr_pct
  FROM today t LEFT JOIN boost a ON a.symbol = t.symbol AND a.entry_family = '{family}' LEFT JOIN boost b ON b.symbol IS NULL AND b.entry_family = '{family}'
  WHERE {where})"""


add_view("s_breakout", "today boost regime", scan_sql(
    "pivot_breakout", "close > ma50 AND ma50 > ma200 AND close > high20_prev AND rel_volume >= 1.5 AND close_pos >= 0.55 AND rs_rank_pct >= 0.7",
    f"C01(rs_rank_pct) * 40 + C01(rel_volume / 3) * 20 + C01((close / high20_prev - 1) / 0.08) * 20 + C01(close_pos) * 10 + {pts(10, 5, -5)} + hint_boost - C01((atr_pct - 0.08) / 0.07) * 15", "20D"))
add_view("s_gap", "today boost regime", scan_sql(
    "gap_up_continuation", "gap >= 0.002 AND rel_volume >= 1.2 AND close_pos >= 0.4 AND close > ma50",
    f"C01(gap / 0.12) * 35 + C01(rel_volume / 4) * 25 + C01(close_pos) * 20 + CASE WHEN close > ma50 THEN 10 ELSE 0 END + CASE WHEN close > ma200 THEN 10 ELSE 0 END + {pts(8, 4, -8)} + hint_boost - C01((atr_pct - 0.1) / 0.08) * 10", "20D"))
add_view("s_reversal", "today boost regime", scan_sql(
    "panic_reversal", "ret_1d <= -0.012 AND rel_volume >= 1.2 AND close > ma200 * 0.85",
    f"C01(-ret_1d / 0.18) * 45 + C01(rel_volume / 4) * 20 + CASE WHEN close > ma200 THEN 15 ELSE 5 END + {pts(2, 7, 12)} + hint_boost * 0.6 - C01((atr_pct - 0.14) / 0.1) * 12", "5D"))
NUM = ("close", "gap", "rel_volume", "close_pos", "rs_rank_pct", "ret_1d")
SHOW = "symbol, entry_family, hypothesis_type, mechanism_tag, priority_score, holding_horizon, n_hints, " + ", ".join(f"R4({c}) AS {c}" for c in NUM)


def shown(df):
    return df.select("symbol", "entry_family", "hypothesis_type", "mechanism_tag", "priority_score", "holding_horizon",
                     "n_hints", *[r4(c).alias(c) for c in NUM])


def breakouts(s: Scan):
    return sc.breakout(s.today, s.label, s.hints)


def gaps(s: Scan):
    return sc.gap_up(s.today, s.label, s.hints, gap=0.002, rel_volume=1.2, close_pos=0.4)


def reversals(s: Scan):
    return sc.reversal(s.today, s.label, s.hints, drop=-0.012, rel_volume=1.2)


@query("breakout_candidates", "s_breakout", f"SELECT {SHOW} FROM s_breakout")
def q_breakout(m):
    return shown(breakouts(Scan(m)))


@query("gap_candidates", "s_gap", f"SELECT {SHOW} FROM s_gap")
def q_gap(m):
    return shown(gaps(Scan(m)))


@query("reversal_candidates", "s_reversal", f"SELECT {SHOW} FROM s_reversal")
def q_reversal(m):
    return shown(reversals(Scan(m)))


SHIFT = dict(delta=0.05, calm=1.5, stress=0.8)
add_view("s_shift", "features regime", f"""
WITH d AS (SELECT date, AVG(CAST(close > ma50 AS INT)) AS p, AVG(ret_1d) AS r FROM features WHERE ma50 IS NOT NULL AND ma200 IS NOT NULL AND date <= {ON} GROUP BY date),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC) AS k FROM d WHERE r IS NOT NULL),
a AS (SELECT MAX(date) AS date, COUNT(*) AS n, MAX(p) FILTER (k = 1) - ARG_MAX(p, k) FILTER (k <= 8) AS delta, SUM(r) FILTER (k <= 5) AS ret_5d, (SELECT vol_trend FROM regime) AS vt FROM k)
SELECT 'MARKET_BASKET' AS symbol, 'regime_shift' AS hypothesis_type, 'structure' AS mechanism_tag, R2(55 + C01((ABS(delta) - 0.05) / 0.12) * 25) AS priority_score, '60D' AS holding_horizon,
  R6(delta) AS breadth_delta, R6(ret_5d) AS ret_5d, CASE WHEN delta > 0 THEN 'risk_on_transition' ELSE 'risk_off_transition' END AS direction FROM a
WHERE date = {ON} AND n >= 12 AND ((delta >= 0.05 AND ret_5d > 0 AND vt <= 1.5) OR (delta <= -0.05 AND ret_5d < 0 AND vt >= 0.8))""")


def shifts(s: Scan):
    return sc.regime_shift(s.panel, s.regime, s.target, **SHIFT)


@query("regime_shift", "s_shift", "SELECT * FROM s_shift")
def q_shift(m):
    return shifts(Scan(m)).withColumn("breadth_delta", r6("breadth_delta")).withColumn("ret_5d", r6("ret_5d"))


add_view("s_leaders", "features cal_t today", f"""
WITH r AS (SELECT f.*, ago, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY f.date DESC) AS k FROM features f JOIN cal_t ON f.date = cal_t.date AND ago <= 90),
top AS (SELECT symbol FROM r WHERE k <= 20 GROUP BY symbol ORDER BY AVG(close * volume) DESC, symbol),
base AS (SELECT symbol, date, ret_1d FROM r WHERE symbol IN (SELECT symbol FROM top)),
mv AS (SELECT symbol AS leader, ret_1d AS leader_ret FROM today WHERE ABS(ret_1d) >= 0.015 AND symbol IN (SELECT symbol FROM top) ORDER BY ABS(ret_1d) DESC, symbol LIMIT 6),
ord AS (SELECT date, LEAD(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM base)),
led AS (SELECT leader, leader_ret, nd AS date, ret_1d AS x FROM base JOIN mv ON symbol = leader JOIN ord USING (date) WHERE ret_1d IS NOT NULL),
c AS (SELECT leader, leader_ret, symbol, CORR(ret_1d, x) AS lag_corr FROM base JOIN led USING (date) WHERE symbol <> leader AND ret_1d IS NOT NULL GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY leader ORDER BY lag_corr DESC, symbol) AS follower_rank FROM c WHERE lag_corr >= 0.1 AND NOT ISNAN(lag_corr))
SELECT k.symbol, leader, leader_ret, lag_corr, follower_rank, R2(LEAST(GREATEST(C01(ABS(leader_ret) / 0.12) * 40 + C01(lag_corr / 0.6) * 35 + C01(rel_volume / 3) * 15
  + CASE WHEN close > ma50 THEN 10 ELSE 4 END, 0), 100)) AS priority_score FROM k JOIN today t ON k.symbol = t.symbol WHERE follower_rank <= 5 AND ABS(t.ret_1d) < 0.015""")


def followers(s: Scan):
    return sc.leader_followers(s.panel, s.today, s.target, leader_move=0.015, min_corr=0.1)


@query("leader_topk", "s_leaders", "SELECT symbol, leader, R6(leader_ret) AS leader_ret, R6(lag_corr) AS lag_corr, follower_rank, priority_score FROM s_leaders")
def q_leaders(m):
    df = followers(Scan(m))
    return df.select("symbol", "leader", r6("leader_ret").alias("leader_ret"), r6("lag_corr").alias("lag_corr"),
                     F.col("follower_rank").cast("bigint"), "priority_score")


add_view("s_chain", "s_leaders", """SELECT symbol, priority_score, leader, lag_corr FROM s_leaders QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY priority_score DESC, leader) = 1
  ORDER BY priority_score DESC, symbol LIMIT 4""")


@query("correlation_chain", "s_chain", "SELECT symbol, leader, R6(lag_corr) AS lag_corr, priority_score FROM s_chain")
def q_chain(m):
    df = sc.correlation_chain(followers(Scan(m)))
    return df.select("symbol", "leader", r6("lag_corr").alias("lag_corr"), "priority_score")


@query("dedupe_best_per_key", "bars", """SELECT symbol, close, date FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY close DESC, date) AS k FROM bars) WHERE k = 1""")
def q_best(m):
    return sc.best_per_key(m.bars.select("symbol", "close", "date"), "symbol", "close", "date")


@query("lag_corr_chain", "features cal_t", """
WITH r AS (SELECT f.symbol, f.date, ret_1d FROM features f JOIN cal_t ON f.date = cal_t.date AND ago <= 90 WHERE ret_1d IS NOT NULL),
ord AS (SELECT date, LEAD(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM r)),
led AS (SELECT nd AS date, ret_1d AS x FROM r JOIN ord USING (date) WHERE symbol = 'Brand#1')
SELECT symbol, COUNT(*) AS n, R6(CORR(ret_1d, x)) AS lag_corr FROM r JOIN led USING (date) GROUP BY symbol""")
def q_lag_corr(m):
    """Every name against the benchmark's return of the previous date, last 90 dates."""
    bars = m.bars.filter(F.col("date") <= F.lit(AS_OF).cast("date"))
    r = bars.select("symbol", "date", ind.change("close").alias("ret_1d")).filter("ret_1d IS NOT NULL")
    r = r.join(last_dates(bars, 90, F.lit(AS_OF).cast("date")).select("date"), "date")
    order = r.select("date").distinct().withColumn("nd", F.lead("date").over(Window.orderBy("date")))
    led = r.filter(F.col("symbol") == BENCH).join(order, "date").select(F.col("nd").alias("date"), F.col("ret_1d").alias("x"))
    return r.join(led, "date").groupBy("symbol").agg(F.count("*").alias("n"), r6(F.corr("ret_1d", "x")).alias("lag_corr"))


add_view("monthly_t", "bars", f"SELECT symbol, CAST(DATE_TRUNC('month', date) AS DATE) AS month, ARG_MAX(close, date) AS close FROM bars WHERE date <= {ON} GROUP BY 1, 2")
add_view("season_t", "monthly_t", """SELECT symbol, MONTH(month) AS month_num, AVG(r) AS mean_ret, COUNT(r) AS sample_count, AVG(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS win_rate
  FROM (SELECT symbol, month, close / LAG(close) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r FROM monthly_t) GROUP BY 1, 2""")
add_view("s_calendar", "season_t today", f"""
WITH s AS (SELECT * FROM season_t WHERE month_num = MONTH({ON}) AND sample_count >= 4 AND mean_ret >= 0.005 AND win_rate >= 0.6)
SELECT s.symbol, R2(C01(mean_ret / 0.1) * 45 + C01(win_rate) * 30 + COALESCE(C01(rs_rank_pct) * 15, 0) + C01(rel_volume / 2.5) * 10) AS priority_score, mean_ret, win_rate, sample_count
FROM s JOIN today USING (symbol) ORDER BY 2 DESC, 1 LIMIT 3""")


def seasonals(s: Scan):
    season = sec.seasonality(resample_monthly(s.bars))
    return sc.calendar_anomaly(season, s.today, s.target, mean_min=0.005, least=4)


@query("calendar_anomaly", "s_calendar", "SELECT symbol, priority_score, R6(mean_ret) AS mean_ret, R6(win_rate) AS win_rate, sample_count FROM s_calendar")
def q_calendar(m):
    df = seasonals(Scan(m))
    return df.select("symbol", "priority_score", r6("mean_ret").alias("mean_ret"), r6("win_rate").alias("win_rate"), "sample_count")


add_view("reactions", "news ret", "SELECT n.news_id, n.symbol, r.date, r.ret_1d AS reaction_1d, n.title FROM news n JOIN ret r ON r.symbol = n.symbol AND r.date = n.published")
NEWS_DAY = "DATE '1999-11-29'"
add_view("s_news", "reactions today", f"""
WITH d AS (SELECT * FROM reactions WHERE date = {ON} AND reaction_1d IS NOT NULL ORDER BY ABS(reaction_1d) DESC, symbol, news_id LIMIT 4)
SELECT d.*, rel_volume, close_pos, R2(C01(ABS(reaction_1d) / 0.12) * 70 + 20) AS priority_score FROM d LEFT JOIN today t ON d.symbol = t.symbol""")


def reactions(m: Market):
    ret = m.bars.select("symbol", "date", ind.change("close").alias("reaction_1d"))
    return m.news.select("news_id", "symbol", "title", F.col("published").alias("date")).join(ret, ["symbol", "date"])


@query("news_rows_scan", "reactions", f"""SELECT news_id, symbol, date, R6(reaction_1d) AS reaction_1d, R6(ABS(reaction_1d)) AS abs_reaction FROM reactions
  WHERE reaction_1d IS NOT NULL AND date <= {ON}""")
def q_news_rows(m):
    df = reactions(m).filter((F.col("date") <= F.lit(AS_OF).cast("date")) & F.col("reaction_1d").isNotNull())
    return df.select("news_id", "symbol", "date", r6("reaction_1d").alias("reaction_1d"),
                     r6(F.abs("reaction_1d")).alias("abs_reaction")).orderBy(F.desc("abs_reaction"), "news_id")


@query("news_left_join", "reactions features", """SELECT r.news_id, r.symbol, r.date, R6(f.rel_volume) AS rel_volume, R6(f.close_pos) AS close_pos FROM reactions r
  LEFT JOIN features f ON f.symbol = r.symbol AND f.date = r.date AND f.ma200 IS NOT NULL""")
def q_news_join(m):
    feats = ind.feature_panel(m.bars).filter("ma200 IS NOT NULL").select("symbol", "date", "rel_volume", "close_pos")
    df = reactions(m).join(feats, ["symbol", "date"], "left")
    return df.select("news_id", "symbol", "date", r6("rel_volume").alias("rel_volume"), r6("close_pos").alias("close_pos"))


@query("news_reaction", "s_news", "SELECT symbol, news_id, R6(reaction_1d) AS reaction_1d, R6(rel_volume) AS rel_volume, priority_score FROM s_news")
def q_news(m):
    s = Scan(m)
    df = sc.news_reaction(reactions(m), s.today, s.target)
    return df.select("symbol", "news_id", r6("reaction_1d").alias("reaction_1d"), r6("rel_volume").alias("rel_volume"), "priority_score")


SB = "PARTITION BY sector ORDER BY date"
add_view("fut_z", "sector_idx", f"""SELECT sector, date, (r - {avg('r', 60, 30, by=SB)}) / NULLIF(CASE WHEN COUNT(r) OVER ({SB} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 30
  THEN STDDEV_POP(r) OVER ({SB} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END, 0) AS z FROM (SELECT *, close / {lag('close', by=SB)} - 1 AS r FROM sector_idx)""")
add_view("s_futures", "fut_z constituents", f"""SELECT UPPER(symbol) AS symbol, sector AS future, z, R2(C01(ABS(z) / 4) * 60 + 20) AS priority_score
  FROM fut_z JOIN constituents USING (sector) WHERE date = {ON} AND ABS(z) >= 1 ORDER BY 4 DESC, 1 LIMIT 6""")


def futures(m: Market):
    """Sector indices stand in for futures; each maps to its members."""
    index = sec.sector_index(m.bars, m.constituents).withColumnRenamed("sector", "symbol")
    mapping = m.constituents.groupBy(F.col("sector").alias("future")).agg(
        F.array_sort(F.collect_set("symbol")).alias("stocks"))
    return index, mapping


@query("futures_trigger", "s_futures", "SELECT symbol, future, R6(z) AS z, priority_score FROM s_futures")
def q_futures(m):
    df = sc.futures_trigger(*futures(m), F.lit(AS_OF).cast("date"), z_min=1.0)
    return df.withColumn("z", r6("z"))


@query("futures_map_explode", "fut_z constituents", """SELECT sector AS future, symbol, COUNT(*) AS n_shocks, R6(MAX(ABS(z))) AS max_abs_z FROM fut_z JOIN constituents USING (sector)
  WHERE ABS(z) >= 2 GROUP BY 1, 2""")
def q_futures_map(m):
    index, mapping = futures(m)
    w = Window.partitionBy("symbol").orderBy("date")
    z = index.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("z", ind.rolling_z("r"))
    linked = mapping.select(F.col("future").alias("symbol"), F.explode("stocks").alias("stock"))
    return z.filter(F.abs("z") >= 2).join(linked, "symbol").groupBy(
        F.col("symbol").alias("future"), F.col("stock").alias("symbol")).agg(
        F.count("*").alias("n_shocks"), r6(F.max(F.abs("z"))).alias("max_abs_z"))


@query("anomaly_topk", "today regime", """
WITH s AS (SELECT 'stock' AS scope, symbol, metric, value, z, ABS(z) AS abs_z, 2 AS k FROM (
  SELECT symbol, 'ret_1d' AS metric, ret_1d AS value, ret_1d_z AS z FROM today UNION ALL SELECT symbol, 'rel_volume', rel_volume, rel_volume_z FROM today
  UNION ALL SELECT symbol, 'gap', gap, gap_z FROM today UNION ALL SELECT symbol, 'atr_pct', atr_pct, atr_pct_z FROM today) WHERE ABS(z) >= 2
  UNION ALL SELECT 'market', 'MARKET', 'riskoff_combo', vol_trend, NULL, 99, 1 FROM regime WHERE avg_pair_corr_20 >= 0.65 AND vol_trend >= 1.15 AND pct_above_ma50 <= 0.4
  UNION ALL SELECT 'market', 'MARKET', 'breadth_divergence', pct_above_ma50, NULL, 95, 0 FROM regime WHERE pct_above_ma50 <= 0.35 AND bench_ret_1d > 0.003)
SELECT scope, symbol, metric, R6(value) AS value, R6(z) AS z, R6(abs_z) AS abs_z FROM s ORDER BY k, abs_z DESC, symbol, metric LIMIT 10""")
def q_anomalies(m):
    s = Scan(m)
    return sc.anomalies(s.today, s.regime).withColumns({c: r6(c) for c in ("value", "z", "abs_z")})


add_view("s_union", "s_breakout s_gap s_reversal s_shift s_chain s_calendar s_news s_futures", """
SELECT symbol, entry_family, hypothesis_type, priority_score FROM s_breakout UNION ALL SELECT symbol, entry_family, hypothesis_type, priority_score FROM s_gap
UNION ALL SELECT symbol, entry_family, hypothesis_type, priority_score FROM s_reversal UNION ALL SELECT symbol, NULL, hypothesis_type, priority_score FROM s_shift
UNION ALL SELECT symbol, NULL, 'sector_x_stock', priority_score FROM s_chain UNION ALL SELECT symbol, NULL, 'calendar_anomaly', priority_score FROM s_calendar
UNION ALL SELECT symbol, 'news_reaction', 'news_reaction', priority_score FROM s_news UNION ALL SELECT symbol, NULL, 'futures_trigger', priority_score FROM s_futures""")


def all_candidates(m: Market, s: Scan):
    day = F.lit(AS_OF).cast("date")
    return sc.union_candidates(
        breakouts(s), gaps(s), reversals(s), shifts(s),
        sc.correlation_chain(followers(s)).withColumn("hypothesis_type", F.lit("sector_x_stock")).withColumn("mechanism_tag", F.lit("behavior")),
        seasonals(s).withColumn("hypothesis_type", F.lit("calendar_anomaly")).withColumn("mechanism_tag", F.lit("risk_premium")),
        sc.news_reaction(reactions(m), s.today, s.target),
        sc.futures_trigger(*futures(m), day, z_min=1.0).withColumn("hypothesis_type", F.lit("futures_trigger")).withColumn("mechanism_tag", F.lit("structure")))


@query("union_scanners", "s_union", "SELECT * FROM s_union")
def q_union(m):
    return all_candidates(m, Scan(m)).select("symbol", "entry_family", "hypothesis_type", "priority_score")


@query("watchlist_topn", "s_union", "SELECT * FROM s_union ORDER BY priority_score DESC, symbol, hypothesis_type LIMIT 8")
def q_watchlist(m):
    return sc.watchlist(all_candidates(m, Scan(m)), 8).select("symbol", "entry_family", "hypothesis_type", "priority_score")


@query("ticket_build", "s_union", """SELECT LOWER(REGEXP_REPLACE(CONCAT_WS('_', 'edge_auto', CASE WHEN entry_family = 'pivot_breakout' THEN 'vcp' WHEN entry_family = 'gap_up_continuation' THEN 'gap'
  ELSE hypothesis_type END, symbol, '19991129'), '[^a-zA-Z0-9]+', '_', 'g')) AS id, priority_score, COALESCE(entry_family, 'research_only') AS entry_family, entry_family IS NULL AS research_only,
  ROW_NUMBER() OVER (ORDER BY priority_score DESC, symbol, hypothesis_type) AS rank FROM s_union""")
def q_tickets(m):
    s = Scan(m)
    df = sc.tickets(all_candidates(m, s), s.regime, AS_OF)
    return df.select("id", "priority_score", F.col("signal_definition.entry_family").alias("entry_family"), "research_only", "rank")
