"""Signals, portfolios, validation and factor models on the bar table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import bool_int, lagged, r4, r6, yes
from bourselake.operators import backtest as bt, indicators as ind, kalman, pairs, relations as rel, sectors as sec
from bourselake.plans.registry import query
from bourselake.plans.views import BY, add_view, avg, lag, run, std, tr
from bourselake.session import cut_lineage
from bourselake.sources.market import Market

ANCHORS = (25, 50, 100, 200)
NULL = "buy_hold"


def strategies(m: Market) -> DataFrame:
    """(strategy, symbol, date, ret_1d, target): all targets in one window partitioning."""
    df = ind.with_absorption(m.bars.withColumn("ret_1d", ind.change("close"))
                             .withColumn("up", yes(F.col("close") > ind.sma("close", 200)))
                             .withColumn("wz", ind.window_z()))
    for ma in ANCHORS:
        df = ind.deviation_z(ma)(df).withColumnRenamed("dev_z", f"z{ma}")
    df = sec.with_dislocation(df, "z25", bt.ENTRY)
    gate = (F.col("absorption") >= 0.5) & (F.col("dislocation") >= 0.3)
    columns = {f"bnf_{ma}": bt.reversion_target(f"z{ma}", F.col("up")) for ma in ANCHORS}
    columns["bnf_flow"] = bt.reversion_target("z25", F.col("up"), gate=gate)
    columns["window_z"] = bt.window_target("wz")
    columns[NULL] = F.lit(1.0)
    stack = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("target")) for n, c in columns.items()])
    return df.select("symbol", "date", "ret_1d", F.explode(stack).alias("s")).select(
        "s.strategy", "symbol", "date", "ret_1d", "s.target")


add_view("strat_in", "devz25 devz50 devz100 devz200 absorbed", f"""
SELECT a.symbol, a.date, a.close, a.ma200, a.close / {lag('a.close', 1, 'PARTITION BY a.symbol ORDER BY a.date')} - 1 AS ret_1d, a.dev_z AS z25, b.dev_z AS z50, c.dev_z AS z100, d.dev_z AS z200,
  ab.absorption, COALESCE(a.close > a.ma200, FALSE) AS up, (a.close - {avg('a.close', 25, by='PARTITION BY a.symbol ORDER BY a.date')}) / NULLIF({std('a.close', 25, by='PARTITION BY a.symbol ORDER BY a.date')}, 0) AS wz
FROM devz25 a JOIN devz50 b ON a.symbol = b.symbol AND a.date = b.date JOIN devz100 c ON a.symbol = c.symbol AND a.date = c.date
JOIN devz200 d ON a.symbol = d.symbol AND a.date = d.date JOIN absorbed ab ON a.symbol = ab.symbol AND a.date = ab.date""")
add_view("dislocated", "devz25", "SELECT date, COALESCE(COUNT(*) FILTER (dev_z < -1.5) / NULLIF(CAST(COUNT(dev_z) AS DOUBLE), 0), 0) AS dislocation FROM devz25 GROUP BY date")


def rev(z, gate=""):
    return f"CASE WHEN {z} < -1.5 AND up {gate} THEN LEAST(CAST(1 AS DOUBLE), ABS({z} + 1.5) / 1.5 + 0.5) WHEN {z} >= -0.25 THEN CAST(0 AS DOUBLE) END"


add_view("strat", "strat_in dislocated", " UNION ALL ".join(
    [f"SELECT 'bnf_{ma}' AS strategy, symbol, date, ret_1d, {rev(f'z{ma}')} AS target FROM strat_in" for ma in ANCHORS]
    + [f"SELECT 'bnf_flow', symbol, date, ret_1d, {rev('z25', 'AND absorption >= 0.5 AND dislocation >= 0.3')} FROM strat_in JOIN dislocated USING (date)",
       "SELECT 'window_z', symbol, date, ret_1d, CASE WHEN wz <= -2 THEN LEAST(CAST(1 AS DOUBLE), ABS(wz) / 3) END FROM strat_in",
       f"SELECT '{NULL}', symbol, date, ret_1d, CAST(1 AS DOUBLE) FROM strat_in"]))


def target_query(name: str, strategy: str):
    @query(name, "strat", f"SELECT symbol, date, R6(target) AS target FROM strat WHERE strategy = '{strategy}'")
    def q(m):
        return strategies(m).filter(F.col("strategy") == strategy).select("symbol", "date", r6("target").alias("target"))


for _name, _strategy in (("signal_bnf", "bnf_25"), ("signal_bnf_flow", "bnf_flow"), ("signal_window_z", "window_z"),
                         ("null_buy_hold", NULL)):
    target_query(_name, _strategy)

SS = "PARTITION BY strategy, symbol ORDER BY date"
add_view("pos", "strat", f"""
WITH h AS (SELECT *, COALESCE(LAST_VALUE(target IGNORE NULLS) OVER {run(SS)}, 0) AS held FROM strat),
p AS (SELECT *, GREATEST(COALESCE({lag('held', by=SS)}, 0), 0) AS pos FROM h)
SELECT *, pos > 0 AND COALESCE({lag('pos', by=SS)}, 0) <= 0 AS entry, pos <= 0 AND COALESCE({lag('pos', by=SS)}, 0) > 0 AS exit FROM p""")


def positions(m: Market) -> DataFrame:
    return bt.executed(strategies(m), ["strategy"])


@query("decision_hysteresis", "pos", "SELECT symbol, date, R6(held) AS held, R6(pos) AS pos FROM pos WHERE strategy = 'bnf_25'")
def q_hysteresis(m):
    df = positions(m).filter("strategy = 'bnf_25'")
    return df.select("symbol", "date", r6("held").alias("held"), r6("pos").alias("pos"))


@query("entries_exits", "pos", """SELECT strategy, symbol, COUNT(*) FILTER (entry) AS entries, COUNT(*) FILTER (exit) AS exits, COUNT(*) FILTER (pos > 0) AS bars_held FROM pos GROUP BY 1, 2""")
def q_entries(m):
    return positions(m).groupBy("strategy", "symbol").agg(
        F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits"), F.count_if(F.col("pos") > 0).alias("bars_held"))


def daily_view(name: str, source: str, keys: str, needs: str) -> None:
    add_view(name, needs, f"""
WITH n AS (SELECT *, COUNT(*) FILTER (pos > 0) OVER (PARTITION BY {keys}, date) AS n_held FROM {source}),
w AS (SELECT *, CASE WHEN n_held > 0 THEN pos / n_held ELSE 0 END AS weight FROM n),
c AS (SELECT *, weight * COALESCE(ret_1d, 0) - ABS(weight - COALESCE(LAG(weight) OVER (PARTITION BY {keys}, symbol ORDER BY date), 0)) * 0.0018 AS net FROM w)
SELECT {keys}, date, SUM(net) AS ret, MAX(n_held) AS n_held FROM c GROUP BY {keys}, date""")


def stats_sql(source: str, keys: str) -> str:
    return f"""(WITH e AS (SELECT *, EXP(SUM(LN(ret + 1)) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM {source}),
d AS (SELECT *, equity / GREATEST(MAX(equity) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM e),
s AS (SELECT {keys}, COUNT(*) AS n_days, ARG_MAX(equity, date) AS final, AVG(ret) AS m, STDDEV_SAMP(ret) AS sd, SQRT(AVG(LEAST(ret, 0) * LEAST(ret, 0))) AS down, MIN(dd) AS max_drawdown FROM d GROUP BY {keys})
SELECT {keys}, n_days, final - 1 AS total_return, POW(final, 252.0 / n_days) - 1 AS cagr, m / NULLIF(sd, 0) * SQRT(252) AS sharpe, m / NULLIF(down, 0) * SQRT(252) AS sortino, max_drawdown,
  (POW(final, 252.0 / n_days) - 1) / NULLIF(ABS(max_drawdown), 0) AS calmar FROM s)"""


daily_view("daily", "pos", "strategy", "pos")
add_view("stats", "daily", stats_sql("daily", "strategy"))


def daily(m: Market) -> DataFrame:
    return bt.portfolio_returns(positions(m), ["strategy"])


def stats(m: Market) -> DataFrame:
    return bt.return_stats(daily(m), ["strategy"])


@query("portfolio_returns", "daily", "SELECT strategy, date, R6(ret) AS ret, n_held FROM daily")
def q_portfolio(m):
    return daily(m).select("strategy", "date", r6("ret").alias("ret"), "n_held")


PS = ("total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar")
add_view("trade_runs", "pos", f"""SELECT strategy, symbol, run, EXP(SUM(LN(COALESCE(ret_1d, 0) + 1))) - 1 - 2 * 0.0018 AS pnl FROM (
  SELECT *, SUM(CAST(entry AS INT)) OVER {run(SS)} AS run FROM pos) WHERE pos > 0 GROUP BY 1, 2, 3""")


@query("perf_stats", "stats trade_runs", "SELECT s.strategy, n_days, " + ", ".join(f"R4({c}) AS {c}" for c in PS) + """, t.n_trades, R4(win_rate) AS win_rate,
  R4(profit_factor) AS profit_factor, R6(expectancy) AS expectancy FROM stats s LEFT JOIN (SELECT strategy, COUNT(*) AS n_trades, AVG(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate,
  SUM(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / NULLIF(SUM(CASE WHEN pnl <= 0 THEN -pnl ELSE 0 END), 0) AS profit_factor, AVG(pnl) AS expectancy FROM trade_runs GROUP BY 1) t ON s.strategy = t.strategy""")
def q_perf(m):
    pos = cut_lineage(positions(m))
    df = bt.return_stats(bt.portfolio_returns(pos, ["strategy"]), ["strategy"]).join(
        bt.trade_stats(bt.trades(pos, ["strategy"]), ["strategy"]), "strategy", "left")
    return df.select("strategy", "n_days", *[r4(c).alias(c) for c in PS], "n_trades", r4("win_rate").alias("win_rate"),
                     r4("profit_factor").alias("profit_factor"), r6("expectancy").alias("expectancy"))


@query("edge_over_null", "stats", f"""SELECT strategy, R4(sharpe) AS sharpe, R4(n) AS null_sharpe, R4(sharpe - n) AS sharpe_over_null, CASE WHEN sharpe - n > 0 THEN 'EDGE' ELSE 'no edge over null' END AS verdict
  FROM stats, (SELECT sharpe AS n FROM stats WHERE strategy = '{NULL}') WHERE strategy <> '{NULL}'""")
def q_edge(m):
    df = bt.over_null(cut_lineage(stats(m)), NULL)
    return df.select("strategy", *[r4(c).alias(c) for c in ("sharpe", "null_sharpe", "sharpe_over_null")], "verdict")


@query("strategy_rank", "stats", f"""SELECT strategy, R4(sharpe - n) AS sharpe_over_null, ROW_NUMBER() OVER (ORDER BY sharpe - n DESC NULLS LAST, strategy) AS rank
  FROM stats, (SELECT sharpe AS n FROM stats WHERE strategy = '{NULL}') WHERE strategy <> '{NULL}'""")
def q_rank(m):
    df = bt.over_null(cut_lineage(stats(m)), NULL)
    return sec.ranked(df, F.desc_nulls_last("sharpe_over_null"), "strategy").select(
        "strategy", r4("sharpe_over_null").alias("sharpe_over_null"), "rank")


def expected_max(n):
    import math
    from statistics import NormalDist
    g, d = 0.5772156649015329, NormalDist()
    return (1 - g) * d.inv_cdf(1 - 1 / n) + g * d.inv_cdf(1 - 1 / (n * math.e))


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * ABS({x})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"EXP(-({x}) * ({x}) / 2) / SQRT(2 * PI()) * ({poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query("deflated_sharpe", "stats", f"""SELECT strategy, R6({cdf_sql('zz')}) AS deflated FROM (
  SELECT strategy, (sharpe / SQRT(252) - {expected_max(len(ANCHORS))!r} / SQRT(n_days - 1)) / (SQRT(1 + sharpe / SQRT(252) * sharpe / SQRT(252) / 2) / SQRT(n_days - 1)) AS zz FROM stats)""")
def q_deflated(m):
    return stats(m).select("strategy", r6(bt.deflated_sharpe("sharpe", "n_days", len(ANCHORS))).alias("deflated"))


add_view("tail", "daily", "SELECT * EXCLUDE (k, n) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY date) AS k, COUNT(*) OVER (PARTITION BY strategy) AS n FROM daily) WHERE k > FLOOR(n * 0.7 + 1e-9)")
add_view("tail_stats", "tail", stats_sql("tail", "strategy"))


@query("oos_tail", "tail_stats", "SELECT strategy, n_days, R4(sharpe) AS sharpe, R4(cagr) AS cagr, R4(max_drawdown) AS max_drawdown FROM tail_stats")
def q_oos(m):
    df = bt.return_stats(bt.out_of_sample(daily(m), ["strategy"]), ["strategy"])
    return df.select("strategy", "n_days", *[r4(c).alias(c) for c in ("sharpe", "cagr", "max_drawdown")])


@query("benchmark_compare", "stats", f"""WITH l AS (UNPIVOT (SELECT strategy, total_return, sharpe, max_drawdown, calmar FROM stats WHERE strategy IN ('bnf_50', '{NULL}'))
  ON total_return, sharpe, max_drawdown, calmar INTO NAME metric VALUE v)
SELECT metric, R4(MAX(CASE WHEN strategy = '{NULL}' THEN v END)) AS benchmark, R4(MAX(CASE WHEN strategy = 'bnf_50' THEN v END)) AS strategy_value FROM l GROUP BY metric""")
def q_compare(m):
    df = stats(m).filter(F.col("strategy").isin("bnf_50", NULL)).unpivot(
        "strategy", ["total_return", "sharpe", "max_drawdown", "calmar"], "metric", "v")
    return df.groupBy("metric").agg(
        r4(F.max(F.when(F.col("strategy") == NULL, F.col("v")))).alias("benchmark"),
        r4(F.max(F.when(F.col("strategy") == "bnf_50", F.col("v")))).alias("strategy_value"))


SWEEP = tuple(f"bnf_{a}" for a in ANCHORS) + (NULL,)
IN_SWEEP = ", ".join(f"'{s}'" for s in SWEEP)
add_view("pos_sector", "pos constituents", f"SELECT sector, pos.* FROM pos JOIN constituents USING (symbol) WHERE strategy IN ({IN_SWEEP})")
daily_view("daily_sector", "pos_sector", "sector, strategy", "pos_sector")
add_view("stats_sector", "daily_sector", stats_sql("daily_sector", "sector, strategy"))
add_view("sweep", "stats_sector", f"""SELECT s.sector, s.strategy, s.sharpe, s.sharpe - n.sharpe AS sharpe_over_null, s.cagr, s.max_drawdown FROM stats_sector s
  JOIN stats_sector n ON n.sector = s.sector AND n.strategy = '{NULL}' WHERE s.strategy <> '{NULL}'""")


def sweep(m: Market) -> DataFrame:
    """Anchors per sector basket, all from one pass over the bars."""
    pos = positions(m).filter(F.col("strategy").isin(*SWEEP)).join(m.constituents, "symbol")
    per = bt.return_stats(bt.portfolio_returns(pos, ["sector", "strategy"]), ["sector", "strategy"])
    return bt.over_null(cut_lineage(per), NULL, ["sector"])


@query("param_sweep", "sweep", """SELECT sector, strategy, R4(sharpe) AS sharpe, R4(sharpe_over_null) AS sharpe_over_null, R4(cagr) AS cagr, R4(max_drawdown) AS max_drawdown,
  ROW_NUMBER() OVER (PARTITION BY sector ORDER BY sharpe_over_null DESC NULLS LAST, strategy) AS rank FROM sweep""")
def q_sweep(m):
    df = sec.ranked(sweep(m), F.desc_nulls_last("sharpe_over_null"), "strategy", part=["sector"])
    return df.select("sector", "strategy", *[r4(c).alias(c) for c in ("sharpe", "sharpe_over_null", "cagr", "max_drawdown")], "rank")


@query("anchor_params", "sweep", """SELECT sector, strategy, R4(sharpe) AS sharpe, R4(sharpe_over_null) AS sharpe_over_null FROM sweep
  QUALIFY ROW_NUMBER() OVER (PARTITION BY sector ORDER BY sharpe_over_null DESC NULLS LAST, strategy DESC) = 1 AND sharpe_over_null > 0""")
def q_anchor(m):
    df = bt.best_anchor(sweep(m), ["sector"])
    return df.select("sector", "strategy", r4("sharpe").alias("sharpe"), r4("sharpe_over_null").alias("sharpe_over_null"))


def cross(a, b, above=True):
    op = ("<=", ">") if above else (">=", "<")
    return f"CAST(COALESCE(LAG({a}) OVER ({BY}) {op[0]} LAG({b}) OVER ({BY}) AND {a} {op[1]} {b}, FALSE) AS BIGINT)"


@query("signal_patterns", "bars rsi14 macd_line macd_sig", f"""
WITH p AS (SELECT b.symbol, b.date, b.close, r.rsi, l.macd, s.y AS sig, b.m20, b.sd, b.fast, b.slow, CAST(30 AS DOUBLE) AS l30, CAST(70 AS DOUBLE) AS l70 FROM (
  SELECT symbol, date, close, {avg('close', 20)} AS m20, {std('close', 20)} AS sd, {avg('close', 10)} AS fast, {avg('close', 50)} AS slow FROM bars) b
  JOIN rsi14 r USING (symbol, date) JOIN macd_line l USING (symbol, date) JOIN macd_sig s USING (symbol, date)),
q AS (SELECT symbol, date, rsi, {cross('rsi', 'l30', False)} AS rsi_entry, {cross('rsi', 'l70')} AS rsi_exit, {cross('macd', 'sig')} AS macd_entry, {cross('macd', 'sig', False)} AS macd_exit,
  CAST(COALESCE(close < m20 - 2 * sd, FALSE) AS BIGINT) AS bb_entry, CAST(COALESCE(close > m20 + 2 * sd, FALSE) AS BIGINT) AS bb_exit,
  {cross('fast', 'slow')} AS ma_entry, {cross('fast', 'slow', False)} AS ma_exit FROM p)
SELECT * EXCLUDE (rsi), CASE WHEN ma_entry = 1 AND rsi < 60 THEN CAST(1 AS BIGINT) ELSE 0 END AS combined_entry, CASE WHEN ma_exit = 1 OR rsi > 80 THEN CAST(1 AS BIGINT) ELSE 0 END AS combined_exit FROM q""")
def q_patterns(m):
    return bt.signal_patterns(m.bars)


WF = (5, 10, 15, 20)


def wf_sql():
    parts = []
    for s in WF:
        parts.append(f"""SELECT {s} AS w, symbol, date, rn, n, r, {avg('price', s)} AS f, {avg('price', s * 3)} AS s FROM b""")
    # decimals: what is equal compares as equal, in whatever order an engine adds it up
    wb = "PARTITION BY w, symbol ORDER BY date"
    return f"""
WITH b AS (SELECT symbol, date, CAST(close AS DECIMAL(28, 10)) AS price, COALESCE(close / {lag('close')} - 1, 0) AS r, ROW_NUMBER() OVER ({BY}) AS rn, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars),
m AS ({' UNION ALL '.join(parts)}),
t AS (SELECT *, CASE WHEN LAG(f) OVER ({wb}) <= LAG(s) OVER ({wb}) AND f > s THEN 1.0 WHEN LAG(f) OVER ({wb}) >= LAG(s) OVER ({wb}) AND f < s THEN 0.0 END AS t FROM m),
h AS (SELECT *, COALESCE(LAST_VALUE(t IGNORE NULLS) OVER ({wb} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS h FROM t),
p AS (SELECT *, COALESCE(LAG(h) OVER ({wb}), 0) AS p FROM h),
x AS (SELECT *, p * r - ABS(p - COALESCE(LAG(p) OVER ({wb}), 0)) * 0.001 AS x FROM p),
a AS (SELECT w, symbol, date, rn, n, LEAD(date) OVER ({wb}) AS test_start, CAST(SUM(e) OVER tr AS DOUBLE) AS e1, CAST(SUM(q) OVER tr AS DOUBLE) AS q1, AVG(x) OVER te AS m2, STDDEV_SAMP(x) OVER te AS s2, SUM(LN(x + 1)) OVER te AS g FROM (SELECT *, CAST(x AS DECIMAL(24, 18)) AS e, CAST(x * x AS DECIMAL(24, 18)) AS q FROM x)
  WINDOW tr AS ({wb} ROWS BETWEEN 503 PRECEDING AND CURRENT ROW), te AS ({wb} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING)),
v AS (SELECT *, e1 / 504 AS m1, SQRT(GREATEST((q1 - e1 * e1 / 504) / 503, 0)) AS s1 FROM a),
f AS (SELECT symbol, test_start, w, CASE WHEN s1 > 1e-9 THEN m1 / s1 * SQRT(252) ELSE -999 END AS train_sharpe, CASE WHEN s2 > 1e-9 THEN m2 / s2 * SQRT(252) END AS test_sharpe, EXP(g) - 1 AS test_return
  FROM v WHERE rn >= 504 AND (rn - 504) % 63 = 0 AND rn + 63 < n)
SELECT symbol, test_start, CAST(w AS BIGINT) AS best_window, R4(train_sharpe) AS train_sharpe, R6(test_return) AS test_return, R4(test_sharpe) AS test_sharpe
  FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol, test_start ORDER BY train_sharpe DESC, w) = 1"""


@query("rolling_walk_forward", "bars", wf_sql())
def q_walk(m):
    df = bt.rolling_walk_forward(m.bars, WF)
    return df.select("symbol", "test_start", "best_window", r4("train_sharpe").alias("train_sharpe"),
                     r6("test_return").alias("test_return"), r4("test_sharpe").alias("test_sharpe"))


@query("sector_momentum", "bars constituents", f"""
WITH p AS (SELECT date, sector, AVG(m) AS momentum FROM (SELECT symbol, date, close / {lag('close', 63)} - 1 AS m FROM bars) JOIN constituents USING (symbol) WHERE m IS NOT NULL GROUP BY 1, 2)
SELECT date, sector AS top_sector, R6(momentum) AS momentum FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY date ORDER BY momentum DESC, sector DESC) = 1""")
def q_momentum(m):
    return bt.sector_momentum(m.bars, m.constituents).withColumn("momentum", r6("momentum"))


add_view("mkt", "bench_index", "SELECT date, close / LAG(close) OVER (ORDER BY date) - 1 AS mkt FROM bench_index")


def market(m: Market) -> DataFrame:
    return m.bench_index.select("date", (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("mkt"))


def returns(m: Market) -> DataFrame:
    return m.bars.select("symbol", "date", ind.change("close").alias("ret_1d"))


@query("capm_beta", "ret mkt", """SELECT symbol, COUNT(*) AS n, R6(REGR_INTERCEPT(ret_1d, mkt)) AS alpha, R6(REGR_SLOPE(ret_1d, mkt)) AS beta, R6(regr_r2(ret_1d, mkt)) AS r2
  FROM ret JOIN mkt USING (date) WHERE ret_1d IS NOT NULL AND mkt IS NOT NULL GROUP BY symbol""")
def q_capm(m):
    return bt.capm(returns(m), market(m)).select("symbol", "n", *[r6(c).alias(c) for c in ("alpha", "beta", "r2")])


add_view("factors", "ret mkt bars", """
WITH c AS (SELECT symbol, SUM(volume) AS v, AVG(close) AS p FROM bars GROUP BY symbol), md AS (SELECT MEDIAN(v) AS mv, MEDIAN(p) AS mp FROM c),
f AS (SELECT date, AVG(CASE WHEN v <= mv THEN ret_1d END) - AVG(CASE WHEN v > mv THEN ret_1d END) AS smb, AVG(CASE WHEN p <= mp THEN ret_1d END) - AVG(CASE WHEN p > mp THEN ret_1d END) AS hml
  FROM ret JOIN c USING (symbol), md WHERE ret_1d IS NOT NULL GROUP BY date)
SELECT * FROM f JOIN mkt USING (date)""")


def factors(m: Market) -> DataFrame:
    """Market, small-minus-big (by volume) and cheap-minus-dear (by price) daily returns."""
    size = m.bars.groupBy("symbol").agg(F.sum("volume").alias("v"), F.avg("close").alias("p"))
    mid = size.agg(F.struct(F.percentile("v", F.lit(0.5)).alias("mv"), F.percentile("p", F.lit(0.5)).alias("mp")).alias("s"))
    size = size.withColumn("mid", mid.scalar())
    df = returns(m).filter("ret_1d IS NOT NULL").join(size, "symbol")

    def leg(c: str, k: str):
        low = F.col(c) <= F.col(f"mid.{k}")
        return F.avg(F.when(low, F.col("ret_1d"))) - F.avg(F.when(~low, F.col("ret_1d")))
    return df.groupBy("date").agg(leg("v", "mv").alias("smb"), leg("p", "mp").alias("hml")).join(market(m), "date")


X = ("mkt", "smb", "hml")


def ols_sql():
    def c(a, b):
        return f"COVAR_SAMP({a}, {b})"
    cols = ", ".join(f"{c(a, b)} AS {a}_{b}" for a in X for b in X)
    ys = ", ".join(f"{c('ret_1d', a)} AS y_{a}, AVG({a}) AS m_{a}" for a in X)

    def det(mx):
        return (f"({mx[0][0]} * ({mx[1][1]} * {mx[2][2]} - {mx[1][2]} * {mx[2][1]}) - {mx[0][1]} * ({mx[1][0]} * {mx[2][2]} - {mx[1][2]} * {mx[2][0]})"
                f" + {mx[0][2]} * ({mx[1][0]} * {mx[2][1]} - {mx[1][1]} * {mx[2][0]}))")
    full = [[f"{a}_{b}" for b in X] for a in X]
    betas = ", ".join(f"{det([[f'y_{X[i]}' if j == k else full[i][j] for j in range(3)] for i in range(3)])} / {det(full)} AS beta_{a}" for k, a in enumerate(X))
    return f"""
WITH j AS (SELECT symbol, ret_1d, mkt, smb, hml FROM ret JOIN factors USING (date) WHERE ret_1d IS NOT NULL AND mkt IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL),
s AS (SELECT symbol, COUNT(*) AS n, AVG(ret_1d) AS my, {cols}, {ys} FROM j GROUP BY symbol), b AS (SELECT *, {betas} FROM s)
SELECT symbol, n, R6(my - beta_mkt * m_mkt - beta_smb * m_smb - beta_hml * m_hml) AS alpha, R4(beta_mkt) AS beta_mkt, R4(beta_smb) AS beta_smb, R4(beta_hml) AS beta_hml FROM b"""


@query("factor_ols", "ret factors", ols_sql())
def q_ols(m):
    return bt.factor_ols(returns(m), factors(m)).select("symbol", "n", r6("alpha").alias("alpha"), *[r4(f"beta_{a}").alias(f"beta_{a}") for a in X])


@query("bayes_beta", "ret mkt", """
WITH a AS (SELECT symbol, COUNT(*) AS n, COVAR_SAMP(ret_1d, mkt) AS c, VAR_POP(mkt) AS vx, COVAR_POP(ret_1d, mkt) AS cp, VAR_POP(ret_1d) AS vy FROM ret JOIN mkt USING (date)
  WHERE ret_1d IS NOT NULL AND mkt IS NOT NULL GROUP BY symbol),
b AS (SELECT *, c / vx AS o, (vy - 2 * c / vx * cp + c / vx * c / vx * vx) / (vx * n) AS ov FROM a)
SELECT symbol, n, R6(o) AS ols_beta, R6(1 / (100 + 1 / ov) * (-0.1 + o / ov)) AS posterior_beta, R2(100 + 1 / ov) AS confidence FROM b""")
def q_bayes(m):
    from bourselake.functions import r2
    return bt.bayes_beta(returns(m), market(m)).select("symbol", "n", r6("ols_beta").alias("ols_beta"),
                                                      r6("posterior_beta").alias("posterior_beta"), r2("confidence").alias("confidence"))


@query("pca_factors")
def q_pca(m):
    index = sec.sector_index(m.bars, m.constituents)
    r = index.withColumn("r", F.col("close") / lagged("close", 1, "sector") - 1)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return bt.pca_factors(r.groupBy("date").pivot("sector", names).agg(F.max("r")), names)


add_view("screen", "bars", """
WITH j AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.close AS y, b.close AS x FROM bars a JOIN bars b ON a.date = b.date AND a.symbol < b.symbol),
f AS (SELECT a, b, COUNT(*) AS n, REGR_SLOPE(y, x) AS beta, REGR_INTERCEPT(y, x) AS alpha FROM j GROUP BY 1, 2 HAVING COUNT(*) >= 60),
s AS (SELECT j.a, j.b, date, y - beta * x - alpha AS sp FROM j JOIN f USING (a, b)),
l AS (SELECT *, LAG(sp) OVER (PARTITION BY a, b ORDER BY date) AS lg FROM s),
r AS (SELECT a, b, COUNT(lg) AS k, REGR_SLOPE(sp - lg, lg) AS slope, REGR_SXX(sp - lg, lg) AS sxx, REGR_SYY(sp - lg, lg) AS syy, REGR_SXY(sp - lg, lg) AS sxy FROM l WHERE lg IS NOT NULL GROUP BY 1, 2)
SELECT a, b, n, R4(beta) AS hedge_ratio, R2(-LN(2) / slope) AS half_life, R4(slope / SQRT((syy - sxy * sxy / sxx) / (k - 2) / sxx)) AS df_t FROM f JOIN r USING (a, b)""")


@query("pairs_screen", "screen", "SELECT * FROM screen")
def q_screen(m):
    from bourselake.functions import r2
    df = pairs.pair_spread_stats(m.bars, "close")
    return df.select("a", "b", "n", r4("hedge_ratio").alias("hedge_ratio"), r2("half_life").alias("half_life"), r4("df_t").alias("df_t"))


add_view("level_in", "bars", f"SELECT symbol, date, close AS x, ROW_NUMBER() OVER ({BY}) AS rn FROM bars")
add_view("level", "level_in", """SELECT symbol, rn, date, x AS m, CAST(0.5 AS DOUBLE) AS p FROM level_in WHERE rn = 1 UNION ALL
  SELECT s.symbol, s.rn, s.date, e.m + (e.p + 0.01) / (e.p + 1.01) * (s.x - e.m), (e.p + 0.01) * (1 - (e.p + 0.01) / (e.p + 1.01)) FROM level e JOIN level_in s ON s.symbol = e.symbol AND s.rn = e.rn + 1""")


@query("kalman_smooth", "level", "SELECT symbol, date, R4(m) AS level FROM level")
def q_kalman(m):
    return kalman.local_level(m.bars).withColumn("level", r4("level"))


@query("kalman_hedge")
def q_kalman_hedge(m):
    from bourselake.plans.aggregates import chosen_pairs
    return kalman.dynamic_hedge(rel.hedge_spread(chosen_pairs(m), m.bars).select("y", "x", "date", "vy", "vx"))
