"""Assumption checks over all line items by return flag, and the walk-forward model."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import lagged, r2, r4, r6, safe_div
from bourselake.operators import indicators as ind, series as ser, statistics as st
from bourselake.plans.registry import query
from bourselake.plans.views import add_view

G, V, X = "l_returnflag", "l_extendedprice", "l_quantity"


def lines(m):
    return m.table("lineitem").select(G, V, X)


add_view("fences", "", "SELECT l_returnflag, QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3, MEDIAN(l_extendedprice) AS med, AVG(l_extendedprice) AS m, STDDEV_POP(l_extendedprice) AS s FROM lineitem GROUP BY 1")
add_view("outl", "fences", """SELECT l_returnflag, COUNT(*) AS n, MAX(q1 - (q3 - q1) * 1.5) AS low, MAX(q3 + (q3 - q1) * 1.5) AS high, COUNT(*) FILTER (l_extendedprice < q1 - (q3 - q1) * 1.5 OR l_extendedprice > q3 + (q3 - q1) * 1.5) AS n_iqr,
  COUNT(*) FILTER (ABS(l_extendedprice - m) > s * 3) AS n_z FROM lineitem JOIN fences USING (l_returnflag) GROUP BY 1""")


@query("outliers", "outl", "SELECT l_returnflag, n, R2(low) AS low, R2(high) AS high, n_iqr, n_z FROM outl")
def q_outliers(m):
    return st.outliers(lines(m), G, V).withColumn("low", r2("low")).withColumn("high", r2("high"))


add_view("lev", "fences", """
WITH z AS (SELECT l_returnflag, l_extendedprice AS x, ABS(l_extendedprice - med) AS z FROM lineitem JOIN fences USING (l_returnflag)), g AS (SELECT l_returnflag, COUNT(*) AS n, AVG(z) AS zb, VAR_POP(z) AS vz, VAR_SAMP(x) AS v FROM z GROUP BY 1),
t AS (SELECT *, (SELECT SUM(n * zb) / SUM(n) FROM g) AS gm FROM g)
SELECT COUNT(*) AS k, SUM(n) AS n, (SUM(n) - COUNT(*)) / (COUNT(*) - 1) * SUM(n * POW(zb - gm, 2)) / SUM(n * vz) AS statistic, MAX(v) / MIN(v) AS variance_ratio FROM t""")


@query("levene_stat", "lev", "SELECT k, CAST(n AS BIGINT) AS n, R6(statistic) AS statistic, R6(variance_ratio) AS variance_ratio FROM lev")
def q_levene(m):
    return st.levene(lines(m), G, V).withColumn("statistic", r6("statistic")).withColumn("variance_ratio", r6("variance_ratio"))


add_view("lin", "", """SELECT l_returnflag, COUNT(*) AS n, REGR_SLOPE(l_extendedprice, l_quantity) AS slope, REGR_INTERCEPT(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS rr,
  SQRT((REGR_SYY(l_extendedprice, l_quantity) - POW(REGR_SXY(l_extendedprice, l_quantity), 2) / REGR_SXX(l_extendedprice, l_quantity)) / COUNT(*)) AS rmse FROM lineitem GROUP BY 1""")


@query("linearity", "lin", "SELECT l_returnflag, n, R4(slope) AS slope, R2(intercept) AS intercept, R6(rr) AS r2, R2(rmse) AS rmse FROM lin")
def q_linear(m):
    df = st.linearity(lines(m), G, X, V)
    return df.select(G, "n", r4("slope").alias("slope"), r2("intercept").alias("intercept"), r6("r2").alias("r2"), r2("rmse").alias("rmse"))


add_view("mom", "fences", """SELECT *, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb FROM (SELECT l_returnflag, COUNT(*) AS n, AVG(POW((l_extendedprice - m) / s, 3)) AS skew, AVG(POW((l_extendedprice - m) / s, 4)) - 3 AS kurt
  FROM lineitem JOIN fences USING (l_returnflag) GROUP BY 1)""")


@query("normality_moments", "mom", "SELECT l_returnflag, n, R6(skew) AS skew, R6(kurt) AS kurt, R4(jb) AS jarque_bera FROM mom")
def q_moments(m):
    df = st.moments(lines(m), G, V)
    return df.select(G, "n", r6("skew").alias("skew"), r6("kurt").alias("kurt"), r4("jarque_bera").alias("jarque_bera"))


@query("assumption_summary", "mom lev lin outl", """SELECT 'normality' AS "check", R4(MAX(jb)) AS figure FROM mom UNION ALL SELECT 'equal_variance', R4(statistic) FROM lev UNION ALL SELECT 'linearity', R4(MIN(rr)) FROM lin
  UNION ALL SELECT 'outliers', R4(MAX(n_iqr / CAST(n AS DOUBLE))) FROM outl""")
def q_summary(m):
    return st.assumption_summary(lines(m), G, V, X).withColumn("figure", r4("figure"))


FEATURES = {"technical": ["ret_5d", "ret_20d", "price_vs_ma50", "vol_ratio", "rsi_sma", "drawdown"],
            "cross_asset": ["proxy_5d", "signal_x_momentum"], "seasonal": ["month", "day_of_week"]}


def labelled(m):
    """Five-bar direction with technical, cross-asset and seasonal features."""
    df = ind.technical_features(m.bars).withColumn("target", (safe_div(lagged("close", -5), "close") - 1 > 0).cast("int"))
    df = ind.ffill_asof(df, m.bench_index, "close", "proxy")
    return ser.seasonal_interaction(df).withColumn("proxy_5d", ind.change("proxy", 5))


@query("walk_forward_ml")
def q_ml(m):
    return st.walk_forward_ml(labelled(m), FEATURES)


@query("walk_forward_importance")
def q_importance(m):
    """What the AUC on the last dates loses when one feature is shuffled."""
    df = st.walk_forward_importance(labelled(m), [n for group in FEATURES.values() for n in group])
    return df.select("feature", r6("auc").alias("auc"), r6("importance").alias("importance"))
