"""Signal outcomes over all signals and bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r4, r6
from bourselake.operators import postmortem as pm
from bourselake.operators.breadth import breadth_series
from bourselake.plans.registry import query
from bourselake.plans.views import BY, add_view, lag
from bourselake.sources.market import Market

add_view("lookup", "bars", f"""SELECT symbol, CAST(UNNEST(GENERATE_SERIES(CAST(GREATEST(date - 4, COALESCE({lag('date')} + 1, date - 4)) AS TIMESTAMP), CAST(date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS target_date,
  close AS price, date AS price_date FROM bars""")
add_view("fwd", "signals bars lookup", """SELECT s.*, b.close AS entry_price, p5.price / b.close - 1 AS ret_5d, p20.price / b.close - 1 AS ret_20d,
  COALESCE(p5.price, p20.price, b.close) AS exit_price, COALESCE(p5.price_date, p20.price_date, s.signal_date + 5) AS exit_date
  FROM signals s JOIN bars b ON b.symbol = s.ticker AND b.date = s.signal_date
  LEFT JOIN lookup p5 ON p5.symbol = s.ticker AND p5.target_date = s.signal_date + 5
  LEFT JOIN lookup p20 ON p20.symbol = s.ticker AND p20.target_date = s.signal_date + 20""")
add_view("regime_day", "breadth", "SELECT date, CASE WHEN R6(pct_above_50) >= 0.5 THEN 'RISK_ON' WHEN R6(pct_above_50) < 0.35 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM breadth")
add_view("pm", "fwd regime_day", """
WITH r AS (SELECT f.*, COALESCE(a.regime, 'UNKNOWN') AS regime_at_signal, COALESCE(z.regime, 'UNKNOWN') AS regime_at_exit, COALESCE(ret_5d, 0) AS r FROM fwd f
  LEFT JOIN regime_day a ON a.date = f.signal_date LEFT JOIN regime_day z ON z.date = f.exit_date)
SELECT *, CASE WHEN regime_at_signal <> regime_at_exit AND regime_at_exit <> 'UNKNOWN' AND ((direction = 'LONG' AND r < -0.02) OR (direction = 'SHORT' AND r > 0.02)) THEN 'REGIME_MISMATCH'
  WHEN ABS(r) < 0.005 THEN 'NEUTRAL' WHEN (direction = 'LONG' AND r > 0) OR (direction = 'SHORT' AND r < 0) THEN 'TRUE_POSITIVE'
  WHEN ABS(r) > 0.02 THEN 'FALSE_POSITIVE_SEVERE' ELSE 'FALSE_POSITIVE' END AS outcome FROM r""")


@query("forward_price_asof", "signals lookup", """SELECT s.signal_ref, s.ticker, p.price, p.price_date FROM signals s
  LEFT JOIN lookup p ON p.symbol = s.ticker AND p.target_date = s.signal_date + 5""")
def q_asof(m):
    side = pm.price_on_or_after(m.bars).select(F.col("symbol").alias("ticker"),
                                               F.date_sub("target_date", 5).alias("signal_date"), "price", "price_date")
    return m.signals.join(side, ["ticker", "signal_date"], "left").select("signal_ref", "ticker", "price", "price_date")


@query("forward_returns", "fwd", """SELECT signal_ref, ticker, signal_date, entry_price, R6(ret_5d) AS ret_5d, R6(ret_20d) AS ret_20d, exit_price, exit_date,
  CAST(exit_date - signal_date AS BIGINT) AS holding_days FROM fwd""")
def q_forward(m):
    df = pm.forward_returns(m.signals, m.bars)
    return df.select("signal_ref", "ticker", "signal_date", "entry_price", r6("ret_5d").alias("ret_5d"),
                     r6("ret_20d").alias("ret_20d"), "exit_price", "exit_date", F.col("holding_days").cast("bigint"))


def postmortems(m: Market):
    """Signals with outcome; the regime of a date comes from market breadth."""
    share = r6("pct_above_50")
    regime = breadth_series(m.bars).select("date", F.when(share >= 0.5, "RISK_ON").when(share < 0.35, "RISK_OFF")
                                           .otherwise("NEUTRAL").alias("regime"))
    df = pm.forward_returns(m.signals, m.bars)
    for out, key in (("regime_at_signal", "signal_date"), ("regime_at_exit", "exit_date")):
        side = regime.select(F.col("date").alias(key), F.col("regime").alias(out))
        df = df.join(side, key, "left").withColumn(out, F.coalesce(out, F.lit("UNKNOWN")))
    return df.withColumn("outcome", pm.outcome("direction", "ret_5d", "regime_at_signal", "regime_at_exit"))


@query("outcome_class", "pm", "SELECT signal_ref, regime_at_signal, regime_at_exit, outcome FROM pm")
def q_outcome(m):
    return postmortems(m).select("signal_ref", "regime_at_signal", "regime_at_exit", "outcome")


@query("ready_signals", "signals", "SELECT signal_ref, ticker FROM signals WHERE DATE '1999-06-30' - signal_date >= 5")
def q_ready(m):
    return pm.ready(m.signals, "1999-06-30").select("signal_ref", "ticker")


COUNTS = """COUNT(*) AS sample_size, COUNT(*) FILTER (outcome = 'TRUE_POSITIVE') AS true_positive, COUNT(*) FILTER (outcome LIKE 'FALSE_POSITIVE%') AS false_positive,
  COUNT(*) FILTER (outcome = 'FALSE_POSITIVE_SEVERE') AS false_positive_severe, COUNT(*) FILTER (outcome = 'REGIME_MISMATCH') AS regime_mismatch,
  COUNT(*) FILTER (outcome = 'NEUTRAL') AS neutral, AVG(COALESCE(ret_5d, 0)) AS avg_return_5d"""
RATES = """COALESCE(true_positive / NULLIF(CAST(true_positive + false_positive AS DOUBLE), 0), 0) AS accuracy, false_positive / CAST(sample_size AS DOUBLE) AS false_positive_rate"""
OUT = "sample_size, true_positive, false_positive, false_positive_severe, regime_mismatch, neutral, R6(avg_return_5d) AS avg_return_5d, R6(accuracy) AS accuracy, R6(false_positive_rate) AS false_positive_rate"
add_view("skills", "pm", f"SELECT *, {RATES} FROM (SELECT skill, {COUNTS} FROM pm GROUP BY skill)")


def shown(df, *keys):
    return df.select(*keys, "sample_size", "true_positive", "false_positive", "false_positive_severe", "regime_mismatch",
                     "neutral", *[r6(c).alias(c) for c in ("avg_return_5d", "accuracy", "false_positive_rate")])


@query("skill_metrics", "skills", f"SELECT skill, {OUT} FROM skills")
def q_skills(m):
    return shown(pm.skill_metrics(postmortems(m)), "skill")


@query("postmortem_cube", "pm", f"""SELECT skill, month, {OUT} FROM (SELECT *, {RATES} FROM (SELECT skill, month, {COUNTS} FROM (SELECT *, STRFTIME(signal_date, '%Y-%m') AS month FROM pm)
  GROUP BY GROUPING SETS ((skill), (month), ())))""")
def q_cube(m):
    return shown(pm.postmortem_cube(postmortems(m)), "skill", "month")


@query("outcome_share", "pm", "SELECT outcome, COUNT(*) AS n, R6(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)) AS share FROM pm GROUP BY outcome")
def q_share(m):
    return pm.outcome_share(postmortems(m)).withColumn("share", r6("share"))


add_view("worst", "pm", """
WITH r AS (SELECT skill, regime_at_signal, COUNT(*) AS n, AVG(CASE WHEN outcome LIKE 'FALSE_POSITIVE%' THEN 1 ELSE 0 END) AS rate FROM pm GROUP BY 1, 2),
b AS (SELECT * FROM r WHERE n >= 5 AND rate > 0.2 QUALIFY ROW_NUMBER() OVER (PARTITION BY skill ORDER BY rate DESC, regime_at_signal DESC) = 1)
SELECT s.skill, COALESCE(b.regime_at_signal, 'NONE') AS worst_regime, b.rate AS worst_rate FROM (SELECT DISTINCT skill FROM pm) s LEFT JOIN b ON s.skill = b.skill""")


@query("worst_regime", "worst", "SELECT skill, worst_regime, R6(worst_rate) AS worst_rate FROM worst")
def q_worst(m):
    return pm.worst_regime(postmortems(m)).withColumn("worst_rate", r6("worst_rate"))


@query("weight_feedback", "skills", """
WITH w AS (SELECT *, LEAST(GREATEST(1 + (accuracy - 0.55) * 0.5, 0.3), 2) AS w FROM skills WHERE sample_size >= 20)
SELECT skill, R4(w) AS suggested_weight, R6(accuracy) AS accuracy, sample_size, COALESCE(NULLIF(CONCAT_WS('; ', CASE WHEN false_positive_rate > 0.15 THEN 'false positive rate' END,
  CASE WHEN accuracy < 0.55 THEN 'below baseline accuracy' END, CASE WHEN accuracy > 0.65 THEN 'strong accuracy' END), ''), 'accuracy-based adjustment') AS reason FROM w WHERE ABS(1 - w) >= 0.05""")
def q_feedback(m):
    df = pm.weight_feedback(pm.skill_metrics(postmortems(m)))
    return df.select("skill", r4("suggested_weight").alias("suggested_weight"), r6("accuracy").alias("accuracy"), "sample_size", "reason")


@query("improvement_backlog", "skills worst", """
WITH j AS (SELECT s.*, w.worst_regime, regime_mismatch / CAST(sample_size AS DOUBLE) AS mm, false_positive_severe / CAST(sample_size AS DOUBLE) AS sv FROM skills s JOIN worst w USING (skill) WHERE sample_size >= 15)
SELECT skill, issue_type, severity, R6(rate) AS rate, worst_regime, CAST(FLOOR(rate * sample_size * k + 1e-6) AS BIGINT) AS priority_score FROM (
  SELECT *, 'false_positive_cluster' AS issue_type, CASE WHEN false_positive_rate > 0.25 THEN 'high' ELSE 'medium' END AS severity, false_positive_rate AS rate, 100 AS k FROM j WHERE false_positive_rate > 0.15
  UNION ALL SELECT *, 'regime_sensitivity', 'medium', mm, 80 FROM j WHERE mm > 0.25 UNION ALL SELECT *, 'overconfidence', 'high', sv, 150 FROM j WHERE sv > 0.1)""")
def q_backlog(m):
    done = postmortems(m)
    return pm.improvement_backlog(pm.skill_metrics(done), pm.worst_regime(done)).withColumn("rate", r6("rate"))
