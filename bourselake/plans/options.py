"""Option quotes derived from bars, statements from line items."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r2, r4, r6
from bourselake.operators import indicators as ind, options as op, statistics as st
from bourselake.plans.backtests import cdf_sql
from bourselake.plans.registry import query
from bourselake.plans.views import add_view, lag, tr
from bourselake.sources.market import Market


def quotes(m: Market):
    """One option per bar: strike on a grid of five, expiry and volatility from trades and delivery."""
    return m.bars.select(
        "symbol", "date", F.col("close").alias("spot"), (F.floor(F.col("open") / 5) * 5 + 5).cast("double").alias("strike"),
        ((F.col("trades") % 10 + 5) / 100).alias("years"), (F.col("delivery_pct") / 200 + 0.1).alias("sigma"),
        F.lit(0.06).alias("rate"), F.lit(0.01).alias("carry"), (F.col("trades") % 2 == 0).alias("is_call"))


add_view("quotes", "bars", """SELECT symbol, date, close AS s, FLOOR(open / 5) * 5 + 5 AS k, (trades % 10 + 5) / CAST(100 AS DOUBLE) AS t, delivery_pct / 200 + CAST(0.1 AS DOUBLE) AS v, CAST(0.06 AS DOUBLE) AS r, CAST(0.01 AS DOUBLE) AS q, trades % 2 = 0 AS is_call FROM bars""")


@query("option_prices", "quotes", f"""
WITH a AS (SELECT *, (LN(s / k) + (r - q + v * v / 2) * t) / (v * SQRT(t)) AS d1 FROM quotes), b AS (SELECT *, d1 - v * SQRT(t) AS d2, s * EXP(-q * t) AS f, k * EXP(-r * t) AS dc, EXP(-d1 * d1 / 2) / SQRT(2 * PI()) AS pd FROM a),
c AS (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2 FROM b)
SELECT symbol, date, R4(CASE WHEN is_call THEN f * n1 - dc * n2 ELSE dc * (1 - n2) - f * (1 - n1) END) AS value, R6(EXP(-q * t) * CASE WHEN is_call THEN n1 ELSE n1 - 1 END) AS delta, R6(EXP(-q * t) * pd / (s * v * SQRT(t))) AS gamma,
  R6((-f * pd * v / (2 * SQRT(t)) + CASE WHEN is_call THEN q * f * n1 - r * dc * n2 ELSE r * dc * (1 - n2) - q * f * (1 - n1) END) / 365) AS theta, R6(f * pd * SQRT(t) / 100) AS vega,
  R6(CASE WHEN is_call THEN dc * t * n2 ELSE -dc * t * (1 - n2) END / 100) AS rho FROM c""")
def q_prices(m):
    return op.price_quotes(quotes(m)).select("symbol", "date", r4("value").alias("value"), *[r6(c).alias(c) for c in ("delta", "gamma", "theta", "vega", "rho")])


@query("implied_vol")
def q_iv(m):
    priced = op.price_quotes(quotes(m)).withColumn("price", F.col("value"))
    return op.implied_vol(priced).select("symbol", "date", "sigma", "price", r4("implied_vol").alias("implied_vol"))


def legs(m: Market):
    """A call spread per symbol and month: long at the close, short five percent above."""
    from bourselake.sources.normalize import resample_monthly
    base = resample_monthly(m.bars).select(F.concat_ws(":", "symbol", F.col("month").cast("string")).alias("strategy"), F.col("close").alias("underlying"))
    leg = F.array(F.struct(F.lit(1).alias("side"), F.col("underlying").alias("strike"), (F.col("underlying") * 0.03).alias("premium")),
                  F.struct(F.lit(-1).alias("side"), (F.col("underlying") * 1.05).alias("strike"), (F.col("underlying") * 0.01).alias("premium")))
    return base.select("strategy", "underlying", F.lit("call").alias("option_type"), F.inline(leg)).withColumns({"quantity": F.lit(2), "lot_size": F.lit(50)})


@query("strategy_payoff", "monthly", """
WITH b AS (SELECT CONCAT(symbol, ':', CAST(month AS VARCHAR)) AS strategy, close AS u FROM monthly),
g AS (SELECT strategy, i, u * CAST(0.9 AS DOUBLE) + i * (u * CAST(0.2 AS DOUBLE) / 40) AS spot, u FROM b, GENERATE_SERIES(0, 40) t(i)),
p AS (SELECT *, ((GREATEST(spot - u, 0) - u * CAST(0.03 AS DOUBLE)) - (GREATEST(spot - u * CAST(1.05 AS DOUBLE), 0) - u * CAST(0.01 AS DOUBLE))) * 100 AS pl FROM g),
l AS (SELECT *, LAG(pl) OVER w AS p0, LAG(spot) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY strategy ORDER BY i)),
e AS (SELECT *, CASE WHEN p0 * pl < 0 THEN s0 + ABS(p0) / ABS(pl - p0) * (spot - s0) WHEN ABS(pl) < 0.01 THEN spot END AS even FROM l)
SELECT strategy, R2(MAX(pl)) AS max_profit, R2(MIN(pl)) AS max_loss, COUNT(even) AS n_breakevens, R4(MIN(even)) AS first_breakeven, R2(MAX(u) * CAST(0.02 AS DOUBLE) * 100) AS net_premium FROM e GROUP BY strategy""")
def q_payoff(m):
    df = op.strategy_summary(legs(m))
    return df.select("strategy", r2("max_profit").alias("max_profit"), r2("max_loss").alias("max_loss"), "n_breakevens",
                     r4("first_breakeven").alias("first_breakeven"), r2("net_premium").alias("net_premium"))


def chain(m: Market):
    """Five strikes, calls and puts, around each monthly close."""
    from bourselake.sources.normalize import resample_monthly
    base = resample_monthly(m.bars).select("symbol", F.col("last_date").alias("date"), F.col("close").alias("spot"), "volume")
    strikes = F.explode(F.array(*[F.lit(k) for k in (-10, -5, 0, 5, 10)]))
    return base.withColumn("off", strikes).withColumn("strike", F.floor(F.col("spot") / 5) * 5 + F.col("off")).withColumn(
        "sigma", F.lit(0.2) + F.abs("off") / 100).withColumn("is_call", F.explode(F.when(F.col("volume") % 2 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))


@query("iv_rv_features", "monthly bars", f"""
WITH rv AS (SELECT symbol, date, CASE WHEN COUNT(lr) OVER {tr(30)} >= 2 THEN STDDEV_SAMP(lr) OVER {tr(30)} * SQRT(252) ELSE 0.15 END AS realized_vol FROM (SELECT *, LN(close / {lag('close')}) AS lr FROM bars)),
c AS (SELECT symbol, last_date AS date, close AS spot, volume, off, FLOOR(close / 5) * 5 + off AS strike, 0.2 + ABS(off) / 100.0 AS sigma FROM monthly, (VALUES (-10), (-5), (0), (5), (10)) t(off)),
p AS (SELECT symbol, date, CASE WHEN MAX(volume) % 2 = 0 THEN 5 ELSE 0 END / 6.0 AS pcr FROM c GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, date ORDER BY ABS(strike - spot), strike) AS k FROM c),
a AS (SELECT symbol, date, AVG(sigma) AS iv FROM k WHERE k <= 3 GROUP BY 1, 2)
SELECT symbol, date, R6(pcr) AS put_call_ratio, R6(iv) AS atm_iv, R6(realized_vol) AS realized_vol, R6(iv - realized_vol) AS iv_rv_spread FROM p JOIN a USING (symbol, date) LEFT JOIN rv USING (symbol, date)""")
def q_iv_rv(m):
    realized = ind.with_hist_vol(m.bars).select("symbol", "date", F.col("hist_vol").alias("realized_vol"))
    df = op.iv_rv_features(chain(m), realized)
    return df.select("symbol", "date", *[r6(c).alias(c) for c in ("put_call_ratio", "atm_iv", "realized_vol", "iv_rv_spread")])


add_view("fin_long", "financials_wide", "SELECT symbol, line_item, period, value FROM (UNPIVOT financials_wide ON COLUMNS('y[0-9]+') INTO NAME period VALUE value)")


@query("financials_unpivot", "fin_long", "SELECT * FROM fin_long")
def q_unpivot(m):
    return st.unpivot_statements(m.financials_wide, m.years)


@query("growth_metrics", "fin_long", """SELECT symbol, line_item, period, value, R6(value / NULLIF(LAG(value) OVER w, 0) - 1) AS yoy, R6(CASE WHEN value / NULLIF(LAG(value, 3) OVER w, 0) > 0 THEN POW(value / NULLIF(LAG(value, 3) OVER w, 0), 1.0 / 3) - 1 END) AS cagr_3y
  FROM fin_long WINDOW w AS (PARTITION BY symbol, line_item ORDER BY period)""")
def q_growth(m):
    df = st.growth_metrics(st.unpivot_statements(m.financials_wide, m.years))
    return df.select("symbol", "line_item", "period", "value", r6("yoy").alias("yoy"), r6("cagr_3y").alias("cagr_3y"))
