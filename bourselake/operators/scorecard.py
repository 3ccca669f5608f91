"""Five-part score of a backtest result table, with its red flags."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scorecard(results: DataFrame) -> DataFrame:
    """Sample size, expectancy, risk, robustness and realism, 20 points each."""
    n, wr = F.col("total_trades"), F.col("win_rate") / 100
    win, loss = wr * F.col("avg_win_pct"), (F.lit(1.0) - wr) * F.col("avg_loss_pct")
    df = results.withColumn("expectancy", F.floor((win - loss) * 1e6 + 0.50001) / 1e6)
    df = df.withColumn("profit_factor", F.try_divide(win, loss))
    e, pf, dd, y, k = (F.col(c) for c in ("expectancy", "profit_factor", "max_drawdown_pct", "years_tested", "num_parameters"))

    def floor(c):
        return F.floor(c + 1e-9)
    size = (F.when(n < 30, 0).when(n < 100, F.lit(8) + floor((n - 30) / 70 * 7))
            .when(n < 200, F.lit(15) + floor((n - 100) / 100 * 5)).otherwise(20))
    value = F.when(e <= 0, 0).when(e < 0.5, F.lit(5) + floor(e / 0.5 * 5)).when(e < 1.5, F.lit(10) + floor((e - 0.5) * 8)).otherwise(20)
    depth = F.when(dd < 20, 12).otherwise(floor(F.lit(12.0) * (F.lit(50) - dd) / 30))
    payoff = F.when(pf.isNull() | (pf >= 3), 8).when(pf < 1, 0).otherwise(floor((pf - 1) / 2 * 8))
    risk = F.when(dd >= 50, 0).otherwise(F.least(F.lit(20), depth + payoff))
    length = F.when(y < 5, 0).when(y >= 10, 15).otherwise(F.lit(5) + floor((y - 5) / 5 * 10))
    few = F.when(k <= 4, 5).when(k <= 6, 3).when(k == 7, 1).otherwise(0)
    parts = {"sample_score": size, "expectancy_score": value, "risk_score": risk,
             "robustness_score": F.least(F.lit(20), length + few), "realism_score": F.when(F.col("slippage_tested"), 20).otherwise(0)}
    df = df.withColumns({name: c.cast("bigint") for name, c in parts.items()})
    total = sum((F.col(c) for c in parts), F.lit(0))
    flags = F.array_compact(F.array(
        F.when(n < 30, "small_sample"), F.when(~F.col("slippage_tested"), "no_slippage_test"), F.when(dd > 50, "excessive_drawdown"),
        F.when(k >= 7, "over_optimized"), F.when(y < 5, "short_test_period"), F.when(e < 0, "negative_expectancy"),
        F.when((F.col("win_rate") > 90) & (dd < 5), "too_good")))
    return df.withColumn("total", total.cast("bigint")).withColumn("red_flags", flags).withColumn(
        "verdict", F.when(F.col("total") >= 70, "Deploy").when(F.col("total") >= 40, "Refine").otherwise("Abandon"))
